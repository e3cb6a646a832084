"""Substring deduplication: repeated word windows lose all but their first document, with a count-min prefilter.

Three passes over the same dealt texts. The first sends sparse local sketches of window counts, which are merged per
block of cells (``sketch``). The second sends only windows whose merged estimate is two or more, as 128-bit keys with the
chunk's smallest doc_id, once per chunk; the merge of a key range finds each key's smallest doc_id over all chunks and
names to each chunk its keys that start in an earlier document elsewhere. The third removes the words. An estimate is never below the true count, so no repeated
window is lost, and a window that thousands of documents share costs one key per chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathloom.llm import sketch
from pathloom.llm.common import id_and_text
from pathloom.llm.words import NOT_SPACE, U64, find_words, text_slices, window_hash, windows

LAST_ID = np.iinfo(np.int64).max
KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _ids(table: pa.Table) -> np.ndarray:
    """doc_id with a null after every other id."""
    return np.asarray(table["doc_id"].fill_null(LAST_ID).combine_chunks().to_numpy(zero_copy_only=False), np.int64)


def _keys(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window keys of a chunk: two independent 64-bit halves and the row of each window."""
    ones, twos, rows = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for low, _, data, offsets in text_slices(table["text"]):
        words = find_words(data, offsets, NOT_SPACE)
        at, text, length = windows(words, size)
        ones.append(window_hash(words.hashes, at, length, size))
        twos.append(window_hash(words.second, at, length, size, seed=1))
        rows.append(text + low)
    return np.concatenate(ones), np.concatenate(twos), np.concatenate(rows)


class _Distinct:
    """Distinct keys of a chunk: documents per key, smallest doc_id, and the place of every window's key."""

    def __init__(self, table: pa.Table, size: int):
        one, two, rows = _keys(table, size)
        ids = _ids(table)[rows]
        order = np.argsort(one)
        a, b = one[order], two[order]
        if ((np.diff(a) == 0) & (np.diff(b) != 0)).any():  # two windows share one half of the key only
            order = np.lexsort((two, one))
            a, b = one[order], two[order]
        first = np.flatnonzero((np.diff(a, prepend=~a[:1]) != 0) | (np.diff(b, prepend=~b[:1]) != 0))
        lens = np.diff(first, append=len(a))
        group = np.repeat(np.arange(len(first)), lens)
        self.one, self.two, self.rows, self.ids = a[first], b[first], rows, ids
        self.least = np.minimum.reduceat(ids[order], first) if len(first) else ids[:0]
        # Repeats of a key within one document count once.
        shared = np.flatnonzero(lens[group] > 1)
        pairs = np.unique(np.stack([group[shared], rows[order][shared]]), axis=1)[0] if len(shared) else shared
        self.documents = np.ones(len(first), np.int64)
        held = np.bincount(pairs, minlength=len(first))
        self.documents[held > 0] = held[held > 0]
        self.place = np.empty(len(one), np.int64)
        self.place[order] = group


def _pass_one(size: int, shape: sketch.Shape):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = _Distinct(table, size)
        return sketch.packed_table(list(sketch.local_sketch(key[0].as_py(), found.one, found.documents, shape)))

    return run


def _pass_two(size: int, shape: sketch.Shape):
    """Keys whose estimate is two or more, by key range, ascending within a range."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, back: pa.Table) -> pa.Table:
        found = _Distinct(table, size)
        sent = np.flatnonzero(sketch.levels(back, found.one, found.documents, shape) > 0)
        edges = np.searchsorted(_range_of(found.one[sent], shape), np.arange(shape.chunks + 1))
        rows = [
            {
                "chunk": key[0].as_py(), "block": part,
                "cells": sketch.squeeze(found.one[s], found.two[s], found.least[s].view(U64)),
            }
            for part in np.flatnonzero(np.diff(edges)).tolist()
            for s in [sent[edges[part] : edges[part + 1]]]
        ]
        return sketch.packed_table(rows)

    return run


def _range_of(one: np.ndarray, shape: sketch.Shape) -> np.ndarray:
    return ((one >> U64(32)) * U64(shape.chunks) >> U64(32)).astype(np.int64)


def _earlier(table: pa.Table) -> pa.Table:
    """Of each chunk's keys of one range, those that another chunk holds in a document with a smaller id."""
    rows = table.to_pylist()
    parts = [sketch.unsqueeze(r["cells"], 3) for r in rows]
    one, two, least = np.concatenate(parts, axis=1)
    least = least.view(np.int64)
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    first = np.flatnonzero((np.diff(a, prepend=~a[:1]) != 0) | (np.diff(b, prepend=~b[:1]) != 0))
    smallest = np.minimum.reduceat(least[order], first)
    later = np.empty(len(one), bool)
    later[order] = least[order] > np.repeat(smallest, np.diff(first, append=len(a)))
    at = np.cumsum([0, *[p.shape[1] for p in parts]])
    out = []
    for row, x, y in zip(rows, at, at[1:]):
        told = later[x:y]
        if told.any():
            out.append(row | {"cells": sketch.squeeze(one[x:y][told], two[x:y][told])})
    return sketch.packed_table(out)


def _pass_three(size: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, back: pa.Table) -> pa.Table:
        found = _Distinct(table, size)
        told = [sketch.unsqueeze(x, 2) for _, x in sorted(zip(back["block"].to_pylist(), back["cells"].to_pylist()))]
        earlier = np.zeros(len(found.one), bool)
        if told:
            a, b = np.concatenate(told, axis=1)
            low, high = np.searchsorted(found.one, a, "left"), np.searchsorted(found.one, a, "right")
            for step in range(int((high - low).max())):
                at = np.minimum(low + step, high - 1)
                earlier[at[found.two[at] == b]] = True
        gone = earlier[found.place] | (found.ids > found.least[found.place])
        return _remove(table, gone, size)

    return run


def _remove(table: pa.Table, gone: np.ndarray, size: int) -> pa.Table:
    """Drop the words that a window marked in ``gone`` covers; kept words are joined by one space."""
    counts, removed, kept, at = [], [], [], 0
    for _, _, data, offsets in text_slices(table["text"]):
        words = find_words(data, offsets, NOT_SPACE)
        first, text, _ = windows(words, size)
        mine = first[gone[at : at + len(first)]]
        at += len(first)
        cover = np.zeros(len(words.starts) + 1, np.int32)
        cover[mine] += 1
        cover[mine + size] -= 1
        keep = np.cumsum(cover[:-1]) == 0
        starts, ends = words.starts[keep], words.ends[keep]
        own_end = offsets[1:][np.searchsorted(offsets, starts, "right") - 1]
        stops = np.minimum(ends + 1, own_end)
        mask = np.zeros(len(data) + 1, np.int8)
        mask[starts] += 1
        mask[stops] -= 1
        mask = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
        # The byte after a kept word, if any, becomes its space; a text's last one is cut off.
        last = np.zeros(len(starts), bool)
        last[:-1] = np.searchsorted(offsets, starts[1:], "right") != np.searchsorted(offsets, starts[:-1], "right")
        last[-1:] = True
        mask[ends[last & (stops > ends)]] = False
        spaced = data.copy()
        spaced[ends[stops > ends]] = 0x20
        out = spaced[mask]
        bounds = np.concatenate([[0], np.cumsum(mask)])[offsets]
        kept.append(pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)).cast(pa.string()))
        counts.append(words.counts)
        total = np.concatenate([[0], np.cumsum(~keep)])
        removed.append(total[words.first[1:]] - total[words.first[:-1]])
    return pa.table({
        "doc_id": table["doc_id"],
        "n_words": pa.array(np.concatenate(counts), pa.int64()),
        "n_removed": pa.array(np.concatenate(removed), pa.int64()),
        "kept": pa.chunked_array(kept, pa.string()),
    })


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13,
    depth: int = 2, cells_per_window: int = 8, chunk_bytes: int = sketch.CHUNK_BYTES,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, kept``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a run of ``window`` words of its document covers it whose
    sequence also starts in a document with a smaller id; runs are judged on the input. ``depth`` rows of about
    ``cells_per_window`` cells a window are the sketch; they change the cost, never the result.

    Defined cases: a null or empty text has no words and keeps an empty text; a null id comes after every other id; rows
    with one id never remove each other's words, and repeated rows each get their result; no rows give no rows.
    """
    docs = id_and_text(docs, id_col, text_col)
    shape = sketch.Shape.of(docs, depth, cells_per_window, chunk_bytes)
    dealt = sketch.chunked(docs, shape)
    estimates = sketch.merged(dealt.groupBy("chunk").applyInArrow(_pass_one(window, shape), sketch.PACKED))
    keys = dealt.groupBy("chunk").cogroup(estimates.groupBy("chunk")).applyInArrow(_pass_two(window, shape), sketch.PACKED)
    answers = keys.groupBy("block").applyInArrow(_earlier, sketch.PACKED)
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_pass_three(window), KEPT)
