"""Benchmark decontamination: every test suffix is binary-searched in suffix arrays over the training words.

Each task cuts its texts into shards of bounded bytes, builds the shard's word suffix array (sorted as far as a window
reaches) and looks up all windows of the benchmark in it at once. Matches, their places and the longest verbatim run
come from the array's ranges; nothing is shuffled. Only the benchmark is sent out, a bounded block of items at a time:
a larger benchmark takes more passes, each adding its hits to those of the pass before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import store
from pathloom.llm.words import LETTERS_DIGITS, U64, Words, find_words, text_slices

SHARD_BYTES = 3 << 20
BLOCK_BYTES = 32 << 20


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``seq`` ordered by their next ``depth`` values or more: prefix doubling, re-sorting only what is tied."""
    n = len(seq)
    order = np.argsort(seq)
    heads = np.diff(seq[order], prepend=~seq[order[:1]]) != 0
    rank = np.zeros(n + depth + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0)) + 1
    reach = 1
    while reach < depth:
        tied = ~heads
        tied[:-1] |= ~heads[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        held = order[slots]
        key = rank[held] * (n + 2) + rank[np.minimum(held + reach, n)]
        by = np.argsort(key)
        key, held = key[by], held[by]
        order[slots] = held
        new = np.diff(key, prepend=-1) != 0
        heads[slots] = new
        rank[held] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        reach *= 2
    return order


def bounds(seq: np.ndarray, order: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of ``order`` whose suffixes begin with each row of ``wanted``; ``seq`` is padded past its end."""

    def search(after: bool) -> np.ndarray:
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order))
        while (live := np.flatnonzero(low < high)).size:
            middle = (low[live] + high[live]) >> 1
            at, right, open_ = order[middle], np.full(len(live), after), np.arange(len(live))
            for j in range(wanted.shape[1]):
                have, want = seq[at[open_] + j], wanted[live[open_], j]
                differs = have != want
                right[open_[differs]] = (have < want)[differs]
                open_ = open_[~differs]
                if not len(open_):
                    break
            low[live[right]] = middle[right] + 1
            high[live[~right]] = middle[~right]
        return low

    return search(False), search(True)


class Items:
    """The distinct windows of a block of items by length, and which (item, place) each comes from."""

    def __init__(self, rows: Sequence[tuple[int, str | None]], window: int):
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        found: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        for item, (_, text) in enumerate(rows):
            raw = (text or "").encode()
            hashes = _words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashes | U64(1)
            size = min(window, len(hashes))
            for place in range(len(hashes) - size + 1 if size else 0):
                found.setdefault(size, []).append((hashes[place : place + size], item, place))
        for size, seen in sorted(found.items()):
            distinct, which = np.unique(np.stack([s for s, _, _ in seen]), axis=0, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            owners = np.array([(i, p) for _, i, p in seen], np.int64)[order]
            self.by_length.append((distinct, np.searchsorted(which.ravel()[order], np.arange(len(distinct) + 1)), owners[:, 0], owners[:, 1]))


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return find_words(data, offsets, LETTERS_DIGITS, fold=True)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each run, one after another."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)


def match_shard(words: Words, items: Items, window: int, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set ``mask`` where a window's occurrence covers a word; (text, item) pairs, the longest run and its first word by text."""
    texts = len(words.first) - 1
    word_text = np.repeat(np.arange(texts), words.counts)
    seq = np.zeros(len(words.hashes) + texts + window, U64)  # a 0 ends every text; no word is 0
    seq[np.arange(len(word_text)) + word_text] = words.hashes | U64(1)
    longest, where = np.zeros(texts, np.int64), np.full(texts, -1, np.int64)
    pairs = [np.zeros((0, 2), np.int64)]
    if not len(word_text) or not items.by_length:
        return pairs[0][:, 0], pairs[0][:, 1], longest, where
    order = suffix_array(seq[: len(word_text) + texts], window)
    seq_first = words.first + np.arange(texts + 1)
    for wanted, edges, owner, place in items.by_length:
        size = wanted.shape[1]
        low, high = bounds(seq, order, wanted)
        hit = np.flatnonzero(high > low)
        at = order[ragged(low[hit], (high - low)[hit])]
        query = np.repeat(hit, (high - low)[hit])
        text = np.searchsorted(seq_first, at, "right") - 1
        word = at - text
        cover = np.bincount(word, minlength=len(mask) + 1) - np.bincount(word + size, minlength=len(mask) + 1)
        mask |= np.cumsum(cover[:-1]) > 0
        owned = np.diff(edges)[query]
        own = ragged(edges[:-1][query], owned)
        text, word = np.repeat(text, owned), np.repeat(word, owned)
        item, begin = owner[own], place[own]
        pairs.append(np.unique(np.stack([text, item], axis=1), axis=0))
        # Windows that follow one another in both texts are one run.
        line = np.lexsort((word, word - begin, item, text))
        text, item, word, shift = text[line], item[line], word[line], (word - begin)[line]
        new = np.ones(len(line), bool)
        new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(shift) != 0) | (np.diff(word) != 1)
        first = np.flatnonzero(new)
        length = np.diff(first, append=len(line)) + size - 1
        best = first[np.lexsort((-first, length))]
        length = np.sort(length)
        better = length > longest[text[best]]
        longest[text[best[better]]] = length[better]
        where[text[best[better]]] = (word - words.first[text])[best[better]]
    both = np.unique(np.concatenate(pairs), axis=0)
    return both[:, 0], both[:, 1], longest, where


def _matcher(rows: Sequence[tuple[int, str | None]], window: int, shard_bytes: int, drop: Sequence[str]):
    """Adds one block's hits to each document's ``mask``, ``items``, ``longest`` and ``longest_at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows, window)
        for batch in batches:
            for low, high, data, offsets in text_slices(batch["text"], shard_bytes):
                part = batch.slice(low, high - low)
                words = _words(data, offsets)
                mask = np.zeros(len(words.starts), bool)
                before = part["mask"].to_pylist()
                for i in (i for i, bits in enumerate(before) if bits):
                    a, b = words.first[i], words.first[i + 1]
                    mask[a:b] = np.unpackbits(np.frombuffer(before[i], np.uint8), count=int(b - a)).astype(bool)
                text, item, longest, where = match_shard(words, items, window, mask)
                held = [list(x or ()) for x in part["items"].to_pylist()]
                for t, i in zip(text.tolist(), items.ids[item].tolist()):
                    held[t].append(i)
                old = np.array(part["longest"].to_pylist(), np.int64)
                old_at = np.array(part["longest_at"].to_pylist(), np.int64)
                hits = np.concatenate([[0], np.cumsum(mask)])[words.first]
                hit = np.diff(hits)
                new = {
                    "n_words": pa.array(words.counts, pa.int64()),
                    "n_hit": pa.array(hit, pa.int64()),
                    "mask": pa.array([np.packbits(mask[a:b]).tobytes() if n else b"" for a, b, n in zip(words.first, words.first[1:], hit)], pa.binary()),
                    "items": pa.array([sorted(set(x)) for x in held], pa.list_(pa.int64())),
                    "longest": pa.array(np.maximum(old, longest), pa.int64()),
                    "longest_at": pa.array(np.where(longest > old, where, old_at), pa.int64()),
                }
                names = [n for n in part.schema.names if n not in drop]
                yield pa.RecordBatch.from_arrays([new[n] if n in new else part[n] for n in names], names)

    return run


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", carry: Sequence[str] = ("*",), block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Per row of ``docs``: ``row`` (its columns named in ``carry`` as one struct), ``n_words, n_hit, items, longest, longest_at, contaminated``.

    Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` of the text with A-Z lower-cased. A window is ``window``
    consecutive words of an item; an item of fewer words, but not none, is one window. A document word inside any
    occurrence of a window is hit. ``items``: ids of the items with occurring windows; ``longest``: words of the longest
    verbatim run shared with one item (from ``window`` words up, or a short item whole) and ``longest_at`` its first word,
    -1 without one; of equal runs, one with the earliest item. ``contaminated``: some word is hit and 20 * n_hit >= n_words.

    Defined cases: null and empty texts have no words and match nothing; items with a null id are left out; repeated items
    count once; repeated documents each get their row; an empty benchmark hits nothing; columns of any name may be
    present, as they stay inside ``row``.
    """
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    bench = bench.where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = bench.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    work = docs.select(
        F.struct(*carry).alias("row"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"), F.lit(b"").alias("mask"), F.array().cast("array<long>").alias("items"),
        F.lit(0).cast("long").alias("longest"), F.lit(-1).cast("long").alias("longest_at"),
    )
    for block in range(blocks):
        mine = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        drop = () if block + 1 < blocks else ("text", "mask")
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in work.schema if f.name not in drop])
        work = work.mapInArrow(_matcher([tuple(r) for r in mine.collect()], window, shard_bytes, drop), schema)
        work = work if drop else store(work)
    flagged = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return work.select("row", "n_words", "n_hit", "items", "longest", "longest_at", flagged.alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` less the documents that :func:`benchmark_matches` flags; all columns as they were."""
    return benchmark_matches(docs, benchmark, **options).where("NOT contaminated").select("row.*")
