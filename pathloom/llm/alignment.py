"""Tokens of two tokenizers aligned by their bytes, merged along equal-work diagonals.

1. A batch of texts is encoded by both tokenizers. The byte ends of all A tokens and of all B tokens of the batch are two
   ascending lists, whose merge tells everything: every distinct end closes one overlap of an A and a B token, and every end
   that both have closes a group.
2. Merge path. The merge is cut at equally spaced diagonals; a binary search on each, all at once, finds how many A and how
   many B ends lie before it. The pieces have equal work whatever the texts, know nothing of each other, and emit overlaps
   and common ends. A common end that a cut parts is seen from its two sides; stitching drops the double one.
3. Overlaps are counted per chunk of texts as (B id, A id) pairs. Counts of the corpus are a partial aggregate over the
   chunks' pairs; the highest of each B id is another. They return to the chunks by one join per chunk and pair, so neither the
   documents' overlaps nor the counts of the corpus ever stand in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pathloom.llm.bpe import SPLIT, Vocabulary
from pathloom.llm.common import store

RUN_BYTES = 1 << 20
CHUNK_BYTES = 32 << 20
PIECE = 1 << 16
#: Unbroken runs beyond this go to the tokenizers library, whose time does not grow with their square.
LONG_RUN = 4096


class ByteTokens:
    """The byte-level BPE file's ids, without special tokens, and each id's bytes."""

    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        special = set(vocabulary.special.values())
        self.bytes = vocabulary.token_bytes
        self.path, self._whole = path, None
        ranks = {b: i for i, b in enumerate(self.bytes) if b and i not in special}
        self._fast = None
        # Ids that rise with the merges' order are ranks, which lets the quicker library read the same vocabulary.
        made = vocabulary.merges[:, 2]
        if len(made) and (np.diff(made) > 0).all() and set(vocabulary.byte_ids.tolist()) <= set(range(int(made[0]))) - {-1}:
            self._fast = tiktoken.Encoding("own", pat_str=SPLIT.pattern, mergeable_ranks=ranks, special_tokens={})
        self._long = regex.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")

    def __call__(self, texts: list[str]) -> list[Sequence[int]]:
        return [self._slow(t) if self._fast is None or len(t) >= LONG_RUN and self._long.search(t) else self._fast.encode_ordinary(t) for t in texts]

    def _slow(self, text: str) -> Sequence[int]:
        if self._whole is None:
            self._whole = Tokenizer.from_file(self.path)
            self._whole.no_truncation()
            self._whole.no_padding()
            self._whole.encode_special_tokens = True
        return self._whole.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """The piece model's ids and each id's bytes: U+2581 is a space, <0xHH> the byte HH."""

    def __init__(self, path: str):
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._piece(i) for i in range(self._model.get_piece_size())]

    def _piece(self, i: int) -> bytes:
        piece = self._model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, texts: list[str]) -> list[Sequence[int]]:
        return self._model.encode(texts, num_threads=1)


def merge_path(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """For each diagonal d the number of ``a`` among the first d of the merge of two ascending lists, equal ones of ``a`` first."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        other = diagonals - middle - 1
        # The merge takes a[middle] among its first d exactly if a[middle] <= b[d - middle - 1].
        taken = open_ & (a[np.minimum(middle, max(len(a) - 1, 0))] <= b[np.clip(other, 0, max(len(b) - 1, 0))])
        low, high = np.where(taken, middle + 1, low), np.where(open_ & ~taken, middle, high)
    return low


def merge_piece(a: np.ndarray, b: np.ndarray, at: tuple[int, int], to: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One piece: its distinct ends, the A and the B token that each closes or lies in, and whether both end there.

    Only ``a[at[0]:to[0]]`` and ``b[at[1]:to[1]]`` are merged; a token that ends beyond the piece is the next one after it.
    """
    ends = np.concatenate([a[at[0] : to[0]], b[at[1] : to[1]]])
    order = np.argsort(ends, kind="stable")
    ends, from_a = ends[order], order < to[0] - at[0]
    # Position after each merged end, in tokens of either side that end at or before it.
    n_a, n_b = at[0] + np.cumsum(from_a), at[1] + np.cumsum(~from_a)
    last = np.append(ends[1:] != ends[:-1], True) if len(ends) else np.zeros(0, bool)
    end, n_a, n_b = ends[last], n_a[last], n_b[last]
    a_ends, b_ends = (n_a > 0) & (a[n_a - 1] == end), (n_b > 0) & (b[n_b - 1] == end)
    return end, n_a - a_ends, n_b - b_ends, a_ends & b_ends


def align(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``end, A token, B token, both end`` of every overlap of two ascending lists of ends that reach the same last end."""
    total = len(a) + len(b)
    cuts = np.append(np.arange(0, total, piece), total)
    in_a = merge_path(a, b, cuts)
    corners = list(zip(in_a.tolist(), (cuts - in_a).tolist()))
    parts = [merge_piece(a, b, x, y) for x, y in zip(corners, corners[1:])]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    end, token_a, token_b, both = (np.concatenate(x) for x in zip(*parts))
    # A cut between equal ends leaves the first side's end alone in the piece before it: the later one knows both.
    keep = np.append(end[1:] != end[:-1], True)
    return end[keep], token_a[keep], token_b[keep], both[keep]


class Aligner:
    """Aligns runs of texts and gathers the chunk's distinct pairs of linked ids with their numbers."""

    def __init__(self, a: ByteTokens, b: PieceTokens):
        self.a, self.b = a, b
        self.size_a, self.size_b = (np.fromiter(map(len, x.bytes), np.int64, len(x.bytes)) for x in (a, b))
        # Decimal ids with what can follow them: the next id of the group, the other side, the next group.
        names_a, names_b = ([str(i) for i in range(len(x.bytes))] for x in (a, b))
        self.names = [f"{n},".encode() for n in names_a] + [f"{n}|".encode() for n in names_a] + [f"{n},".encode() for n in names_b] + [f"{n};".encode() for n in names_b]
        self.new_chunk()

    def new_chunk(self) -> None:
        self.known, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def pairs(self) -> np.ndarray:
        """The chunk's pairs, each at its place."""
        out = np.empty(len(self.known), np.int64)
        out[self.place] = self.known
        return out

    def _places(self, pairs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The places of distinct ascending ``pairs`` in the chunk's list, which takes in new ones."""
        at = np.searchsorted(self.known, pairs)
        old = np.append(self.known, -1)[at] == pairs
        self.place = np.insert(self.place, at[~old], np.arange(len(self.known), len(self.known) + int((~old).sum())))
        self.known = np.insert(self.known, at[~old], pairs[~old])
        place = self.place[np.searchsorted(self.known, pairs)]
        self.times = np.append(self.times, np.zeros(int((~old).sum()), np.int64))
        self.times[place] += times
        return place

    def _encode(self, texts: list[str]) -> tuple[list[Sequence[int]], list[Sequence[int]]]:
        """Ids of both sides; of texts that either side does not give back byte for byte, none."""
        whole = [" " + t if t else "" for t in texts]
        a, b = self.a(whole), self.b(texts)
        of_a, of_b = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        for i, t in enumerate(whole):
            raw = t.encode()
            if not t or b"".join(map(of_a, a[i])) != raw or b"".join(map(of_b, b[i])) != raw:
                a[i] = b[i] = ()
        return a, b

    def __call__(self, texts: list[str]) -> dict[str, pa.Array]:
        """Columns of a run of texts: counts, groups as text, and the distinct pairs by place with their numbers."""
        a, b = self._encode(texts)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        id_a, id_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        # Texts one after another: every text's last end is common, so no overlap crosses texts.
        end, in_a, in_b, both = align(np.cumsum(self.size_a[id_a]), np.cumsum(self.size_b[id_b]))
        first_a, first_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        n_texts = len(texts)
        text = np.searchsorted(first_a[1:], in_a, "right")
        n_links, n_groups = np.bincount(text, minlength=n_texts), np.bincount(text[both], minlength=n_texts)
        groups = self._groups(id_a, id_b, in_a[both], in_b[both], first_a + first_b)

        pair = (id_b[in_b] << 32) | id_a[in_a]
        found, place, times = np.unique(pair, return_inverse=True, return_counts=True)
        cell = text * max(len(found), 1) + place
        own, uses = np.unique(cell, return_counts=True)
        cells = self._places(found, times)[own % max(len(found), 1)] if len(found) else own
        first = np.concatenate([[0], np.cumsum(np.bincount(own // max(len(found), 1), minlength=n_texts))])
        lists = lambda values: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, pa.int32()))
        return {
            "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups), "n_links": pa.array(n_links),
            "groups": pa.array(groups, pa.string()), "cells": lists(cells), "uses": lists(uses),
        }

    def _groups(self, id_a: np.ndarray, id_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, first: np.ndarray) -> list[str]:
        """Each text's groups, ``a1,a2|b1;a3|b2,b3``; ``last_a`` and ``last_b`` are the tokens that close the groups."""
        upto_a, upto_b = last_a + 1, last_b + 1
        size_a, size_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        # A group's A tokens come after all B tokens of the groups before it, its B tokens after its own A tokens.
        name_a, name_b = id_a.copy(), id_b + 2 * len(self.size_a)
        name_a[last_a] += len(self.size_a)
        name_b[last_b] += len(self.size_b)
        names = np.empty(len(id_a) + len(id_b), np.int64)
        names[np.arange(len(id_a)) + np.repeat(upto_b - size_b, size_a)] = name_a
        names[np.arange(len(id_b)) + np.repeat(upto_a, size_b)] = name_b
        word, bounds = self.names.__getitem__, first.tolist()
        return [b"".join(map(word, names[x:y].tolist()))[:-1].decode() for x, y in zip(bounds, bounds[1:])]


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of whole texts of bounded size."""
    low, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield low, i
            low, held = i, 0
        held += n
    if sizes:
        yield low, len(sizes)


#: Rows of documents have no ``pairs``; a chunk's one row without a document holds its pairs and their numbers.
ALIGNED = [
    ("chunk", T.LongType()), ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups", T.StringType()),
    ("cells", T.ArrayType(T.IntegerType())), ("uses", T.ArrayType(T.IntegerType())), ("pairs", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.LongType())),
]


def _align_texts(a_path: str, b_path: str, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Aligner(ByteTokens(a_path), PieceTokens(b_path))
        chunk, held, kind = TaskContext.get().partitionId() << 32, 0, None

        def full(columns: dict[str, pa.Array], rows: pa.Array) -> pa.RecordBatch:
            n = len(rows)
            ready = {"row": rows, "chunk": pa.array(np.full(n, chunk))} | columns
            types = {"groups": pa.string(), "cells": pa.list_(pa.int32()), "uses": pa.list_(pa.int32()), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}
            names = ["row", *[name for name, _ in ALIGNED]]
            return pa.RecordBatch.from_arrays([ready[c] if c in ready else pa.nulls(n, types.get(c, pa.int64())) for c in names], names)

        def close() -> pa.RecordBatch:
            lists = lambda x: pa.array([x], pa.list_(pa.int64()))
            return full({"pairs": lists(work.pairs()), "times": lists(work.times)}, pa.nulls(1, kind))

        for batch in batches:
            kind = batch["row"].type
            texts = [t or "" for t in batch["text"].to_pylist()]
            for low, high in _runs([len(t) for t in texts], RUN_BYTES):
                yield full(work(texts[low:high]), batch["row"].slice(low, high - low))
                held += sum(map(len, texts[low:high]))
                if held >= chunk_bytes:
                    yield close()
                    work.new_chunk()
                    chunk, held = chunk + 1, 0
        if len(work.known):
            yield close()

    return run


def align_texts(
    docs: DataFrame, byte_bpe: str, piece_model: str, text_col: str = "text", carry: Sequence[str] = ("*",), chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Rows of documents and of chunks, see ``ALIGNED``; ``row`` holds the columns named in ``carry``."""
    work = docs.select(F.struct(*carry).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("row", work.schema["row"].dataType), *[T.StructField(n, t) for n, t in ALIGNED]])
    return work.mapInArrow(_align_texts(byte_bpe, piece_model, chunk_bytes), schema)


def count_links(aligned: DataFrame) -> DataFrame:
    """``of_chunk, place, count, best`` of every chunk's pairs: how often the corpus links the two ids, and whether no other
    A id is linked with that B id more often."""
    links = aligned.where("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "p"))
    links = links.select("chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    totals = links.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("id_b", F.shiftright("pair", 32))
    totals = store(totals)
    most = totals.groupBy("id_b").agg(F.max("count").alias("most"))
    judged = store(totals.join(most, "id_b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))
    return links.join(judged, "pair").select(F.col("chunk").alias("of_chunk"), "place", "count", "best")


def _score(key: tuple[pa.Scalar, ...], table: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's documents with the counts of its pairs."""
    place = counts["place"].to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = counts["count"].to_numpy(), counts["best"].to_numpy(zero_copy_only=False)
    n_best, sums = [], []
    for part in table.select(["cells", "uses"]).to_batches():
        lists = part["cells"]
        first = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        cell, uses = lists.flatten().to_numpy(), part["uses"].flatten().to_numpy().astype(np.int64)
        for out, values in ((n_best, best), (sums, count)):
            upto = np.concatenate([[0], np.cumsum(uses * values[cell])])
            out.append(np.diff(upto[first]))
    flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    kept = table.drop_columns(["chunk", "cells", "uses"])
    return kept.append_column("n_best", pa.array(flat(n_best))).append_column("count_sum", pa.array(flat(sums)))


def align_tokenizers(
    docs: DataFrame, byte_bpe: str, piece_model: str, text_col: str = "text", carry: Sequence[str] = ("*",),
    groups: Callable[[Column], Column] = lambda c: c, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Per row of ``docs``: ``row`` (its columns named in ``carry`` as one struct), ``n_a, n_b, n_groups, n_links, groups, n_best, count_sum``.

    A encodes a space and the text by the byte-level BPE file, B the text by the piece model, which puts that space before
    it. Offsets where tokens of both end cut them into ``groups``, as text: ``a1,a2|b1;a3|b2,b3``; the argument of that name says
    what of it is kept, such as a digest. Two tokens whose byte ranges overlap are linked. A pair of ids counts all links
    of the corpus between them; ``n_best`` are the links whose count is the highest of their B id, ties included, and
    ``count_sum`` adds the counts of all links.

    Defined cases: null and empty texts, and texts that one side does not give back byte for byte (such as those with
    U+2581), have no tokens: zeros and an empty ``groups``; special tokens' texts are plain text; a text is one unit, so a
    task holds the tokens of its longest text; its merge is cut into pieces of equal work all the same; repeated rows count once
    each; columns of any name may be present, as they stay inside ``row``; no rows give no rows.
    """
    aligned = align_texts(docs, byte_bpe, piece_model, text_col, carry, chunk_bytes)
    aligned = store(aligned.withColumn("groups", groups(F.col("groups"))))
    texts = aligned.where("pairs IS NULL").drop("pairs", "times")
    kept = [f for f in texts.schema.fields if f.name not in ("chunk", "cells", "uses")]
    schema = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    scored = texts.where("n_links > 0").groupBy("chunk").cogroup(count_links(aligned).groupBy("of_chunk")).applyInArrow(_score, schema)
    none = texts.where("n_links = 0").drop("chunk", "cells", "uses").select("*", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    return scored.unionByName(none)
