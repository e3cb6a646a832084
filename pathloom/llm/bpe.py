"""Byte-level BPE by a minimal acyclic transducer.

The frequent words of the corpus are encoded once and compiled into a minimal acyclic automaton: words share prefixes and
suffixes, and the numbers on the edges of a word's path add up to its place among the words, which leads to its ids.
The automaton, the merges and the tokens' bytes are one file of flat arrays that Spark ships to every executor and all its
workers map into memory. A batch's distinct words run through the automaton together; words it lacks are merged exactly.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections import Counter
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import store
from pathloom.llm.decontaminate import ragged

#: Fixed value: how byte-level BPE cuts a text into words.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
BATCH_CHARS = 1 << 20
#: Longer words stay out of the lexicon, so the driver holds at most ``frequent`` times this many bytes of words.
LISTED_BYTES = 64


def byte_letters() -> dict[str, int]:
    """The visible letter that stands for each byte in byte-level vocabularies: printable Latin-1 as is, others from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens' bytes by id, the rank and result of each merge of two ids, and the special tokens, of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        self.byte_ids = np.full(256, -1, np.int64)
        for letter, b in letters.items():
            if letter in vocab:
                self.byte_ids[b] = vocab[letter]


NO_RANK = np.int32(np.iinfo(np.int32).max)
SHORT_BYTES = 64


class Merger:
    """Exact BPE: the lowest-ranked neighbouring pair of a word merges first, the leftmost of equals.

    Short words take their merges together, one a step, as rows of a matrix; long ones go one by one with a heap.
    """

    def __init__(self, byte_ids: np.ndarray, merges: np.ndarray):
        self.byte_ids = np.asarray(byte_ids, np.int64)
        keys = (merges[:, 0] << 32) | merges[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = np.append(keys[order], -1), np.append(order.astype(np.int32), NO_RANK), np.append(merges[order, 2], -1)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.merges = merges

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair of ids among the merges, the last one (which is none) if they do not merge."""
        wanted = (a << 32) | b
        at = np.searchsorted(self.keys[:-1], wanted)
        return np.where(self.keys[at] == wanted, at, len(self.keys) - 1)

    def __call__(self, words: Sequence[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 8), (8, 16), (16, SHORT_BYTES)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in np.array_split(rows, len(rows) // 20000 + 1):
                for i, ids in zip(part.tolist(), self._together([words[i] for i in part.tolist()])):
                    out[i] = ids
        for i in np.flatnonzero(sizes > SHORT_BYTES).tolist():
            out[i] = self._long([x for x in self.byte_ids[np.frombuffer(words[i], np.uint8)].tolist() if x >= 0])
        return out

    def _together(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        width = max(map(len, words)) + 1
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.where(np.arange(width) < sizes[:, None], self.byte_ids[raw], -1)
        for i in np.flatnonzero((ids < 0).sum(axis=1) > width - sizes).tolist():  # bytes the vocabulary lacks fall out
            kept = ids[i][ids[i] >= 0]
            ids[i] = -1
            ids[i, : len(kept)] = kept
            sizes[i] = len(kept)
        done, live = ids.copy(), np.arange(len(words))
        pair = self._pairs(ids[:, :-1], ids[:, 1:])
        column = np.arange(width)
        while len(live):
            rank = self.ranks[pair]
            best = rank.argmin(axis=1)
            row = np.arange(len(live))
            merges = rank[row, best] != NO_RANK
            done[live[~merges]] = ids[~merges]
            live, ids, pair, best = live[merges], ids[merges], pair[merges], best[merges]
            if not len(live):
                break
            row = np.arange(len(live))
            ids[row, best] = self.made[pair[row, best]]
            # Everything after the merged pair moves up by one.
            later = np.minimum(column + (column > best[:, None]), width - 1)
            ids = np.take_along_axis(ids, later, 1)
            ids[:, -1] = -1
            pair = np.take_along_axis(pair, np.minimum(later[:, : width - 1], width - 2), 1)
            pair[:, -1] = len(self.keys) - 1
            pair[row, best] = self._pairs(ids[row, best], ids[row, np.minimum(best + 1, width - 1)])
            before = np.maximum(best - 1, 0)
            joined = self._pairs(ids[row, before], ids[row, before + 1])
            pair[row, before] = np.where(best > 0, joined, pair[row, before])
        counts = (done >= 0).sum(axis=1)
        return [r[:n] for r, n in zip(done.tolist(), counts.tolist())]

    def _long(self, ids: list[int]) -> list[int]:
        """A heap of pairs and a linked list, for words of any length."""
        if not self.rank:
            self.rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(self.merges.tolist())}
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        heap = [(*self.rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heap = [(r, i, c, p) for r, c, i, p in heap]
        heapify(heap)
        live = [True] * len(ids)
        while heap:
            _, i, made, pair = heappop(heap)
            j = after[i] if live[i] else -1
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], live[j] = made, False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (pair := (ids[left], ids[after[left]])) in self.rank:
                    rank, made = self.rank[pair]
                    heappush(heap, (rank, left, made, pair))
        return [x for x, keep in zip(ids, live) if keep]


def compile_words(words: Sequence[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of ascending distinct ``words``, built one word at a time.

    States past the end of the common prefix with the next word can no longer change, so each is replaced by an equal
    state met before. ``edge_key`` (state * 256 + byte, ascending), ``edge_to`` and ``edge_add``: the adds along a word's
    path sum to its place in ``words``; ``final`` marks the states where words end; ``root``.
    """
    known: dict[tuple, int] = {}
    edges: list[tuple] = []
    open_: list[list] = [[False, []]]  # states of the last word's path: [final, [(byte, state), ...]]
    last = b""

    def settle(down_to: int) -> None:
        while len(open_) > down_to + 1:
            final, out = open_.pop()
            state = (final, *out)
            if state not in known:
                known[state] = len(edges)
                edges.append(state)
            open_[-1][1].append((last[len(open_) - 1], known[state]))

    for word in words:
        common = len(os.path.commonprefix([word, last]))
        settle(common)
        open_.extend([False, []] for _ in word[common:])
        open_[len(word)][0] = True
        last = word
    settle(0)
    edges.append((open_[0][0], *open_[0][1]))
    below = np.zeros(len(edges), np.int64)
    key, to, add = [], [], []
    for state, (final, *out) in enumerate(edges):
        total = int(final)
        for byte, target in out:
            key.append(state * 256 + byte)
            to.append(target)
            add.append(total)
            total += int(below[target])
        below[state] = total
    return {
        "edge_key": np.array(key, np.int64), "edge_to": np.array(to, np.int64), "edge_add": np.array(add, np.int64),
        "final": np.array([e[0] for e in edges], np.uint8), "root": np.array([len(edges) - 1], np.int64),
    }


def find_places(lexicon: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The place of each word in the lexicon, or -1; all words take their steps together."""
    state, place = np.full(len(starts), int(lexicon["root"][0])), np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))
    keys = lexicon["edge_key"]
    for step in range(int(lengths.max(initial=0))):
        live = live[lengths[live] > step]
        wanted = state[live] * 256 + data[starts[live] + step]
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        known = keys[at] == wanted if len(keys) else np.zeros(len(live), bool)
        place[live[~known]] = -1
        lengths = np.where(place < 0, 0, lengths)
        live, at = live[known], at[known]
        place[live] += lexicon["edge_add"][at]
        state[live] = lexicon["edge_to"][at]
    ends = (place >= 0) & (lexicon["final"][state] == 1)
    return np.where(ends, place, -1)


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one after another, each from a multiple of 8 bytes, with their places as JSON in front."""
    at, head = 0, {}
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 8) * 8
    front = json.dumps(head).encode()
    front += b" " * (-(len(front) + 8) % 8)
    with open(path, "wb") as f:
        f.write(len(front).to_bytes(8, "little") + front)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


def map_arrays(path: str) -> dict[str, np.ndarray]:
    raw = np.memmap(path, np.uint8, "r")
    front = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + front].tobytes())
    return {n: raw[8 + front + at : 8 + front + at + np.dtype(t).itemsize * size].view(t) for n, (t, size, at) in head.items()}


def _pieces(text: str, special: regex.Pattern | None) -> list[str]:
    """The words of a text, special tokens whole."""
    if special is None or not special.search(text):
        return SPLIT.findall(text)
    out = []
    for i, part in enumerate(special.split(text)):
        out += [part] if i % 2 else SPLIT.findall(part)
    return out


def _special(names: Sequence[str]) -> regex.Pattern | None:
    return regex.compile("(" + "|".join(map(regex.escape, sorted(names, key=len, reverse=True))) + ")") if names else None


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of whole texts of bounded characters."""
    low, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > BATCH_CHARS:
            yield low, i
            low, held = i, 0
        held += len(t)
    if texts:
        yield low, len(texts)


def count_words(docs: DataFrame, special: Sequence[str]) -> DataFrame:
    """``word, count`` over all texts of ``docs(text)``; each task sends a word once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _special(special)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            counts: Counter[str] = Counter()
            for t in texts:
                counts.update(_pieces(t, cut))
            for name in special:
                counts.pop(name, None)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "count"])

    return docs.select("text").mapInArrow(run, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def frequent_words(counted: DataFrame, most: int, steps: int = 64, longest: int = LISTED_BYTES) -> list[str]:
    """At most ``most`` words of up to ``longest`` bytes, from the greatest counts down, cut between two steps of the counts' logarithm.

    A histogram of that logarithm (``steps`` to a factor e) finds the cut, so only the words above it are collected.
    """
    again = store(counted.where((F.col("count") > 1) & (F.octet_length("word") <= longest)).withColumn("step", F.floor(F.log("count") * steps).cast("int")))
    cut, held = None, 0
    for r in sorted(again.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        held += r["count"]
        if held > most:
            break
        cut = r["step"]
    return [] if cut is None else [r["word"] for r in again.where(F.col("step") >= cut).select("word").collect()]


def build_lexicon(vocabulary: Vocabulary, words: Sequence[str]) -> dict[str, np.ndarray]:
    """The arrays of the lexicon file: automaton, ids by word, tokens' bytes, merges."""
    merge = Merger(vocabulary.byte_ids, vocabulary.merges)
    raw = sorted({w.encode() for w in words if w})
    ids = merge(raw)
    text = vocabulary.token_bytes
    return compile_words(raw) | {
        "word_first": np.cumsum([0, *map(len, ids)], dtype=np.int64), "word_ids": np.array(list(chain.from_iterable(ids)), np.int32),
        "token_first": np.cumsum([0, *map(len, text)], dtype=np.int64), "token_bytes": np.frombuffer(b"".join(text), np.uint8),
        "byte_ids": vocabulary.byte_ids, "merges": vocabulary.merges.ravel(),
    }


def ship(spark: SparkSession, arrays: dict[str, np.ndarray]) -> str:
    """Hand the lexicon file to Spark, which copies it to every executor, also to ones that join later; its name there.

    The name is the digest of the contents, and equal contents keep one place on the driver, as Spark takes a name from
    one place only.
    """
    folder = os.path.join(tempfile.gettempdir(), f"pathloom-lexicons-{os.getpid()}")
    os.makedirs(folder, exist_ok=True)
    handle, draft = tempfile.mkstemp(dir=folder)
    os.close(handle)
    write_arrays(draft, arrays)
    with open(draft, "rb") as f:
        path = os.path.join(folder, f"lexicon-{hashlib.sha256(f.read()).hexdigest()[:32]}.bin")
    os.replace(draft, path)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


class Coder:
    """Encodes and decodes batches of texts with a mapped lexicon; remembers the ids of words it met, up to a bound."""

    def __init__(self, lexicon: dict[str, np.ndarray], special: dict[str, int], remember: int = 1 << 18):
        self.lexicon, self.special, self.cut, self.remember = lexicon, special, _special(list(special)), remember
        self.merge = Merger(lexicon["byte_ids"], lexicon["merges"].reshape(-1, 3))
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first) of distinct words: the automaton's, or merged."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(lengths) - lengths
        place = find_places(self.lexicon, np.frombuffer(b"".join(raw), np.uint8), starts, lengths)
        place[[i for i, w in enumerate(words) if w in self.special]] = -1
        first, flat = self.lexicon["word_first"], self.lexicon["word_ids"]
        known = place >= 0
        size = np.where(known, first[place + 1] - first[place], 0)
        rest = np.flatnonzero(~known)
        own = self.merge([raw[i] for i in rest.tolist()])
        for k, i in enumerate(rest.tolist()):
            if words[i] in self.special:
                own[k] = [self.special[words[i]]]
        size[rest] = np.fromiter(map(len, own), np.int64, len(own))
        begin = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), np.int32)
        at = np.flatnonzero(known)
        ids[ragged(begin[at], size[at])] = flat[ragged(first[place[at]], size[at])]
        ids[ragged(begin[rest], size[rest])] = np.fromiter(chain.from_iterable(own), np.int32)
        return ids, np.append(begin, len(ids))

    def _learn(self, words: dict[str, None]) -> None:
        """Add the ids of words not met before; beyond the bound, start again from these."""
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > self.remember:
            self._forget()
            new = list(words)
        if new:
            ids, first = self._ids_of(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.first = np.concatenate([self.first, first[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end)."""
        split = [_pieces(t, self.cut) for t in texts]
        self._learn(dict.fromkeys(chain.from_iterable(split)))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        word = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        sizes = self.first[word + 1] - self.first[word]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[ragged(self.first[word], sizes)], ends[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts of runs of ids: the tokens' bytes in a row, read as UTF-8."""
        begin = self.lexicon["token_first"]
        sizes = begin[ids.astype(np.int64) + 1] - begin[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])[first]
        data = self.lexicon["token_bytes"][ragged(begin[ids], sizes)].tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def _coder(name: str, special: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(map_arrays(SparkFiles.get(name)), special)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for low, high in _runs(texts):
                ids, first = coder.encode(texts[low:high])
                out = [
                    batch["row"].slice(low, high - low), pa.array(np.diff(first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())), pa.array(coder.decode(ids, first), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(out, ["row", "n_tokens", "ids", "decoded"])

    return run


def encode_and_decode(
    docs: DataFrame, tokenizer_path: str, text_col: str = "text", carry: Sequence[str] = ("*",), frequent: int = 1 << 17,
) -> DataFrame:
    """Per row of ``docs``: ``row`` (its columns named in ``carry`` as one struct), ``n_tokens, ids, decoded``.

    ``ids`` are those of the byte-level BPE file at ``tokenizer_path`` without added tokens; a special token's text is that
    token. ``decoded`` are the tokens' bytes as text. Words are counted over the whole corpus and the ``frequent`` most
    frequent ones, as far as they occur twice and have at most ``LISTED_BYTES`` bytes, form the lexicon: its size changes the time, never the ids, as all other
    words are merged exactly.

    Defined cases: a null text is empty; an empty one has no ids and decodes to itself; words of any length merge
    exactly; words of about equal counts enter the lexicon together or not at all; repeated rows get equal results; columns of any
    name may be present, as they stay inside ``row``; no rows give no rows.
    """
    vocabulary = Vocabulary(tokenizer_path)
    work = docs.select(F.struct(*carry).alias("row"), F.col(text_col).cast("string").alias("text"))
    lexicon = build_lexicon(vocabulary, frequent_words(count_words(work, list(vocabulary.special)), frequent))
    name = ship(docs.sparkSession, lexicon)
    schema = T.StructType([
        work.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()),
    ])
    return work.mapInArrow(_coder(name, vocabulary.special), schema)
