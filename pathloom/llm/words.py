"""Words and word windows of Arrow text batches as numpy arrays: boundaries, 64-bit hashes, window hashes.

All classes of bytes used here are ASCII, so working on UTF-8 bytes gives the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
SLICE_BYTES = 2 << 20
#: Longer words are hashed one by one.
LONG_WORD = 64


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for bytes outside the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = False
    return table


#: Words ``[^\x20\x09-\x0D]+`` and, of lower-cased text, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
LETTERS_DIGITS = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of ``x`` over the whole word (a 64-bit finalizer; one-to-one)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: The first n bytes of a little-endian word.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)
_SALTS = ((U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)), (U64(0xC2B2AE3D27D4EB4F), U64(0xA24BAED4963EE407)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of ``data[starts:ends]``, eight bytes a step, each step a one-to-one mixing of what came before.

    Words of one length up to eight bytes never share a hash; other words do so by chance only, about once in 2**64 pairs,
    and independently under the two seeds.
    """
    salt, factor = _SALTS[seed]
    lengths = ends - starts
    out = mix(lengths.astype(U64) + salt)
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", raw, strides=(1,))
    live, step = np.arange(len(starts)) if lengths.max(initial=0) <= LONG_WORD else np.flatnonzero(lengths <= LONG_WORD), 0
    while len(live):
        left = lengths[live] - step
        out[live] = mix((out[live] ^ (eight[starts[live] + step] & _FIRST[np.minimum(left, 8)])) * factor)
        live, step = live[left > 8], step + 8
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), int(salt))
    return out


@dataclass
class Words:
    """Words of consecutive texts: byte ``starts`` and ``ends`` in ``data``, and ``first[i]:first[i+1]`` for text i.

    ``hashes`` and ``second`` are two independent hashes of each word, of its letters in lower case if ``fold``.
    """

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    fold: bool = False

    @cached_property
    def hashes(self) -> np.ndarray:
        return word_hashes(self.hashed, self.starts, self.ends)

    @cached_property
    def second(self) -> np.ndarray:
        return word_hashes(self.hashed, self.starts, self.ends, seed=1)

    @cached_property
    def hashed(self) -> np.ndarray:
        return _FOLD[self.data] if self.fold else self.data

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_slices(column: pa.ChunkedArray | pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row from, row to, bytes, offsets) of runs of whole texts of about ``max_bytes``; a null is an empty text."""
    base = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = pc.fill_null(chunk.cast(pa.large_string()), "")
        if not len(chunk):
            continue
        offsets = np.frombuffer(chunk.buffers()[1], dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = chunk.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(chunk):
            to = int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1
            to = min(max(to, row + 1), len(chunk))
            yield base + row, base + to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
            row = to
        base += len(chunk)


def find_words(data: np.ndarray, offsets: np.ndarray, wordish: np.ndarray, fold: bool = False) -> Words:
    """Maximal runs of ``wordish`` bytes; hashes ignore the case of A-Z when ``fold``."""
    inside = wordish[data]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), fold)


def windows(words: Words, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, text, length) of every run of ``size`` words; with ``short``, a text of 1 to size-1 words is one run."""
    counts = words.counts
    per_text = np.maximum(counts - size + 1, 0)
    if short:
        per_text = np.where((counts > 0) & (counts < size), 1, per_text)
    text = np.repeat(np.arange(len(counts)), per_text)
    begin = np.cumsum(per_text) - per_text
    at = np.arange(per_text.sum()) - np.repeat(begin, per_text) + np.repeat(words.first[:-1], per_text)
    return at, text, np.minimum(np.repeat(counts, per_text), size)


def window_hash(hashes: np.ndarray, at: np.ndarray, length: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of the word sequence from ``at``. Two seeds over a word's two hashes give an independent 128 bits."""
    factor = U64((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[seed])
    full = len(hashes) - size + 1
    whole = np.zeros(max(full, 0), U64)
    for i in range(size if full > 0 else 0):
        whole *= factor
        whole += hashes[i : i + full]
    if full > 0 and (length == size).all():
        out = whole[at]
    else:
        out = np.zeros(len(at), U64)
        long = length == size
        out[long] = whole[at[long]] if long.any() else 0
        rest = np.flatnonzero(~long)
        for i in range(size - 1):
            live = rest[length[rest] > i]
            out[live] = out[live] * factor + hashes[at[live] + i]
    return mix(out + length.astype(U64) * U64(0xE7037ED1A0B428DB))
