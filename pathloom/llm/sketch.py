"""A count-min sketch over a whole corpus that no machine has to hold.

Texts are dealt into chunks by hash. A chunk's local sketch is sparse: for each of ``depth`` rows the sorted cells it
touches with their counts, cut into blocks of the cell space and packed. One task per block adds up the local sketches and
gives each chunk the logarithm of the merged count for the cells it sent, in the order sent. A window's estimate is the
least over its rows. A chunk's counts are sent up to 255, so an estimate can be below a large true count, but it is at
least two wherever two documents hold the window, and that is what the operators' results rest on. Sizes follow the
corpus: cells in proportion to its bytes, chunks and blocks of bounded bytes, so no step broadcasts or gathers anything that grows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import text_bytes
from pathloom.llm.words import U64, mix

PACKED = "chunk long, block long, cells binary"
CHUNK_BYTES = 6 << 20


@dataclass(frozen=True)
class Shape:
    """``chunks`` of text; ``depth`` rows of 2**bits cells, each row cut into 2**block_bits blocks."""

    chunks: int
    depth: int
    bits: int
    block_bits: int

    @classmethod
    def of(cls, docs: DataFrame, depth: int = 2, cells_per_window: int = 8, chunk_bytes: int = CHUNK_BYTES) -> "Shape":
        """Sized by the bytes of the texts, at about six bytes a word."""
        size = text_bytes(docs)
        chunks = max(1, min(64, size >> 18), -(-size // chunk_bytes))
        bits = max(16, (cells_per_window * size // 6).bit_length())
        return cls(chunks, depth, bits, min(bits, max(0, (chunks // depth).bit_length())))


def chunked(docs: DataFrame, shape: Shape) -> DataFrame:
    """``docs`` with a ``chunk`` that depends on the row alone, so every pass sees the same chunks."""
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shape.chunks)))


def pack(values: np.ndarray, extra: np.ndarray) -> bytes:
    """Ascending ``values`` as compressed differences, with one byte each of ``extra``."""
    gaps = np.diff(values, prepend=values[:1] * 0)
    width = next(w for w in (1, 2, 4, 8) if int(gaps.max(initial=0)) < 1 << (8 * w))
    planes = gaps.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return struct.pack("<QB", len(values), width) + pa.compress(planes.tobytes() + extra.astype(np.uint8).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    count, width = struct.unpack_from("<QB", data)
    raw = np.frombuffer(pa.decompress(data[9:], count * (width + 1), codec="zstd", asbytes=True), np.uint8)
    gaps = np.ascontiguousarray(raw[: count * width].reshape(width, count).T).view(f"<u{width}").ravel()
    return np.cumsum(gaps, dtype=np.uint64), raw[count * width :]


def squeeze(first: np.ndarray, *others: np.ndarray) -> bytes:
    """Arrays of 64-bit words of one length, the first ascending: its differences and the others, byte by byte, compressed."""
    rows = [np.diff(first, prepend=U64(0)), *others]
    planes = np.stack([r.view(np.uint8).reshape(-1, 8).T for r in rows])
    return struct.pack("<Q", len(first)) + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, arrays: int) -> np.ndarray:
    """The arrays of ``squeeze`` as rows of unsigned words."""
    (count,) = struct.unpack_from("<Q", data)
    raw = np.frombuffer(pa.decompress(data[8:], count * 8 * arrays, codec="zstd", asbytes=True), np.uint8)
    out = raw.reshape(arrays, 8, count).transpose(0, 2, 1).copy().view(U64).reshape(arrays, count)
    out[0] = np.cumsum(out[0], dtype=U64)
    return out


def cells(keys: np.ndarray, shape: Shape, row: int) -> np.ndarray:
    salted = keys if row == 0 else mix(keys + U64((row * 0x9FB21C651E98DF25) & 0xFFFFFFFFFFFFFFFF))
    return salted >> U64(64 - shape.bits)


def local_cells(keys: np.ndarray, counts: np.ndarray, shape: Shape, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct cells of ``row`` ascending, their counts, and for each key the place of its cell."""
    cell = cells(keys, shape, row)
    order = np.argsort(cell)
    ordered = cell[order]
    first = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))
    return ordered[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0], place


def local_sketch(chunk: int, keys: np.ndarray, counts: np.ndarray, shape: Shape) -> Iterator[dict]:
    """The packed blocks of a chunk's distinct ``keys`` with their counts."""
    within = shape.bits - shape.block_bits
    for row in range(shape.depth):
        cell, count, _ = local_cells(keys, counts, shape, row)
        edges = np.searchsorted(cell >> U64(within), np.arange((1 << shape.block_bits) + 1, dtype=U64))
        for block in np.flatnonzero(np.diff(edges)):
            part = slice(edges[block], edges[block + 1])
            offsets = cell[part] & U64((1 << within) - 1)
            yield {"chunk": chunk, "block": (row << shape.block_bits) + int(block), "cells": pack(offsets, np.minimum(count[part], 255))}


def packed_table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=pa.schema([("chunk", pa.int64()), ("block", pa.int64()), ("cells", pa.binary())]))


def _merge(table: pa.Table) -> pa.Table:
    """All local sketches of one block: every chunk gets floor(log2(merged count)) of the cells it sent, in its order."""
    rows = table.to_pylist()
    parts = [unpack(r["cells"]) for r in rows]
    cell, count = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(cell)
    ordered = cell[order]
    first = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))
    total = np.add.reduceat(count[order].astype(np.int64), first)
    level = np.empty(len(cell), np.uint8)
    level[order] = np.repeat(np.log2(total).astype(np.uint8), np.diff(first, append=len(cell)))
    at = np.cumsum([0, *[len(p[0]) for p in parts]])
    return packed_table([r | {"cells": pa.compress(level[a:b].tobytes(), codec="zstd", asbytes=True)} for r, a, b in zip(rows, at, at[1:])])


def merged(local: DataFrame) -> DataFrame:
    """Local sketches in, per chunk and block the levels of its cells out."""
    return local.groupBy("block").applyInArrow(_merge, PACKED)


def levels(back: pa.Table, keys: np.ndarray, counts: np.ndarray, shape: Shape) -> np.ndarray:
    """floor(log2(estimated count)) of each key: 0 for keys surely held once."""
    returned: dict[int, bytes] = dict(zip(back["block"].to_pylist(), back["cells"].to_pylist()))
    least = np.full(len(keys), 255, np.uint8)
    within = shape.bits - shape.block_bits
    for row in range(shape.depth):
        cell, _, place = local_cells(keys, counts, shape, row)
        edges = np.searchsorted(cell >> U64(within), np.arange((1 << shape.block_bits) + 1, dtype=U64))
        level = np.empty(len(cell), np.uint8)
        for block in np.flatnonzero(np.diff(edges)):
            size = int(edges[block + 1] - edges[block])
            raw = pa.decompress(returned[(row << shape.block_bits) + int(block)], size, codec="zstd", asbytes=True)
            level[edges[block] : edges[block + 1]] = np.frombuffer(raw, np.uint8)
        np.minimum(least, level[place], out=least)
    return least
