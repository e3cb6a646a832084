"""Exact top-k inner products, block at a time.

Vectors become integers, their dimensions are the terms. Every row gets a number, and rows are dealt by its hash into shards of
bounded rows. A shard orders its rows by likeness, around a few of them, and is cut into blocks of neighbours, each with its
forward index (an integer matrix) and the greatest and least value of every term. A query meets a shard as part of a query
block: the shard's blocks are ordered by the sum of term maxima, and scored until the best sum left cannot enter the query's
k best. The shards' lists, k rows a query and shard, are merged by rank. How much the bounds spare is up to the vectors: much
where they lie in groups, nothing where they point anywhere alike.
"""

from __future__ import annotations

from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import store

SHARD_ROWS = 16384
QUERY_ROWS = 1024
BLOCK_ROWS = 256
PIVOTS = 64
LONG = np.iinfo(np.int64)
#: ``beyond`` orders scores that no long can tell apart.
FOUND = "query_row long, query_id long, vec_id long, score long, beyond binary, blocks_scored long, blocks long"


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``row, vec_id, v`` with v = floor(scale * x) as long; rows without a vector or with a component that is no finite number drop."""
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("v").isNotNull() & ~odd)
        .select("row", "vec_id", F.transform("v", lambda x: F.floor(F.lit(scale) * x)).alias("v"))
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows as one integer matrix, short vectors padded with zeros."""
    rows = column.combine_chunks()
    lengths = np.asarray(pc.list_value_length(rows), np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.asarray(rows.flatten(), np.int64)
    return out


def _fit(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def likeness(vectors: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """An order in which rows near the same one of ``pivots`` evenly chosen rows stand together, nearest first."""
    own = vectors.astype(np.float64)
    some = own[np.linspace(0, len(own) - 1, min(pivots, len(own))).astype(np.int64)]
    far = (some**2).sum(axis=1) - 2 * own @ some.T
    nearest = far.argmin(axis=1)
    return np.lexsort((far[np.arange(len(own)), nearest] + (own**2).sum(axis=1), nearest))


def _best(score: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, greater scores first, smaller ids on ties; missing candidates are -inf."""
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (score, ids, places))


def _bounds(queries: np.ndarray, vectors: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the blocks start, and the greatest score each query can have with a row of each block."""
    starts = np.arange(0, len(vectors), block_rows)
    greatest, least = np.maximum.reduceat(vectors, starts), np.minimum.reduceat(vectors, starts)
    return starts, np.maximum(queries, 0) @ greatest.T + np.minimum(queries, 0) @ least.T


def search_shard(
    query_rows: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, block_rows: int = BLOCK_ROWS,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """k best (score, place among ``rows``) per query over one shard, and how many of its blocks each query scored.

    Only a query's own row is no candidate. Products are float64, so they must be below 2**53.
    """
    order = likeness(vectors)
    rows, ids, vectors, queries = rows[order], ids[order], vectors[order].astype(np.float64), queries.astype(np.float64)
    starts, bound = _bounds(queries, vectors, block_rows)
    turn = np.argsort(-bound, axis=1, kind="stable")
    score, found, places = np.full((len(queries), k), -np.inf), np.full((len(queries), k), LONG.max), np.full((len(queries), k), -1)
    scored, live = np.zeros(len(queries), np.int64), np.arange(len(queries))
    for step in range(len(starts)):
        block = turn[live, step]
        # Equal to the kth score is not below it: a smaller id may still win the tie.
        open_ = bound[live, block] >= score[live, -1]
        live, block = live[open_], block[open_]
        if not len(live):
            break
        scored[live] += 1
        for b in np.unique(block):
            mine = live[block == b]
            part = slice(starts[b], starts[b] + block_rows)
            got = queries[mine] @ vectors[part].T
            got[query_rows[mine][:, None] == rows[part][None, :]] = -np.inf
            enters = (got >= score[mine, -1:]).any(axis=1)
            mine, got = mine[enters], got[enters]
            new = [np.broadcast_to(x, got.shape) for x in (ids[part], order[part])]
            score[mine], found[mine], places[mine] = _best(
                np.concatenate([score[mine], got], axis=1), np.concatenate([found[mine], new[0]], axis=1), np.concatenate([places[mine], new[1]], axis=1), k)
    return score, np.where(score > -np.inf, places, -1), scored, len(starts)


def search_shard_large(
    query_rows: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, block_rows: int = BLOCK_ROWS,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """:func:`search_shard` in integers of any size, a query at a time."""
    order = likeness(vectors)
    rows, ids, vectors, queries = rows[order], ids[order], vectors[order].astype(object), queries.astype(object)
    starts, bound = _bounds(queries, vectors, block_rows)
    score, places, scored = np.full((len(queries), k), 0, object), np.full((len(queries), k), -1), np.zeros(len(queries), np.int64)
    for q in range(len(queries)):
        heap: list[tuple[int, int, int]] = []
        for b in sorted(range(len(starts)), key=lambda b: -bound[q, b]):
            if len(heap) == k and bound[q, b] < heap[0][0]:
                break
            scored[q] += 1
            for i in range(starts[b], min(starts[b] + block_rows, len(rows))):
                if rows[i] != query_rows[q]:
                    entry = (int(queries[q] @ vectors[i]), -int(ids[i]), int(order[i]))
                    if len(heap) < k:
                        heappush(heap, entry)
                    elif entry[:2] > heap[0][:2]:
                        heapreplace(heap, entry)
        for rank, (value, _, place) in enumerate(sorted(heap, key=lambda e: (-e[0], -e[1]))):
            score[q, rank], places[q, rank] = value, place
    return score, places, scored, len(starts)


def _within_long(scores: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Scores as the nearest longs, and where that is the greatest or least of all a key that orders the scores themselves."""
    if scores.dtype != object:
        return pa.array(scores.astype(np.int64)), pa.nulls(len(scores), pa.binary())
    near = [min(max(x, int(LONG.min)), int(LONG.max)) for x in scores.tolist()]
    beyond = [(x + (1 << 255)).to_bytes(32) if n in (LONG.min, LONG.max) else None for x, n in zip(scores.tolist(), near)]
    return pa.array(near, pa.int64()), pa.array(beyond, pa.binary())


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("query_row", "query_id", "vec_id", "score", "beyond", "blocks_scored", "blocks")
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], pa.binary() if n == "beyond" else pa.int64()) for n in names})
        queries, vectors = _matrix(left["v"]), _matrix(right["w"])
        width = max(queries.shape[1], vectors.shape[1])
        queries, vectors = _fit(queries, width), _fit(vectors, width)
        largest = [max(abs(int(m.min(initial=0))), int(m.max(initial=0))) for m in (queries, vectors)]
        search = search_shard if width * largest[0] * largest[1] < 1 << 53 else search_shard_large
        query_rows, doc = left["row"].to_numpy(), right["doc"].combine_chunks()
        # Among equal scores a row without an id comes last.
        score, places, scored, blocks = search(query_rows, queries, right["doc_row"].to_numpy(), doc.fill_null(LONG.max).to_numpy(), vectors, k)
        at, rank = np.nonzero(places >= 0)
        return pa.table([
            pa.array(query_rows[at]), left["vec_id"].combine_chunks().take(pa.array(at)), doc.take(pa.array(places[at, rank])),
            *_within_long(score[at, rank]), pa.array(scored[at]), pa.array(np.full(len(at), blocks))], names=names)

    return run


def top_k_search(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score, blocks_scored, blocks``: for each row whose id is divisible by ``every``, the ``k``
    greatest integer inner products with all other rows (all, if fewer), ties to the smaller id.

    Components become floor(``scale`` * x). The last two columns tell how many of the blocks of the shard that gave
    the row were scored for that query.

    Defined cases: vectors that are null or hold a null or a number that is not finite take no part; shorter vectors count as
    padded with zeros, empty ones score 0; rows that repeat an id, or have none, are candidates each, a null id after all
    others on ties, and each row whose id is divisible is a query of its own; scores of any size are compared exactly, and
    those beyond a long are reported as the nearest long; no rows give no rows.
    """
    ready = store(quantized(vectors, id_col, vector_col, scale))
    rows = ready.count()
    shards, blocks = max(1, -(-rows // shard_rows)), max(1, -(-rows // (every * query_rows)))
    own = {"block": F.pmod(F.xxhash64("row"), F.lit(blocks)), "shard": F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards))}
    queries = ready.where(F.col("vec_id") % every == 0).select("*", own["block"].alias("block"), _each(shards).alias("shard"))
    shard = ready.select(
        F.col("row").alias("doc_row"), F.col("vec_id").alias("doc"), F.col("v").alias("w"), _each(blocks).alias("block"), own["shard"].alias("shard"))
    met = queries.groupBy("block", "shard").cogroup(shard.groupBy("block", "shard")).applyInArrow(_search(k), FOUND)
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), F.desc("beyond"), F.asc_nulls_last("vec_id")))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "blocks_scored", "blocks")


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
