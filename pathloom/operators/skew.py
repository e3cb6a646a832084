"""Building blocks that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.session import stored

SALTS = 32


def salt_column(df: DataFrame, salts: int = SALTS) -> Column:
    """A salt that depends only on the row, so a retried task gives the same split."""
    simple = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    return F.pmod(F.xxhash64(*simple), F.lit(salts)).cast("int")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", salts: int = SALTS) -> DataFrame:
    """First ``k`` rows per key: per salted slice first, then over at most ``k * salts`` rows a key."""
    keys = list(keys)
    near = W.partitionBy(*keys, "__salt").orderBy(*order)
    far = W.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__salt", salt_column(df, salts))
        .withColumn("__near", F.row_number().over(near)).filter(F.col("__near") <= k).drop("__near", "__salt")
        .withColumn(rank, F.row_number().over(far)).filter(F.col(rank) <= k)
    )


def left_out(df: DataFrame, keys: Sequence[str], k: int, name: str = "omitted") -> DataFrame:
    """Keys with more than ``k`` rows, and how many a limit of ``k`` leaves out."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - k).alias(name)).filter(F.col(name) > 0)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key, the least (or greatest) by ``order``; a partial aggregate, so no hot task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    best = (F.max if last else F.min)(packed).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("__best")[c].alias(c) for c in [*order, *rest]])


def prefix_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], slices: int | None = None) -> DataFrame:
    """``df`` with running sums within ``keys``, in ascending ``order``; a running sum of ones numbers the rows.

    Rows equal in ``order`` follow their other columns from left to right, so only rows equal in everything are in no stated
    order. Rows are cut at ranges of (keys, order, other columns, row), so a key with most of the rows, or most of
    them under one order value, spans many slices. A slice's totals are summed over the slices before it, and one window runs
    inside each slice. Rows with null keys belong together.
    """
    keys, order = list(keys), list(order)
    rest = [c for c, t in df.dtypes if c not in [*keys, *order] and not t.startswith(("map", "variant"))]
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {f"__v{i}": v for i, v in enumerate(sums.values())}
    work = df.select("*", *[v.alias(c) for c, v in values.items()], F.monotonically_increasing_id().alias("__row"))
    # The slice a row got holds only in a written table.
    cut = stored(work.repartitionByRange(slices, *keys, *order, *rest, "__row").withColumn("__slice", F.spark_partition_id()))
    totals = cut.groupBy(*keys, "__slice").agg(*[F.sum(v).alias(v) for v in values])
    earlier = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*keys, "__slice"])], *[F.sum(v).over(earlier).alias(f"__b{v}") for v in values])
    inside = W.partitionBy(*keys, "__slice").orderBy(*order, *rest, "__row").rowsBetween(W.unboundedPreceding, 0)
    run = cut.select("*", *[F.sum(v).over(inside).alias(f"__r{v}") for v in values])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate([*keys, "__slice"])])
    kept = [c for c in df.columns if c not in sums]
    return run.join(before, same, "left").select(
        *kept, *[(F.coalesce(f"__b{v}", F.lit(0)) + F.coalesce(f"__r{v}", F.lit(0))).alias(n) for v, n in zip(values, sums)])


def prefix_sum(df: DataFrame, keys: Sequence[str], seq: str, value: Column | str, name: str, slices: int | None = None) -> DataFrame:
    """Running sum of ``value`` by ``seq`` within ``keys``, see ``prefix_scan``."""
    return prefix_scan(df, keys, [seq], {name: F.col(value) if isinstance(value, str) else value}, slices)


def count_distinct(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str) -> DataFrame:
    """Exact distinct count in two partial aggregates, so a hot key spreads over its values."""
    return df.select(*keys, *cols).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    Filters and joins on a projected column make the optimizer copy its expression below them; for long
    nested expressions each copy is evaluated again. A one-row generator is not copied.
    """
    kept = [c for c in df.columns if c not in columns]
    once = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__pin")
    return df.select("*", once).select(*kept, *[F.col("__pin")[n].alias(n) for n in columns])
