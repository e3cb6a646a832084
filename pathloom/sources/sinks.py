"""Writers with a fixed order, and the union of earlier result sets."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.skew import first_by
from pathloom.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/pathloom-{name}-{uuid.uuid4().hex}"


def write_jsonl(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """JSONL parts in global ``order``; nulls are written out."""
    df.orderBy(*order).write.option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, fields: Sequence[str], order: Sequence[str]) -> None:
    df.orderBy(*order).select(*fields).write.option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row (or few-row) summary as pretty JSON objects."""
    df.coalesce(1).write.option("pretty", True).option("ignoreNullFields", False).json(path)


def combine(sets: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of result sets with missing columns filled; of equal ids the earliest set's row stays."""
    tagged = [df.withColumn("__set", F.lit(i)) for i, df in enumerate(sets)]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_by(merged, [key], ["__set"]).drop("__set")


def combine_counters(sets: Sequence[DataFrame], key: str, counters: Sequence[str]) -> DataFrame:
    """Counters of every set added up by key."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)
    return merged.groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])
