"""Registry of runnable queries: a Spark callable and, where SQL can say it, the DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` under ``name``; ``t`` is a :class:`Tables` over one data folder."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


class Tables:
    """Lazy access to the input tables and to the domain-shaped bindings over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        from pathloom.bindings import BINDINGS, TABLES

        if name in TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in BINDINGS:
            deps = {dep: getattr(self, dep) for dep in BINDINGS[name].deps}
            df = self.spark.sql(BINDINGS[name].sql, **deps)
        else:
            raise AttributeError(name)
        setattr(self, name, df)
        return df
