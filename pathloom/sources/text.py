"""JSONL and CSV scans with strict and tolerant modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _is_object(parsed: Column) -> Column:
    return F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per line; blank lines are skipped and any other line fails the read.

    The test is a filter on the line itself, so it also runs when a query needs one column or only counts.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    sound = F.when(_is_object(F.try_parse_json("value")), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("line is no JSON object: "), F.substring("value", 1, 200))).cast("boolean"))
    return lines.filter(sound).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and 1-based number, from any number of splits.

    Order inside a split comes from the row id, order of splits from their byte offset; a file's splits are
    few, so the offset window is small whatever the file size.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value")
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("file", "block", "first", before.alias("before"))
    return rows.join(offsets, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def load_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and an issue per line that is not JSON or not an object: ``file, line, error``."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    parsed = lines.withColumn("__v", F.try_parse_json("value"))
    is_object = _is_object(F.col("__v"))
    issues = parsed.filter(F.col("__v").isNull() | ~is_object).select(
        "file", "line", F.when(F.col("__v").isNull(), "invalid JSON").otherwise("record is not an object").alias("error"))
    rows = spark.read.text(path).filter(F.trim("value") != "").withColumn("__v", F.try_parse_json("value"))
    good = rows.filter(F.col("__v").isNotNull() & is_object).select(F.from_json("value", schema).alias("r")).select("r.*")
    return good, issues


def read_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """CSV with a header, byte order mark or not; missing required columns are an error. All columns are strings."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"CSV {path} is missing required columns: {', '.join(missing)}")
    return df


#: Every row is parsed whole, so that its width counts whatever columns a query needs.
WHOLE_ROWS = {"mode": "FAILFAST", "columnPruning": "false"}


def decode_csv(spark: SparkSession, path: str, columns: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """Headerless CSV whose rows must all have exactly these columns; another width fails the read."""
    types = types or {}
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in columns)
    return spark.read.schema(schema).options(**WHOLE_ROWS).csv(path)


# The columns of a relation export; the last came with the current version.
RELATION_COLUMNS = ("kind", "l_file", "l_line", "l_col", "r_file", "r_line", "r_col", "detail")
PORT = ("file", "line", "col", "end_line", "end_col", "role", "index")
# The columns of a value-transfer export; widths 17, 19 and 20 exist.
TRANSFER_COLUMNS = (
    *[f"from_{c}" for c in PORT], *[f"to_{c}" for c in PORT], "w_file", "w_line", "end_line", "kind", "end_file", "grp",
)


def _versioned(spark: SparkSession, path: str, columns: Sequence[str], widths: Sequence[int], defaults: dict) -> DataFrame:
    width = len(spark.read.option("header", True).csv(path).columns)
    if width not in widths:
        raise ValueError(f"expected one of {sorted(widths)} columns, got {width}")
    schema = ", ".join(f"`{c}` string" for c in columns[:width])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).options(**WHOLE_ROWS).csv(path)
    for name in columns[width:]:
        df = df.withColumn(name, defaults[name])
    return df.select(*columns)


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relation export of seven or eight columns, always as eight."""
    df = _versioned(spark, path, RELATION_COLUMNS, (7, 8), {"detail": F.lit("")})
    ints = ("l_line", "l_col", "r_line", "r_col")
    return df.select(*[F.col(c).cast("int").alias(c) if c in ints else F.coalesce(c, F.lit("")).alias(c) for c in df.columns])


def read_transfers(spark: SparkSession, path: str) -> DataFrame:
    """Value-transfer export of 17, 19 or 20 columns, always as 20."""
    defaults = {"kind": F.lit("static"), "end_file": F.col("w_file"), "grp": F.lit("")}
    return _versioned(spark, path, TRANSFER_COLUMNS, (17, 19, 20), defaults)
