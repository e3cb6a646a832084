"""Joins of points and spans: line in method, file suffix, containment, innermost span.

An interval join has no equality of its own, so Catalyst would fall back to nested loops. Spans are
exploded to fixed line blocks and points carry their block; (file key, block) is then a hash key and
the exact predicate stays as the residual. Long spans touch more blocks, never a whole file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.scalars import basename, normalise_path, same_file
from pathloom.operators.skew import pin

BLOCK = 64


def _blocks(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / BLOCK), F.floor(end / BLOCK)))


def points_in_spans(points: DataFrame, spans: DataFrame, on: Sequence[str], line: str = "line", start: str = "start", end: str = "end") -> DataFrame:
    """Inner join of points to every span with ``start <= line <= end`` under equal ``on``."""
    left = points.withColumn("__b", F.floor(F.col(line) / BLOCK))
    right = spans.withColumn("__b", _blocks(F.col(start), F.col(end)))
    return left.join(right, [*on, "__b"]).filter(F.col(line).between(F.col(start), F.col(end))).drop("__b")


def overlapping_spans(left: DataFrame, right: DataFrame, on: Sequence[str], l: tuple[str, str], r: tuple[str, str]) -> DataFrame:
    """Inner join of spans that share a line, each pair once: in the block where the later one starts."""
    a = left.withColumn("__b", _blocks(F.col(l[0]), F.col(l[1])))
    b = right.withColumn("__b", _blocks(F.col(r[0]), F.col(r[1])))
    met = a.join(b, [*on, "__b"])
    first = F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / BLOCK)
    return met.filter(
        (F.col(l[0]) <= F.col(r[1])) & (F.col(r[0]) <= F.col(l[1])) & (F.col("__b") == first)
    ).drop("__b")


def spans_within(inner: DataFrame, outer: DataFrame, on: Sequence[str], i: tuple[str, str], o: tuple[str, str]) -> DataFrame:
    """Inner join of each inner span to every outer span that contains it whole."""
    a = inner.withColumn("__b", F.floor(F.col(i[0]) / BLOCK))
    b = outer.withColumn("__b", _blocks(F.col(o[0]), F.col(o[1])))
    return a.join(b, [*on, "__b"]).filter(
        (F.col(o[0]) <= F.col(i[0])) & (F.col(i[1]) <= F.col(o[1]))
    ).drop("__b")


def match_files(left: DataFrame, right: DataFrame, on: Sequence[str] = (), left_file: str = "file", right_file: str = "file") -> DataFrame:
    """Join rows whose files are the same program file: hash on the base name, suffix test as residual.

    Adds ``left_path`` and ``right_path``, the normalised files.
    """
    a = pin(left, left_path=normalise_path(F.col(left_file))).drop(left_file).withColumn("__name", basename(F.col("left_path")))
    b = pin(right, right_path=normalise_path(F.col(right_file))).withColumn("__name", basename(F.col("right_path")))
    b = b if right_file == "file" else b.drop(right_file)
    return a.join(b, [*on, "__name"]).filter(same_file(F.col("left_path"), F.col("right_path"))).drop("__name")


def innermost(hits: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Of the spans that hold a point drop every one with another, different hit inside it.

    Equal or merely crossing spans stay and mark the point ambiguous. ``keys`` name distinct points,
    so a window holds one point's nesting depth.
    """
    later = W.partitionBy(*keys).orderBy(F.col(start).desc())
    inner = F.min(end).over(later.rangeBetween(W.unboundedPreceding, -1))
    level = F.min(end).over(W.partitionBy(*keys, start))
    return (
        hits.withColumn("__inner", inner).withColumn("__level", level)
        .filter((F.col("__inner").isNull() | (F.col("__inner") > F.col(end))) & (F.col("__level") >= F.col(end)))
        .drop("__inner", "__level")
    )


def owners(points: DataFrame, decls: DataFrame, file: str, line: str, decl_id: str) -> DataFrame:
    """Innermost declaration per point: ``n_owners``, the sole ``owner`` if one, and the mapping word."""
    spots = points.select(file, line).distinct()
    # Declarations of one span stand or fall together, so only distinct spans enter a point's window.
    decls = decls.withColumnRenamed("file", file).select(file, "start", "end", decl_id)
    spans = innermost(points_in_spans(spots, decls.select(file, "start", "end").distinct(), [file], line), [file, line])
    hits = spans.select(file, line, "start", "end").join(decls, [file, "start", "end"])
    mapped = hits.groupBy(file, line).agg(F.countDistinct(decl_id).alias("n_owners"), F.min(decl_id).alias("__one"))
    return points.join(mapped, [file, line], "left").select(
        *points.columns,
        F.coalesce("n_owners", F.lit(0)).alias("n_owners"),
        F.when(F.col("n_owners") == 1, F.col("__one")).alias("owner"),
        F.when(F.col("n_owners") == 1, "unique").when(F.col("n_owners") > 1, "ambiguous").otherwise("unmapped").alias("mapping"),
    )
