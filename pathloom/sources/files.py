"""File tables: source scan, inventory and hash manifests over (path, content) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.scalars import repo_path

# Directories a source scan leaves out.
EXCLUDED_DIRECTORIES = (".git", ".idea", ".gradle", "build", "target", "out", "node_modules")


def binary_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """All files below ``root`` as ``path`` (relative), ``length`` and ``content``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = F.regexp_replace(F.lit(root), "/+$", "")
    at = F.instr("path", base)
    return raw.select(F.expr("path").substr(at + F.length(base) + 1, F.length("path")).alias("path"), "length", "content")


def scan_sources(files: DataFrame, suffix: str, excluded: Sequence[str] = EXCLUDED_DIRECTORIES) -> tuple[DataFrame, DataFrame]:
    """Decoded source files with a canonical path; and a diagnostic per file whose bytes are not UTF-8."""
    inside = F.split("path", "/")
    wanted = files.filter(F.col("path").endswith(suffix) & ~F.arrays_overlap(F.slice(inside, 1, F.size(inside) - 1), F.array(*map(F.lit, excluded))))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    good = wanted.filter(valid).select(repo_path(F.col("path")).alias("path"), F.col("content").cast("string").alias("text"))
    bad = wanted.filter(~valid).select("path", F.lit("ERROR").alias("severity"), F.lit("SOURCE_NOT_UTF8").alias("code"))
    return good, bad


def inventory(files: DataFrame, markers: dict[str, str], depth: int = 1) -> DataFrame:
    """Per directory: files, bytes, and for each marker whether a file of that name pattern is there."""
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.least(F.lit(depth), F.size(parts) - 1)), "/")
    flags = [F.bool_or(F.col("path").rlike(pattern)).alias(name) for name, pattern in markers.items()]
    return files.groupBy(folder.alias("directory")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), *flags)


def manifest(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def verify_manifest(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected files that are missing or whose content changed."""
    have = manifest(files).withColumnRenamed("sha256", "actual")
    return expected.join(have, "path", "left").filter(F.col("actual").isNull() | (F.col("actual") != F.col("sha256"))).select(
        "path", F.when(F.col("actual").isNull(), "MISSING").otherwise("HASH_MISMATCH").alias("problem"))
