"""Coverage of labelled methods by path locations, at file and method level, with NULL for not evaluable.

Label tables enter only here. Nothing in the detector modules takes one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.scalars import interval_distance, line_bucket, rate
from pathloom.operators.intervals import match_files
from pathloom.operators.skew import first_by


def join_cases(manifest: DataFrame, projects: DataFrame) -> DataFrame:
    """Runs joined to the labelled project of the same revision; of rows sharing a revision the last counts."""
    revision = F.lower(F.trim("buggy_commit_id"))
    usable = projects.withColumn("revision", revision).filter(
        (F.col("revision") != "") & (F.trim("project_slug") != "") & (F.trim("cve_id") != "")
    )
    latest = first_by(usable.drop("buggy_commit_id"), ["revision"], ["seq"], last=True).drop("seq")
    return manifest.withColumn("revision", F.lower("revision")).join(latest, "revision")


def case_fixes(cases: DataFrame, fixes: DataFrame) -> DataFrame:
    return cases.join(fixes.withColumnRenamed("file", "fix_file"), ["project_slug", "cve_id"])


def location_matches(locations: DataFrame, fixes: DataFrame) -> DataFrame:
    """Each (location, fix) of one project in the same file, with ``in_method`` for the line span.

    The hash key is (project, base name), so a busy project still spreads over its files.
    """
    spans = fixes.select("project_id", "case_id", "fix_file", "class_name", "method", "method_start", "method_end")
    matched = match_files(locations, spans, ["project_id"], "file", "fix_file")
    inside = F.col("line").between(F.col("method_start"), F.col("method_end"))
    return matched.withColumn("in_method", F.when(F.col("method_start").isNotNull(), inside))


def case_coverage(locations: DataFrame, fixes: DataFrame) -> DataFrame:
    """Per case with at least one fix: file and method coverage and the verdict at the finest evaluable level."""
    evaluable = fixes.groupBy("case_id", "project_id").agg(F.bool_or(F.col("method_start").isNotNull()).alias("method_evaluable"))
    hits = location_matches(locations.select("project_id", "file", "line").distinct(), fixes).groupBy("case_id", "project_id").agg(
        F.lit(True).alias("file_hit"), F.bool_or(F.coalesce("in_method", F.lit(False))).alias("method_hit")
    )
    file_covered = F.coalesce("file_hit", F.lit(False))
    method_covered = F.when(F.col("method_evaluable"), F.coalesce("method_hit", F.lit(False)))
    return evaluable.join(hits, ["case_id", "project_id"], "left").select(
        "case_id", "project_id", file_covered.alias("file_covered"), method_covered.alias("method_covered"),
        F.when(F.col("method_evaluable"), "METHOD").otherwise("FILE").alias("comparison_level"),
        F.coalesce(method_covered, file_covered).alias("covered"),
    )


def with_baseline(cases: DataFrame, baseline: DataFrame, reported: DataFrame) -> DataFrame:
    """Candidate coverage beside baseline coverage; no report for a project means not evaluable."""
    base = baseline.select("case_id", "project_id", F.col("covered").alias("__covered"))
    known = reported.select("project_id").distinct().withColumn("__known", F.lit(True))
    joined = cases.join(base, ["case_id", "project_id"], "left").join(known, "project_id", "left")
    verdict = F.when(F.col("__known"), F.coalesce("__covered", F.lit(False)))
    return joined.select(
        *cases.columns, F.when(F.col("__known"), "EVALUABLE").otherwise("NOT_EVALUABLE").alias("baseline_status"),
        verdict.alias("baseline_covered"), F.coalesce(F.col("covered") & ~verdict, F.lit(False)).alias("recovered"),
    )


def coverage_summary(cases: DataFrame) -> DataFrame:
    n, known = F.count(F.lit(1)), F.count("baseline_covered")
    return cases.agg(
        n.alias("evaluable"), F.count_if("file_covered").alias("file_covered"),
        F.count("method_covered").alias("method_evaluable"), F.count_if("method_covered").alias("method_covered"),
        F.count_if("covered").alias("covered"), rate(F.count_if("covered"), n).alias("coverage_rate"),
        rate(F.count_if("method_covered"), F.count("method_covered")).alias("method_rate"),
        known.alias("baseline_evaluable"), F.count_if("baseline_covered").alias("baseline_covered"),
        F.count_if(~F.col("baseline_covered")).alias("baseline_missed"), F.count_if("recovered").alias("recovered"),
    )


def compare_pools(native: DataFrame, unified: DataFrame) -> DataFrame:
    """Native and unified coverage side by side, per case."""
    n = native.select("case_id", "project_id", "comparison_level", F.col("covered").alias("native_covered"))
    u = unified.select("case_id", "project_id", F.col("covered").alias("unified_covered"))
    return n.join(u, ["case_id", "project_id"]).withColumn("recovered", ~F.col("native_covered") & F.col("unified_covered"))


def pool_summary(cases: DataFrame) -> DataFrame:
    n, nat, uni = F.count(F.lit(1)), F.count_if("native_covered"), F.count_if("unified_covered")
    return cases.agg(
        n.alias("evaluable"), nat.alias("native_covered"), uni.alias("unified_covered"), (uni - nat).alias("gain"),
        (n - nat).alias("baseline_misses"), F.count_if("recovered").alias("recovered"),
        rate(F.count_if("recovered"), n - nat).alias("recovery_rate"),
    )


def recoveries(locations: DataFrame, fixes: DataFrame, cases: DataFrame) -> DataFrame:
    """Augmented paths that cover a case the native pool missed: one row per (case, path)."""
    missed = cases.filter("recovered").select("case_id", "project_id", "comparison_level")
    matched = location_matches(locations, fixes).join(missed, ["case_id", "project_id"])
    good = F.when(F.col("comparison_level") == "METHOD", F.coalesce("in_method", F.lit(False))).otherwise(F.lit(True))
    return matched.filter(good).select("case_id", "project_id", "candidate_path_id", "augmentation_reason").distinct()


def ablation(native: DataFrame, static: DataFrame, fixes: DataFrame) -> DataFrame:
    """Cases covered by the native pool plus one reason's paths alone, for every reason.

    Hits are found once for all paths. A case counts for a reason when native or that reason covers it, so
    the count is native coverage plus the cases only that reason adds: no (reason x case) product.
    """
    level = F.bool_or(F.col("method_start").isNotNull())
    levels = fixes.groupBy("case_id", "project_id").agg(level.alias("by_method"))
    everything = native.withColumn("reason", F.lit("")).unionByName(static.withColumn("reason", F.col("augmentation_reason")), allowMissingColumns=True)
    matched = location_matches(everything.select("project_id", "file", "line", "reason").distinct(), fixes)
    hits = matched.join(levels, ["case_id", "project_id"]).filter(~F.col("by_method") | F.coalesce("in_method", F.lit(False)))
    covered = hits.select("case_id", "project_id", "reason").distinct()
    base = covered.filter("reason = ''").select("case_id", "project_id")
    added = covered.filter("reason <> ''").join(base, ["case_id", "project_id"], "left_anti").groupBy("reason").agg(F.count(F.lit(1)).alias("gain_over_native"))
    sizes = static.groupBy(F.col("augmentation_reason").alias("reason")).agg(F.countDistinct("candidate_path_id").alias("candidate_paths"))
    total = base.agg(F.count(F.lit(1)).alias("__native"))
    gain = F.coalesce("gain_over_native", F.lit(0))
    return sizes.join(added, "reason", "left").join(F.broadcast(total)).select(
        "reason", "candidate_paths", (F.col("__native") + gain).alias("coverage"), gain.alias("gain_over_native")
    )


def coverage_by(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One table over several keys at once: each key's values with evaluable, native and unified counts."""
    value = F.coalesce(*[F.col(k).cast("string") for k in keys])
    which: Column = F.lit(None).cast("string")
    for k in keys:
        which = F.when(F.grouping(k) == 0, k).otherwise(which)
    return cases.groupingSets([[k] for k in keys], *keys).agg(
        which.alias("dimension"), F.count(F.lit(1)).alias("evaluable"),
        F.count_if("native_covered").alias("native_covered"), F.count_if("unified_covered").alias("unified_covered"),
    ).select("dimension", value.alias("value"), "evaluable", "native_covered", "unified_covered")


def adjudicate(candidates: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """Candidates with the number of labelled methods they lie in; open-ended spans count; decisions stay UNKNOWN."""
    spans = fixes.select("project_id", "fix_file", "class_name", "method", "method_start", "method_end").distinct()
    inside = (F.col("method_start").isNull() | (F.col("line") >= F.col("method_start"))) & (
        F.col("method_end").isNull() | (F.col("line") <= F.col("method_end")))
    spots = candidates.select("project_id", "file", "line").distinct().withColumn("spot_file", F.col("file"))
    counted = match_files(spots, spans, ["project_id"], "file", "fix_file").filter(inside).groupBy("project_id", "spot_file", "line").agg(
        F.count(F.lit(1)).alias("n"))
    joined = candidates.join(counted.withColumnRenamed("spot_file", "file"), ["project_id", "file", "line"], "left")
    return joined.select(
        key, "project_id", F.lit("UNKNOWN").alias("decision"), F.col("n").isNotNull().alias("location_match"),
        F.coalesce("n", F.lit(0)).alias("matched_fixes"),
    )


def _per_location(locations: DataFrame, fixes: DataFrame) -> DataFrame:
    """Distinct locations weighted by how often they occur, joined to the fixes of their file."""
    weighted = locations.groupBy("project_id", "file", "line").agg(F.count(F.lit(1)).alias("weight"))
    distance = F.when(F.col("method_start").isNotNull(), interval_distance(F.col("line"), F.col("method_start"), F.col("method_end")))
    return location_matches(weighted, fixes).withColumn("distance", distance)


def sanity(locations: DataFrame, fixes: DataFrame) -> DataFrame:
    """Per project: locations in a labelled file, in a labelled method, and the least line distance."""
    pairs = _per_location(locations, fixes)
    files = pairs.select("project_id", "left_path", "line", "weight").distinct().groupBy("project_id").agg(F.sum("weight").alias("same_file"))
    methods = pairs.groupBy("project_id").agg(
        F.sum(F.when(F.col("distance") == 0, F.col("weight")).otherwise(0)).alias("same_method"), F.min("distance").alias("nearest"))
    return files.join(methods, "project_id")


def distance_histogram(locations: DataFrame, fixes: DataFrame) -> DataFrame:
    known = _per_location(locations, fixes).filter("distance IS NOT NULL")
    return known.groupBy(line_bucket(F.col("distance")).alias("bucket")).agg(F.sum("weight").alias("count"))
