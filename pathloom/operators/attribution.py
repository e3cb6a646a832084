"""Frontier taxonomy, backward root causes, share and concentration tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.skew import count_distinct, first_by

# The structural reasons with a class of their own.
PRIMARY_REASONS = ("SAME_METHOD", "CALL_ADJACENT", "SAME_RECEIVER", "FIELD_RELATED", "NEAR_CALL_REGION")


def classify_frontier(df: DataFrame) -> DataFrame:
    """Adds likely class, its basis and confidence from reason, node kinds and value roles."""
    reason = F.coalesce("frontier_reason", F.lit("OTHER_STRUCTURAL"))
    kinds = F.array(F.upper("fw_kind"), F.upper("bw_kind"))
    roles = F.array(F.upper("input_role"), F.upper("effect_role"))
    field = F.exists(kinds, lambda k: F.coalesce(k.contains("FIELD"), F.lit(False)))
    receiver = F.exists(F.concat(kinds, roles), lambda k: F.coalesce(k == "RECEIVER", F.lit(False))) | (reason == "SAME_RECEIVER")

    def pick(*values: str) -> Column:
        return (
            F.when(field, values[0]).when(receiver, values[1]).when(reason == "SAME_METHOD", values[2])
            .when(reason == "CALL_ADJACENT", values[3]).when(reason == "NEAR_CALL_REGION", values[4]).otherwise(values[5])
        )

    return df.select(
        "*",
        pick("FIELD_STATE_LIKE", "OBJECT_RECEIVER_RELATED", "SAME_METHOD_UNRESOLVED", "DIRECT_DATA_CALL_NEAR_MISS",
             "CALL_BOUNDARY_UNRESOLVED", "UNKNOWN_STRUCTURAL").alias("likely_class"),
        pick("explicit field node/relation", "explicit receiver node/role or SAME_RECEIVER", "frontier_reason=SAME_METHOD",
             "frontier_reason=CALL_ADJACENT", "frontier_reason=NEAR_CALL_REGION",
             "insufficient explicit semantic structure").alias("evidence_basis"),
        pick("HIGH", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW").alias("confidence"),
    )


def backward_cases(df: DataFrame) -> DataFrame:
    """Root cause of each backward funnel row: unmappable, query error, active, or mapped but empty and why."""
    active = (F.col("reachable_node_count") > 0) | F.col("funnel_status").isin("ACTIVE_BW", "BW_ACTIVE", "ACTIVE")
    mapped = F.coalesce(F.col("mapping_status").isin("MAPPED", "SUCCESS"), F.lit(False))
    queried = F.coalesce(F.col("query_status").isin("SUCCESS", "OK"), F.lit(False))
    role = F.coalesce("value_role", F.lit("UNKNOWN"))
    return df.select(
        "*",
        active.alias("bw_active"),
        F.when(~mapped, "ANCHOR_UNMAPPABLE").when(~queried, "QUERY_ERROR").when(active, "BW_ACTIVE")
        .otherwise("MAPPED_BUT_EMPTY_BW").alias("root_cause"),
        F.when(~mapped | ~queried, "UNKNOWN").when(active, "NOT_APPLICABLE")
        .when(role.isin("UNKNOWN", "", "None"), "UNSUPPORTED_VALUE_ROLE")
        .when(F.coalesce(F.col("call_identity"), F.lit("")) == "", "CALLSITE_RESOLUTION_LIMITATION")
        .otherwise("NO_PREDECESSOR_IN_BASE_DATA_CALL").alias("secondary_root_cause"),
    )


def share(df: DataFrame, key: str) -> DataFrame:
    """Count and percentage per value; the total comes from the counted table, not from the rows again."""
    counts = df.groupBy(F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("UNKNOWN")).alias(key)).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("__total"))
    return counts.join(F.broadcast(total)).select(key, "count", F.round(F.col("count") / F.col("__total") * 100, 4).alias("percentage"))


def distinct_levels(df: DataFrame, levels: dict[str, Sequence[str]]) -> DataFrame:
    """One row: raw count and the exact distinct count at each level, each its own two-step aggregate."""
    out = df.agg(F.count(F.lit(1)).alias("raw_count"))
    for name, cols in levels.items():
        out = out.join(F.broadcast(count_distinct(df, [], cols, name)))
    return out


def collapse(df: DataFrame) -> DataFrame:
    """One row per candidate: the first active row, else the first; activity OR-ed and mapped status wins.

    ``conflict`` marks ids whose rows disagree on ``effect_type``.
    """
    ok = F.col("mapping_status").isin("MAPPED", "SUCCESS")
    flags = df.groupBy("candidate_id").agg(
        F.bool_or("bw_active").alias("bw_active"),
        F.max_by(F.when(ok, F.col("mapping_status")), F.when(ok, F.col("seq"))).alias("__mapped"),
        (F.min(F.coalesce("effect_type", F.lit(""))) != F.max(F.coalesce("effect_type", F.lit("")))).alias("conflict"),
    )
    base = first_by(df.withColumn("__idle", ~F.col("bw_active")), ["candidate_id"], ["__idle", "seq"]).drop("__idle", "bw_active")
    return base.join(flags, "candidate_id").withColumn(
        "mapping_status", F.when(F.col("bw_active"), F.col("mapping_status")).otherwise(F.coalesce("__mapped", "mapping_status"))
    ).drop("__mapped")


def concentration(df: DataFrame, key: str, label: str) -> DataFrame:
    """Share of the first and first three groups, and the recommendation they lead to."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == "UNKNOWN_STRUCTURAL").alias("u"))
    first = counts.orderBy(F.col("n").desc(), key).limit(3).agg(F.sort_array(F.collect_list("n"), asc=False).alias("top"))
    total = counts.agg(F.sum("n").alias("total"), F.sum("u").alias("unknown"))
    top1 = F.try_divide(F.col("top")[0].cast("double"), F.col("total"))
    top3 = F.try_divide(F.aggregate("top", F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double"), F.col("total"))
    unknown = F.try_divide(F.col("unknown").cast("double"), F.col("total"))
    return first.join(F.broadcast(total)).select(
        F.round(top1, 6).alias("top1_share"), F.round(top3, 6).alias("top3_share"), F.round(unknown, 6).alias("unknown_share"),
        F.when(top1 >= 0.8, "PROJECT_CONCENTRATED_EVIDENCE; INSUFFICIENT_EVIDENCE_FOR_E2")
        .when(unknown >= 0.5, "INSUFFICIENT_EVIDENCE_FOR_E2").otherwise("FIX_W1_E1_IMPLEMENTATION").alias("recommendation"),
    )


def activity_by(df: DataFrame, key: str) -> DataFrame:
    active = F.count_if("bw_active")
    return df.groupBy(F.coalesce(F.col(key), F.lit("UNKNOWN")).alias(key)).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("mapping_status").isin("MAPPED", "SUCCESS")).alias("mapped"),
        active.alias("bw_active"),
        F.count_if(~F.col("bw_active")).alias("bw_inactive"),
        F.round(active / F.count(F.lit(1)), 6).alias("bw_active_rate"),
    )
