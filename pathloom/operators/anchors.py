"""Endpoint anchors: mapping candidates to value rows, reach funnels and per-candidate diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.scalars import canonical_json, normalise_path
from pathloom.operators.skew import count_distinct, pin, top_k

REF = ["ref_side", "ref_entity", "ref_file", "ref_line"]


def _reference(df: DataFrame, side: str, entity: str, file: str, line: str) -> DataFrame:
    return pin(df, ref_file=normalise_path(F.col(file))).select(
        "*", F.col(side).alias("ref_side"), F.col(entity).alias("ref_entity"), F.col(line).cast("int").alias("ref_line"))


def map_anchors(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidates joined to value rows by (side, entity, file, line); one distinct row maps, more are ambiguous."""
    values = [c for c in rows.columns if not c.startswith("candidate_")]
    matches = (
        _reference(rows.distinct(), "candidate_side", "candidate_entity", "candidate_file", "candidate_line")
        .groupBy(*REF).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*values)).alias("row"))
    )
    joined = _reference(candidates, "side", "entity", "file", "line").join(matches, REF, "left")
    mapped = F.col("n") == 1
    row = lambda name: F.when(mapped, F.col("row")[name])
    index = row("argument_index").try_cast("int")
    return joined.select(
        "candidate_id", "project_id", F.col("kind").alias("candidate_kind"), "side",
        row("anchor_kind").alias("anchor_kind"), row("value_role").alias("value_role"),
        row("method_identity").alias("method_identity"), F.nullif(row("call_identity"), F.lit("")).alias("call_identity"),
        F.when(index >= 0, index).alias("argument_index"),
        row("anchor_file").alias("anchor_file"), row("anchor_line").cast("int").alias("anchor_line"),
        F.when(F.col("n").isNull(), "UNMAPPABLE").when(mapped, "MAPPED").otherwise("ADAPTER_ERROR").alias("mapping_status"),
        F.when(F.col("n").isNull(), "NO_GENERIC_AST_VALUE_MATCH").when(mapped, F.col("row")["mapping_reason"])
        .otherwise("AMBIGUOUS_GENERIC_AST_VALUE_MATCH").alias("mapping_reason"),
        F.lit("SUCCESS").alias("query_status"),
    )


def funnel(anchors: DataFrame, candidates: DataFrame, reach: DataFrame, representatives: int = 5) -> DataFrame:
    """Per anchor: distinct reachable nodes, the first few of them, and where the candidate drops out."""
    refs = _reference(candidates, "side", "entity", "file", "line").select(*REF, "candidate_id")
    node = {"kind": F.col("node_kind"), "entity": F.col("node_entity"), "method_identity": F.col("node_method"),
            "location": F.struct(F.col("node_file").alias("file"), F.col("node_line").alias("line"))}
    nodes = (
        _reference(reach, "candidate_side", "candidate_entity", "candidate_file", "candidate_line")
        .select(*REF, canonical_json(node).alias("node"), "node_entity").distinct()
        .join(refs, REF).select("candidate_id", "node", "node_entity")
    )
    counts = count_distinct(nodes, ["candidate_id"], ["node"], "reachable_node_count")
    first = (
        top_k(nodes, ["candidate_id"], [F.col("node")], representatives)
        .groupBy("candidate_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "node_entity"))), lambda s: s["node_entity"]).alias("representative_nodes"))
    )
    is_input = F.col("side") == "INPUT"
    n = F.coalesce("reachable_node_count", F.lit(0))
    return anchors.join(counts, "candidate_id", "left").join(first, "candidate_id", "left").select(
        *anchors.columns,
        n.alias("reachable_node_count"),
        F.coalesce("representative_nodes", F.array().cast("array<string>")).alias("representative_nodes"),
        F.when(F.col("query_status") == "QUERY_ERROR", "QUERY_ERROR")
        .when(F.col("mapping_status") == "UNMAPPABLE", F.when(is_input, "UNMAPPABLE_INPUT").otherwise("UNMAPPABLE_EFFECT"))
        .when(F.col("mapping_status") == "ADAPTER_ERROR", "ADAPTER_ERROR")
        .when(n > 0, "ACTIVE").when(is_input, "EMPTY_FW").otherwise("EMPTY_BW").alias("funnel_status"),
    )


def funnel_summary(funnels: DataFrame) -> DataFrame:
    status = F.col("funnel_status")
    return funnels.groupBy("side").agg(
        F.count(F.lit(1)).alias("candidate_total"),
        F.count_if(F.col("mapping_status") == "MAPPED").alias("anchor_mappable"),
        F.count_if(status.startswith("UNMAPPABLE")).alias("anchor_unmappable"),
        F.count_if(status == "ADAPTER_ERROR").alias("adapter_error"),
        F.count_if(F.col("reachable_node_count") > 0).alias("non_empty"),
        F.count_if(status.startswith("EMPTY")).alias("empty"),
    )


def diagnose(funnels: DataFrame, paths: DataFrame, frontiers: DataFrame) -> DataFrame:
    """One class per candidate: error, connected, frontier, unmappable, adapter error, empty, other region."""

    def ids(df: DataFrame, flag: str) -> DataFrame:
        both = F.explode(F.array("input_candidate_id", "effect_candidate_id")).alias("candidate_id")
        return df.select(both).distinct().withColumn(flag, F.lit(True))

    is_input = F.col("candidate_kind") == "EXTERNAL_INPUT"
    return (
        funnels.join(ids(paths, "connected"), "candidate_id", "left").join(ids(frontiers, "frontier"), "candidate_id", "left")
        .select(
            "candidate_id", "project_id", "candidate_kind", "mapping_status", "reachable_node_count",
            F.when(F.col("query_status") == "QUERY_ERROR", "QUERY_ERROR").when(F.col("connected"), "STATIC_CONNECTED")
            .when(F.col("frontier"), "STRUCTURAL_FRONTIER")
            .when(F.col("mapping_status") == "UNMAPPABLE", F.when(is_input, "UNMAPPABLE_INPUT").otherwise("UNMAPPABLE_EFFECT"))
            .when(F.col("mapping_status") == "ADAPTER_ERROR", "ADAPTER_ERROR")
            .when(F.col("reachable_node_count") == 0, F.when(is_input, "EMPTY_FW").otherwise("EMPTY_BW"))
            .otherwise("DIFFERENT_CALL_REGION").alias("classification"),
        )
    )


def resolve_pairs(rows: DataFrame, candidates: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flow rows with both ends known and anchored, keyed by candidate ids; and the count of the rest."""

    known = candidates.join(anchors.select("candidate_id", "mapping_status"), "candidate_id")
    refs = _reference(known, "side", "entity", "file", "line").select(*REF, "candidate_id", "mapping_status")

    def side(df: DataFrame, word: str) -> DataFrame:
        keyed = _reference(df.withColumn("__side", F.lit(word.upper())), "__side", f"{word}_entity", f"{word}_file", f"{word}_line").drop("__side")
        found = refs.withColumnRenamed("candidate_id", f"{word}_candidate_id").withColumnRenamed("mapping_status", f"{word}_status")
        return keyed.join(found, REF, "left").drop(*REF)

    both = side(side(rows, "input"), "effect")
    resolved = F.col("input_candidate_id").isNotNull() & F.col("effect_candidate_id").isNotNull()
    pairs = both.filter(resolved).select("input_candidate_id", "effect_candidate_id", "input_status", "effect_status").distinct()
    unmapped = both.agg(F.count_if(~resolved).alias("unmapped"), F.count_if(resolved).alias("resolved_rows"))
    return pairs, unmapped
