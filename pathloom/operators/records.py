"""Nested JSON records as rows: key checks, size attribution, and factoring of repeated objects."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.session import stored

# Label keys a detector input may not hold, and the fields a project row must hold.
FORBIDDEN_KEYS = (
    "cve", "cve_id", "cve_description", "cwe", "cwe_id", "fix", "fix_commit", "fix_info", "fix_patch", "ground_truth", "source_annotation",
    "sink_annotation", "vulnerable_file", "vulnerable_function", "vulnerable_line", "vulnerable_location")
PROJECT_FIELDS = ("project", "revision", "source_path", "codeql_db_path")


def json_nodes(records: DataFrame, key: str, text: str) -> DataFrame:
    """Every node below a record: ``key, path array<string>, named, json, container, object``; one explode per level until none is left.

    A level is told once and written as a table, of which callers read the columns they use; only containers keep their
    value for the next level. The first sign of a node's JSON tells its kind.
    """
    spark = records.sparkSession
    level = records.select(F.col(key).alias("key"), F.array().cast("array<string>").alias("path"), F.parse_json(text).alias("v"))
    found = []
    while True:
        nodes = stored(spark.sql("""
            SELECT key, path, named, json, container, object, CASE WHEN container THEN v END AS v FROM (
                SELECT *, left(json, 1) IN ('{{', '[') AS container, left(json, 1) = '{{' AS object FROM (
                    SELECT n.`key`, concat(path, array(coalesce(c.key, CAST(c.pos AS STRING)))) AS path, c.key IS NOT NULL AS named, c.value AS v, to_json(c.value) AS json
                    FROM {nodes} AS n, LATERAL variant_explode(v) AS c))""", nodes=level))
        found.append(nodes.drop("v"))
        level = nodes.filter("container").select("key", "path", "v")
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def validate_contract(records: DataFrame, key: str, text: str, project: str) -> DataFrame:
    """Violations of the detector input contract: forbidden keys at any depth, missing or extra fields, empty values, repeated projects."""
    nodes = json_nodes(records, key, text)
    leaks = nodes.filter("named").select("key", F.lower(F.element_at("path", -1)).alias("k")).filter(F.col("k").isin(*FORBIDDEN_KEYS)).distinct()
    top = nodes.filter("named AND size(path) = 1").select("key", F.col("path")[0].alias("k"), "json")
    have = top.groupBy("key").agg(F.collect_set("k").alias("have"), F.bool_and(F.col("json").rlike('^".+"$')).alias("filled"))
    want = F.array(*map(F.lit, PROJECT_FIELDS))
    missing, extra = F.array_sort(F.array_except(want, F.col("have"))), F.array_sort(F.array_except("have", want))
    fields = have.filter((F.size(missing) > 0) | (F.size(extra) > 0)).select(
        "key", F.lit("FIELD_CONTRACT").alias("violation"), F.concat(F.lit("missing="), F.array_join(missing, ","), F.lit(";extra="), F.array_join(extra, ",")).alias("detail"))
    empty = have.filter("NOT filled").select("key", F.lit("EMPTY_FIELD").alias("violation"), F.lit("").alias("detail"))
    named = records.select(F.col(key).alias("key"), F.get_json_object(text, f"$.{project}").alias("p"))
    twice = named.join(named.groupBy("p").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "p").select("key", F.lit("DUPLICATE_PROJECT").alias("violation"), F.col("p").alias("detail"))
    return leaks.select("key", F.lit("FORBIDDEN_KEY").alias("violation"), F.col("k").alias("detail")).unionByName(fields).unionByName(empty).unionByName(twice)


# Path words of each component, first match wins.
RELATION_WORDS = (
    "web_surface_inventory", "class_views", "related_methods", "resource_references", "retrieval_results", "guidance", "callers", "callees",
    "navigation_facts", "source_boundaries", "caller_edges", "investigation_tool_results")
HISTORY_WORDS = ("recent_observations", "existing_candidates", "feedback", "critical_evidence_closure")
SOURCE_WORDS = ("source_evidence", "source", "source_window")


def component(path: Column) -> Column:
    words = F.transform(path, lambda k: F.lower(k))
    among = lambda names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    holds = lambda pattern: F.exists(words, lambda k: k.rlike(pattern))
    return (
        F.when(holds("contract|documentation"), "contract_material").when(among(SOURCE_WORDS), "source").when(among(HISTORY_WORDS), "historical_observations")
        .when(holds("codeql|native_alert|native_finding"), "codeql").when(among(RELATION_WORDS), "relations_navigation")
        .when(among(("inventory",)), "inventory").otherwise("other_and_framing"))


def component_sizes(nodes: DataFrame) -> DataFrame:
    """Leaves and bytes per component over all records."""
    leaves = nodes.filter("NOT container")
    return leaves.groupBy(component(F.col("path")).alias("component")).agg(F.count(F.lit(1)).alias("leaves"), F.sum(F.octet_length("json")).alias("bytes"))


PROTECTED = ("conditions", "uncertainties")


def factor_repeats(nodes: DataFrame, minimum: int = 256, protected: Sequence[str] = PROTECTED) -> tuple[DataFrame, DataFrame]:
    """Objects of a record that occur more than once and are large: one shared row each, and a reference per occurrence.

    An occurrence inside another shared object is part of that object's row, not a reference of the record.
    """
    open_ = nodes.filter("object").filter(~F.arrays_overlap("path", F.array(*map(F.lit, protected)))).filter(F.octet_length("json") >= minimum)
    hashed = open_.withColumn("id", F.concat(F.lit("metadata-"), F.substring(F.sha2("json", 256), 1, 24)))
    shared = hashed.groupBy("key", "id").agg(F.count(F.lit(1)).alias("occurrences"), F.min("json").alias("json")).filter("occurrences > 1")
    # Read three times, so written once.
    refs = stored(hashed.select("key", "id", "path", F.count(F.lit(1)).over(W.partitionBy("key", "id")).alias("n")).filter("n > 1").drop("n"))
    above = refs.select("key", F.col("path").alias("outer_path"))
    # A path is nested when one of its own prefixes is a reference: explode the prefixes, then an equi-join.
    prefixes = refs.filter("size(path) > 1").select("key", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", 1, n))).alias("outer_path"))
    nested = prefixes.join(above, ["key", "outer_path"], "left_semi").select("key", "path").distinct()
    return shared, refs.join(nested, ["key", "path"], "left_anti")
