"""Analyzer reports: SARIF, event-trace JSON and canonical findings, all as exploded rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.scalars import cwe_ids, relativise, url_join
from pathloom.operators.skew import pin
from pathloom.session import cut_lineage, stored

LOCATION = """physicalLocation struct<artifactLocation: struct<uri: string, uriBaseId: string, index: int>,
    region: struct<startLine: int, startColumn: int, endLine: int, endColumn: int>>, message: struct<text: string>"""
LOCATION = " ".join(LOCATION.split()).replace("physicalLocation ", "physicalLocation: ", 1)
RULE = "id: string, properties: struct<tags: array<string>>"
SARIF_SCHEMA = (
    "version string, runs array<struct<"
    f"invocations: array<struct<executionSuccessful: boolean>>, tool: struct<driver: struct<name: string, rules: array<struct<{RULE}>>>, "
    f"extensions: array<struct<rules: array<struct<{RULE}>>>>>, "
    "artifacts: array<struct<location: struct<uri: string, uriBaseId: string>>>, "
    "originalUriBaseIds: map<string, struct<uri: string, uriBaseId: string>>, "
    f"threadFlowLocations: array<struct<location: struct<{LOCATION}>>>, "
    "results: array<struct<ruleId: string, ruleIndex: int, message: struct<text: string>, properties: struct<tags: array<string>>, "
    f"locations: array<struct<{LOCATION}>>, "
    f"codeFlows: array<struct<threadFlows: array<struct<locations: array<struct<index: int, location: struct<{LOCATION}>>>>>>>>>>>"
)


def parse_sarif(docs: DataFrame, text: str = "text") -> DataFrame:
    """``project_id`` and the parsed report; text that does not parse fails."""
    return docs.select("project_id", F.from_json(text, SARIF_SCHEMA, {"mode": "FAILFAST"}).alias("doc"))


def _results(docs: DataFrame) -> DataFrame:
    runs = docs.select("project_id", F.posexplode("doc.runs").alias("run_index", "run"))
    return runs.select("project_id", "run_index", F.posexplode("run.results").alias("result_index", "result"))


def _flows(results: DataFrame) -> DataFrame:
    flows = results.select("project_id", "run_index", "result_index", F.col("result.ruleId").alias("rule_id"),
                           F.posexplode("result.codeFlows").alias("flow_index", "flow"))
    return flows.select("project_id", "run_index", "result_index", "rule_id", "flow_index", F.posexplode("flow.threadFlows").alias("thread_index", "thread"))


def _place(col: Column) -> Column:
    return F.struct(col["physicalLocation"]["artifactLocation"]["uri"].alias("file"), col["physicalLocation"]["region"]["startLine"].alias("line"))


def _usable(places: Column) -> Column:
    return F.filter(places, lambda p: p["file"].isNotNull() & p["line"].isNotNull())


def sarif_locations(docs: DataFrame) -> DataFrame:
    """Every physical location of results and of their flows."""
    results = _results(docs).select("project_id", "run_index", "result_index", "result")
    own = F.coalesce(F.transform("result.locations", _place), F.array().cast("array<struct<file:string,line:int>>"))
    steps = F.flatten(F.flatten(F.transform("result.codeFlows", lambda c: F.transform(
        c["threadFlows"], lambda t: F.transform(t["locations"], lambda s: _place(s["location"]))))))
    both = F.concat(own, F.coalesce(steps, F.array().cast("array<struct<file:string,line:int>>")))
    return results.select("project_id", "run_index", "result_index", F.explode(_usable(both)).alias("p")).select("project_id", "run_index", "result_index", "p.*")


def sarif_native_paths(docs: DataFrame) -> DataFrame:
    """One row per thread flow with locations, named by position."""
    places = _usable(F.transform("thread.locations", lambda s: _place(s["location"])))
    rows = _flows(_results(docs)).withColumn("locations", places).filter(F.size("locations") > 0)
    name = F.concat("project_id", F.lit(":r"), "run_index", F.lit(":result"), "result_index", F.lit(":flow"), "flow_index", F.lit(":thread"), "thread_index")
    return rows.select(name.alias("native_path_id"), "project_id", "rule_id", "run_index", "result_index", "flow_index", "thread_index", "locations")


def report_counts(docs: DataFrame) -> DataFrame:
    """Alerts and code flows per project."""
    results = F.flatten(F.transform("doc.runs", lambda r: F.coalesce(r["results"], F.array().cast(_results_type()))))
    flows = F.aggregate(results, F.lit(0), lambda n, r: n + F.greatest(F.coalesce(F.size(r["codeFlows"]), F.lit(0)), F.lit(0)))
    return docs.groupBy("project_id").agg(F.sum(F.size(results)).alias("alert_count"), F.sum(flows).alias("path_count"))


def _results_type() -> str:
    inner = SARIF_SCHEMA[SARIF_SCHEMA.index("results: ") + len("results: "):]
    return inner[:-2]


def _resolved_bases(runs: DataFrame) -> DataFrame:
    """Each named base of a run as one uri, joined along its further names from the outermost in; a cycle gives NULL.

    A chain without a cycle has at most as many names as the run has bases, so that many steps end every walk.
    """
    rows = runs.filter(F.size("run.originalUriBaseIds") > 0).select(
        "project_id", "run_index", F.col("run.originalUriBaseIds").alias("bases")).select("*", F.explode("bases").alias("base", "entry"))
    start = F.struct(F.array(F.coalesce("entry.uri", F.lit(""))).alias("uris"), F.col("entry.uriBaseId").alias("next"))

    def step(acc: Column, _: Column) -> Column:
        entry = F.when(acc["next"].isNotNull(), F.try_element_at("bases", acc["next"]))
        uris = F.when(entry.isNotNull(), F.concat(F.array(F.coalesce(entry["uri"], F.lit(""))), acc["uris"])).otherwise(acc["uris"])
        return F.struct(uris.alias("uris"), F.when(entry.isNotNull(), entry["uriBaseId"]).alias("next"))

    walked = pin(rows, end=F.aggregate(F.sequence(F.lit(1), F.size("bases")), start, step))
    cyclic = F.coalesce(F.map_contains_key("bases", F.coalesce("end.next", F.lit(""))), F.lit(False))
    prefix = F.aggregate("end.uris", F.lit(""), url_join)
    return walked.select("project_id", "run_index", "base", F.when(~cyclic, prefix).alias("prefix"), F.lit(True).alias("base_known"))


RUN = ["project_id", "run_index"]
RESULT = [*RUN, "result_index"]


def canonical_sarif(docs: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Findings with resolved files and CWE lists; and the rows refused, with a reason.

    Refused: a report of another version than 2.1.0, a run whose invocation failed, a result without locations, and any
    location that is remote, outside ``root``, cyclic in its base names, or has no valid line. Locations are resolved as
    flat rows and joined to the run's artifact, base and shared-location tables, then folded per path and per result.
    """
    # Eight tables are read out of the runs, so reports are parsed once.
    runs = stored(docs.select("project_id", F.coalesce(F.col("doc.version") == "2.1.0", F.lit(False)).alias("current"), F.posexplode("doc.runs").alias("run_index", "run")))
    results = runs.select(*RUN, F.posexplode("run.results").alias("result_index", "result"))
    shared = runs.select(*RUN, F.posexplode("run.threadFlowLocations").alias("step_index", "s")).select(*RUN, "step_index", F.col("s.location").alias("shared"))
    artifacts = runs.select(*RUN, F.posexplode("run.artifacts").alias("artifact", "a")).select(
        *RUN, "artifact", F.col("a.location.uri").alias("a_uri"), F.col("a.location.uriBaseId").alias("a_base"))

    none = F.lit(None).cast("int")
    own = results.select(*RESULT, F.lit(-1).alias("path"), F.posexplode("result.locations").alias("pos", "location")).withColumn("step_index", none)
    threads = results.select(*RESULT, F.posexplode(F.flatten(F.transform("result.codeFlows", lambda c: c["threadFlows"]))).alias("path", "thread"))
    steps = threads.select(*RESULT, "path", F.posexplode("thread.locations").alias("pos", "step")).select(
        *RESULT, "path", "pos", F.col("step.location").alias("location"), F.col("step.index").alias("step_index"))
    flat = own.unionByName(steps).join(shared, [*RUN, "step_index"], "left")
    use_shared = F.col("location.physicalLocation").isNull()
    flat = flat.select(*RESULT, "path", "pos", F.when(use_shared, F.col("shared")).otherwise(F.col("location")).alias("at")).filter(
        F.col("at.physicalLocation").isNotNull()).select(
        *RESULT, "path", "pos", F.col("at.physicalLocation.artifactLocation").alias("artifact_at"), F.col("at.physicalLocation.region").alias("region"),
        F.coalesce("at.message.text", F.lit("")).alias("description"))
    listed = flat.withColumn("artifact", F.when(F.col("artifact_at.uri").isNull(), F.col("artifact_at.index"))).join(artifacts, [*RUN, "artifact"], "left")
    based = listed.withColumn("uri", F.coalesce("artifact_at.uri", "a_uri")).withColumn("base", F.coalesce("artifact_at.uriBaseId", "a_base")).join(
        _resolved_bases(runs), [*RUN, "base"], "left")
    full = F.when(F.col("base_known").isNull(), F.col("uri")).when(F.col("prefix").isNotNull(), url_join(F.col("prefix"), F.col("uri")))
    local = F.regexp_replace(full, r"^file://localhost/", "file:///")
    placed = pin(based, local=F.coalesce(F.try_url_decode(F.replace(local, F.lit("+"), F.lit("%2B"))), local))
    remote = F.col("local").rlike(r"^file://[^/]") | F.col("local").rlike(r"^(?!file:)[A-Za-z][A-Za-z0-9+.-]+://")
    placed = pin(placed, file_path=F.when(~remote, relativise(F.col("local"), F.lit(root))))
    line = F.col("region.startLine")
    placed = placed.withColumn("line_number", F.when(line >= 1, line))
    point = F.struct(
        "file_path", "line_number", F.col("region.startColumn").alias("column"), F.coalesce("region.endLine", line).alias("end_line"),
        F.col("region.endColumn").alias("end_column"), "description")
    per_path = placed.groupBy(*RESULT, "path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", point.alias("point")))), lambda p: p["point"]).alias("points"),
        F.bool_or(F.col("file_path").isNull()).alias("bad_path"), F.bool_or(F.col("line_number").isNull()).alias("bad_line"))
    folded = per_path.groupBy(*RESULT).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("path") >= 0, F.struct("path", "points")))), lambda p: p["points"]).alias("paths"),
        F.flatten(F.collect_list(F.when(F.col("path") < 0, F.col("points")))).alias("locations"),
        F.bool_or("bad_path").alias("bad_path"), F.bool_or("bad_line").alias("bad_line"))
    lines_of = lambda f: F.array_sort(F.array_distinct(F.transform(F.filter("locations", lambda p: p["file_path"] == f), lambda p: p["line_number"])))
    affected = F.transform(F.array_sort(F.array_distinct(F.transform("locations", lambda p: p["file_path"]))), lambda f: F.struct(f.alias("file_path"), lines_of(f).alias("line_numbers")))

    driver = runs.select(*RUN, F.posexplode("run.tool.driver.rules").alias("rule_index", "r"))
    extra = runs.select(*RUN, F.explode(F.flatten(F.transform("run.tool.extensions", lambda e: e["rules"]))).alias("r"))
    rules = driver.select(*RUN, "r").unionByName(extra).select(*RUN, F.col("r.id").alias("rule_id"), F.array_join("r.properties.tags", " ").alias("rule_tags"))
    rules = rules.groupBy(*RUN, "rule_id").agg(F.max("rule_tags").alias("rule_tags"))
    indexed = driver.select(*RUN, "rule_index", F.col("r.id").alias("indexed_id"))
    state = runs.select(*RUN, "current", F.coalesce(F.exists("run.invocations", lambda i: i["executionSuccessful"] == F.lit(False)), F.lit(False)).alias("failed"))
    heads = results.select(*RESULT, F.col("result.ruleId").alias("given"), F.when(F.col("result.ruleId").isNull(), F.col("result.ruleIndex")).alias("rule_index"),
                           F.coalesce("result.message.text", F.lit("")).alias("description"), F.array_join("result.properties.tags", " ").alias("own_tags"))
    heads = heads.join(indexed, [*RUN, "rule_index"], "left").withColumn("rule_id", F.coalesce("given", "indexed_id"))
    heads = heads.join(rules, [*RUN, "rule_id"], "left").join(state, RUN).join(folded, RESULT, "left")
    problem = (
        F.when(~F.col("current"), "UNSUPPORTED_VERSION").when(F.col("failed"), "EXECUTION_FAILED").when(F.col("paths").isNull(), "NO_SOURCE_LOCATION")
        .when(F.col("bad_path"), "INVALID_PATH").when(F.col("bad_line"), "INVALID_LINE"))
    checked = heads.withColumn("problem", problem)
    good = pin(
        checked.filter("problem IS NULL"), cwes=cwe_ids(F.concat_ws(" ", "rule_tags", "own_tags")), affected_files=affected,
    ).select(
        *RESULT, "rule_id", "cwes", F.when(F.size("cwes") == 1, F.col("cwes")[0]).otherwise("").alias("cwe"), "description", "affected_files", "locations", "paths",
        F.when(F.size("paths") > 0, "reported_path").otherwise("location_only").alias("path_evidence"))
    return good, checked.filter("problem IS NOT NULL").select(*RESULT, "problem")


def event_traces(docs: DataFrame, text: str = "text") -> DataFrame:
    """Nested event traces as paths: each event list with located events is one path, named by its position.

    One explode per nesting level; it stops when a level has no nested events, whatever the depth.
    """
    lists = docs.select("project_id", F.variant_get(F.parse_json(text), "$.issues", "variant").alias("v"))
    spark = docs.sparkSession
    level = spark.sql(
        "SELECT project_id, CAST(pos AS STRING) AS path_id, variant_get(value, '$.events', 'variant') AS v, variant_get(value, '$.checkerName', 'string') AS checker "
        "FROM {lists}, LATERAL variant_explode(v)", lists=lists)
    found = []
    while True:
        events = cut_lineage(spark.sql(
            "SELECT project_id, checker, path_id, pos, variant_get(value, '$.filePathname', 'string') AS file, variant_get(value, '$.lineNumber', 'int') AS line, "
            "variant_get(value, '$.events', 'variant') AS v FROM {level}, LATERAL variant_explode(v)", level=level))
        if events.isEmpty():
            break
        found.append(events.filter("file IS NOT NULL AND line IS NOT NULL AND line > 0").select("project_id", "checker", "path_id", "pos", "file", "line"))
        level = events.filter("v IS NOT NULL").select("project_id", "checker", F.concat("path_id", F.lit("."), F.col("pos").cast("string")).alias("path_id"), "v")
    if not found:
        return docs.sparkSession.createDataFrame([], "project_id string, checker string, path_id string, pos int, file string, line int")
    return reduce(DataFrame.unionByName, found)


def canonical_findings(findings: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Findings with relative files; and those refused: bad path, bad line, empty flow or no location at all.

    ``findings(finding_id, affected array<struct<file_path, lines array<int>>>, flows array<array<struct<file_path, line_number>>>, ...)``.
    """
    fix = lambda p: relativise(p, F.lit(root))
    affected = F.transform("affected", lambda a: F.struct(fix(a["file_path"]).alias("file_path"), a["lines"].alias("lines")))
    flows = F.transform("flows", lambda p: F.transform(p, lambda n: F.struct(fix(n["file_path"]).alias("file_path"), n["line_number"].alias("line_number"))))
    rows = pin(findings, affected=affected, flows=flows)
    steps = F.flatten("flows")
    bad_lines = F.exists("affected", lambda a: (F.size(a["lines"]) < 1) | F.exists(a["lines"], lambda i: i < 1)) | F.exists(steps, lambda n: n["line_number"].isNull() | (n["line_number"] < 1))
    bad_path = F.exists("affected", lambda a: a["file_path"].isNull()) | F.exists(steps, lambda n: n["file_path"].isNull())
    problem = (
        F.when((F.size("affected") == 0) & (F.size("flows") == 0), "NO_LOCATIONS").when(F.exists("flows", lambda p: F.size(p) == 0), "EMPTY_FLOW")
        .when(bad_path, "INVALID_PATH").when(bad_lines, "INVALID_LINE"))
    checked = pin(rows, problem=problem)
    return checked.filter("problem IS NULL").drop("problem"), checked.filter("problem IS NOT NULL")


def content_key(family: Column, flows: Column, affected: Column) -> Column:
    """Key of a finding: its exact distinct paths and family, or without paths its locations and rule."""
    paths = F.array_sort(F.array_distinct(F.transform(flows, lambda p: F.array_join(F.transform(p, lambda n: F.concat_ws(":", n["file_path"], n["line_number"].cast("string"))), ">"))))
    places = F.array_sort(F.transform(affected, lambda a: F.concat_ws(":", a["file_path"], F.array_join(F.array_sort(a["lines"]).cast("array<string>"), ","))))
    return F.sha2(F.when(F.size(flows) > 0, F.concat(F.lit("P|"), family, F.lit("|"), F.array_join(paths, "|"))).otherwise(
        F.concat(F.lit("L|"), family, F.lit("|"), F.array_join(places, "|"))), 256)


def _is_test(path: Column) -> Column:
    return F.concat(F.lit("/"), path).contains("/test/")


def merge_findings(findings: DataFrame, family: Column, seq: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings merged by content key; the origins of every key as rows; and test-only findings left out.

    Origins stay rows: a key reported many times costs rows in a table, not one long array.
    """
    evidence = F.concat(F.transform("affected", lambda a: a["file_path"]), F.transform(F.flatten("flows"), lambda n: n["file_path"]))
    keyed = pin(findings, fingerprint=content_key(family, F.col("flows"), F.col("affected")))
    test_only = (F.size(evidence) > 0) & F.forall(evidence, _is_test)
    keyed = pin(keyed, __test=test_only)
    kept = keyed.filter("NOT __test").drop("__test")
    # The key, the first number and the count stand beside the first row, so that who asks for them alone carries no flows.
    rest = [c for c in kept.columns if c not in ("fingerprint", seq)]
    first = F.when(F.count(seq) == F.count(F.lit(1)), F.min(seq))
    merged = kept.groupBy("fingerprint").agg(first.alias(seq), F.min(F.struct(seq, *rest)).alias("__first"), F.count(F.lit(1)).alias("claims")).select(
        "fingerprint", seq, *[F.col("__first")[c].alias(c) for c in rest], "claims")
    origins = kept.select("fingerprint", "tool", F.col(seq).alias("origin"))
    return merged, origins, keyed.filter("__test").select("fingerprint", F.lit("test_only").alias("reason"))


def flow_hints(paths: DataFrame, keep: int = 16) -> DataFrame:
    """Located steps of each path with an owner method, first and last ``keep`` of long paths, and how many are left out.

    ``paths(path_id, pos, owner, line)``; owner is NULL for a step no method holds.
    """
    from pyspark.sql import Window as W

    held = paths.filter("owner IS NOT NULL")
    ordered = held.withColumn("rank", F.row_number().over(W.partitionBy("path_id").orderBy("pos")))
    sizes = paths.groupBy("path_id").agg(F.count(F.lit(1)).alias("steps"), F.count("owner").alias("n"))
    rows = ordered.join(sizes.filter("n >= 2"), "path_id")
    shown = rows.filter((F.col("n") <= 2 * keep) | (F.col("rank") <= keep) | (F.col("rank") > F.col("n") - keep))
    return shown.select("path_id", "pos", "owner", "line", (F.col("steps") - F.least("n", F.lit(2 * keep))).alias("omitted"))
