"""Reports: each order is a project with one SARIF run; results are return flags, code flows are suppliers, steps are lines."""

from pyspark.sql import functions as F

from pathloom.bindings import oracle
from pathloom.operators import intervals as I
from pathloom.operators import pools as P
from pathloom.registry import query
from pathloom.session import stored
from pathloom.sources import findings as S

STEPS = """WITH raw AS (SELECT concat('o', l_orderkey) AS project_id, l_orderkey, l_returnflag AS rule_id, l_suppkey AS supp, l_linenumber AS line, l_partkey AS part, l_quantity,
        CASE WHEN l_quantity = 50 THEN 'https://ext.example/P' WHEN l_discount >= 0.095 THEN 'file:///repo/src/part/P' ELSE 'part/P' END AS pre FROM lineitem),
    steps AS (SELECT *, concat(pre, part, '.java') AS file, concat('src/part/P', part, '.java') AS rel,
        dense_rank() OVER (PARTITION BY l_orderkey ORDER BY rule_id) - 1 AS ri, dense_rank() OVER (PARTITION BY l_orderkey, rule_id ORDER BY supp) - 1 AS fi FROM raw),
    native AS (SELECT concat(project_id, ':r0:result', ri, ':flow', fi, ':thread0') AS native_path_id, project_id, rule_id, ri, fi,
        string_agg(concat(file, '#', line), '>' ORDER BY line, file) AS locations, count(*) AS n FROM steps GROUP BY ALL)
"""


def reports(t):
    """One SARIF text per order, assembled from its lines; every nested list is bounded by the order's size."""
    uri = F.concat(
        F.when(F.col("l_quantity") == 50, "https://ext.example/P").when(F.col("l_discount") >= 0.095, "file:///repo/src/part/P").otherwise("part/P"),
        F.col("l_partkey").cast("string"), F.lit(".java"))
    base = F.when((F.col("l_quantity") != 50) & (F.col("l_discount") < 0.095), "SRC")
    place = F.struct(F.struct(uri.alias("uri"), base.alias("uriBaseId")).alias("artifactLocation"), F.struct(F.col("l_linenumber").alias("startLine"), (F.col("l_linenumber") + 2).alias("startColumn")).alias("region"))
    step = F.struct(F.col("l_linenumber").alias("line"), uri.alias("uri"), F.struct(F.struct(place.alias("physicalLocation")).alias("location")).alias("step"))
    # Lines are dealt by order once, which serves all three groupings.
    lines = t.lineitem.select("l_orderkey", "l_returnflag", "l_suppkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount").repartition("l_orderkey")
    flows = lines.groupBy("l_orderkey", "l_returnflag", "l_suppkey").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    thread = F.struct(F.transform("steps", lambda s: s["step"]).alias("locations"))
    flow = F.struct(F.col("l_suppkey").alias("k"), F.struct(F.array(thread).alias("threadFlows")).alias("flow"), F.try_element_at("steps", F.lit(1))["step"]["location"].alias("first"))
    results = flows.groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list(flow)).alias("flows"))
    tags = F.when(F.col("l_returnflag") == "A", F.array(F.lit("external/cwe/cwe-73")))
    result = F.struct(
        F.col("l_returnflag").alias("k"),
        F.struct(F.col("l_returnflag").alias("ruleId"), F.struct(F.lit("found").alias("text")).alias("message"), F.struct(tags.alias("tags")).alias("properties"),
                 F.array(F.col("flows")[0]["first"]).alias("locations"), F.transform("flows", lambda f: f["flow"]).alias("codeFlows")).alias("result"))
    docs = results.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(result)).alias("results"))
    rule = lambda name, *tags: F.struct(F.lit(name).alias("id"), F.struct(F.array(*map(F.lit, tags)).alias("tags")).alias("properties"))
    rules = F.array(rule("R", "external/cwe/cwe-079", "security"), rule("A", "external/cwe/cwe-022", "maintainability"))
    bases = F.create_map(F.lit("SRC"), F.struct(F.lit("src/main").alias("uri"), F.lit("ROOT").alias("uriBaseId")), F.lit("ROOT"), F.struct(F.lit("file:///repo/").alias("uri"), F.lit(None).cast("string").alias("uriBaseId")))
    run = F.struct(F.struct(F.struct(F.lit("scanner").alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), bases.alias("originalUriBaseIds"),
                   F.transform("results", lambda r: r["result"]).alias("results"))
    return docs.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("project_id"), F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("text"))


def parsed(t):
    return S.parse_sarif(reports(t))


def native(t):
    return S.sarif_native_paths(parsed(t))


@query("a06_sarif_locations", STEPS + """SELECT project_id, ri AS result_index, file, line FROM steps
    UNION ALL SELECT project_id, ri, arg_min(file, (line, file)), arg_min(line, (line, file)) FROM steps WHERE fi = 0 GROUP BY 1, 2""")
def a06(t):
    return S.sarif_locations(parsed(t)).select("project_id", "result_index", "file", "line")


@query("a07_sarif_native_paths", STEPS + "SELECT native_path_id, project_id, rule_id, locations FROM native")
def a07(t):
    places = F.array_join(F.transform("locations", lambda p: F.concat(p["file"], F.lit("#"), p["line"].cast("string"))), ">")
    return native(t).select("native_path_id", "project_id", "rule_id", places.alias("locations"))


def canonical(t):
    return S.canonical_sarif(parsed(t), "/repo")


@query("a08_canonical_sarif", STEPS + """SELECT project_id, ri AS result_index, rule_id, CASE rule_id WHEN 'R' THEN 'CWE-79' WHEN 'A' THEN 'CWE-22,CWE-73' ELSE '' END AS cwes,
    CASE rule_id WHEN 'R' THEN 'CWE-79' ELSE '' END AS cwe, count(DISTINCT fi) AS n_paths, string_agg(concat(rel, '#', line, ':', line + 2, '-', line), '>' ORDER BY fi, line, file) AS steps,
        arg_min(concat(rel, '#', line), (line, file)) FILTER (fi = 0) AS affected
    FROM steps GROUP BY 1, 2, 3 HAVING max(l_quantity) < 50""")
def a08(t):
    place = lambda p: F.format_string("%s#%d:%d-%d", p["file_path"], p["line_number"], p["column"], p["end_line"])
    steps = F.array_join(F.transform(F.flatten("paths"), place), ">")
    affected = F.array_join(F.transform("affected_files", lambda f: F.concat(f["file_path"], F.lit("#"), F.array_join(f["line_numbers"], ","))), ">")
    return canonical(t)[0].select(
        "project_id", "result_index", "rule_id", F.array_join("cwes", ",").alias("cwes"), "cwe", F.size("paths").alias("n_paths"), steps.alias("steps"), affected.alias("affected"))


@query("a08_refused_findings", STEPS + "SELECT project_id, ri AS result_index, 'INVALID_PATH' AS problem FROM steps GROUP BY 1, 2 HAVING max(l_quantity) = 50")
def a08_refused(t):
    return canonical(t)[1].select("project_id", "result_index", "problem")


@query("d16_report_counts", STEPS + "SELECT project_id, count(DISTINCT ri) AS alert_count, count(DISTINCT (ri, fi)) AS path_count FROM steps GROUP BY 1")
def d16(t):
    return S.report_counts(parsed(t))


EVENTS = """WITH e AS (SELECT l_orderkey, l_suppkey, l_linenumber AS line, l_partkey AS part, l_discount >= 0.08 AS nested,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem)
    SELECT concat('o', l_orderkey) AS project_id, '0' AS path_id, pos, concat('src/P', part) AS file, line FROM e
    UNION ALL SELECT concat('o', l_orderkey), concat('0.', pos), 0, concat('src/S', l_suppkey), line + 100 FROM e WHERE nested"""


@query("a09_event_traces", EVENTS)
def a09(t):
    line, part = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    inner = F.struct(F.concat(F.lit("src/S"), F.col("l_suppkey").cast("string")).alias("filePathname"), (line + 100).alias("lineNumber"))
    event = F.struct(line.alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"), F.struct(
        F.concat(F.lit("src/P"), part).alias("filePathname"), line.alias("lineNumber"), F.when(F.col("l_discount") >= 0.08, F.array(inner)).alias("events")).alias("event"))
    docs = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(event)).alias("events"))
    issue = F.struct(F.lit("TAINTED").alias("checkerName"), F.transform("events", lambda e: e["event"]).alias("events"))
    texts = docs.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("project_id"), F.to_json(F.struct(F.array(issue).alias("issues"))).alias("text"))
    return S.event_traces(texts).select("project_id", "path_id", F.col("pos").cast("long").alias("pos"), "file", "line")


def raw_findings(t):
    """A finding per order and supplier: one flow over its lines, and the part files as affected places."""
    line = F.col("l_linenumber")
    folder = F.when(F.col("l_suppkey") % 5 == 0, "src/test/P").otherwise("src/main/P")
    path = lambda x: F.concat(F.when(x["q"] >= 49, "/elsewhere/").when(x["q"] >= 25, "/repo/").otherwise(""), folder, x["p"].cast("string"))
    node = lambda x: F.struct(path(x).alias("file_path"), x["k"].alias("line_number"))
    rows = t.lineitem.groupBy("l_orderkey", "l_suppkey", "l_returnflag").agg(F.array_sort(F.collect_list(F.struct(line.alias("k"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q")))).alias("s"))
    return rows.withColumn("s", F.transform("s", lambda x: F.struct(x["k"].alias("k"), node(x).alias("n")))).select(
        (F.col("l_orderkey") * 100000 + F.col("l_suppkey")).alias("seq"), F.col("l_returnflag").alias("category"), F.concat(F.lit("tool-"), "l_returnflag").alias("tool"),
        F.when(F.col("l_returnflag") == "N", F.array().cast("array<array<struct<file_path:string,line_number:int>>>")).otherwise(F.array(F.transform("s", lambda x: x["n"]))).alias("flows"),
        F.transform("s", lambda x: F.struct(x["n"]["file_path"].alias("file_path"), F.array(x["k"]).alias("lines"))).alias("affected"))


RAW = """WITH r AS (SELECT l_orderkey * 100000 + l_suppkey AS seq, l_returnflag AS category, l_suppkey, l_linenumber AS line, l_quantity,
        concat(CASE WHEN l_suppkey % 5 = 0 THEN 'src/test/P' ELSE 'src/main/P' END, l_partkey) AS file, l_partkey FROM lineitem),
    f AS (SELECT seq, category, l_suppkey, bool_or(l_quantity >= 49) AS bad, string_agg(concat(file, ':', line), '>' ORDER BY line, l_partkey, l_quantity) AS trail,
        list_sort(list(concat(file, ':', line))) AS places FROM r GROUP BY 1, 2, 3)
"""


@query("a10_canonical_findings", RAW + "SELECT seq, category, trail FROM f WHERE NOT bad")
def a10(t):
    good, _ = S.canonical_findings(raw_findings(t), "/repo")
    trail = F.array_join(F.transform("affected", lambda a: F.concat(a["file_path"], F.lit(":"), a["lines"][0].cast("string"))), ">")
    return good.select("seq", "category", trail.alias("trail"))


@query("a10_refused_findings", RAW + "SELECT seq, category, 'INVALID_PATH' AS problem FROM f WHERE bad")
def a10_refused(t):
    return S.canonical_findings(raw_findings(t), "/repo")[1].select("seq", "category", "problem")


def merged(t):
    """The findings of two scanners that agree on all orders, so that whole flows and places meet under one content key."""
    good, _ = S.canonical_findings(raw_findings(t), "/repo")
    told = F.explode(F.array(F.struct("tool", "seq"), F.struct(F.lit("second").alias("tool"), (F.col("seq") + SECOND).alias("seq")))).alias("by")
    both = good.select(*[c for c in good.columns if c not in ("tool", "seq")], told).select("*", "by.*").drop("by")
    return S.merge_findings(both, F.col("category"), "seq")


SECOND = 10**15
MERGED = RAW + f""", g AS (SELECT *, concat(CASE WHEN category = 'N' THEN 'L|' ELSE 'P|' END, category, '|', CASE WHEN category = 'N' THEN array_to_string(places, '|') ELSE trail END) AS key
        FROM (SELECT *, concat('tool-', category) AS tool FROM f UNION ALL SELECT * REPLACE (seq + {SECOND} AS seq), 'second' FROM f) WHERE NOT bad)
"""


@query("d34_merge_findings", MERGED + "SELECT sha256(key) AS fingerprint, min(seq) AS seq, count(*) AS claims FROM g WHERE l_suppkey % 5 <> 0 GROUP BY 1")
def d34(t):
    return merged(t)[0].select("fingerprint", "seq", "claims")


@query("d34_origins", MERGED + "SELECT sha256(key) AS fingerprint, tool, seq AS origin FROM g WHERE l_suppkey % 5 <> 0")
def d34_origins(t):
    return merged(t)[1]


@query("d34_test_only", MERGED + "SELECT sha256(key) AS fingerprint, 'test_only' AS reason FROM g WHERE l_suppkey % 5 = 0")
def d34_test_only(t):
    return merged(t)[2]


POOL = STEPS + """, pool AS (SELECT native_path_id, concat('cand-', native_path_id) AS candidate_path_id FROM native WHERE NOT (rule_id = 'N' AND n >= 2))
"""


def pools(t):
    """Native paths and those a later step kept; reports are read once for both."""
    rows = stored(native(t).select("native_path_id", "project_id", "rule_id", F.size("locations").alias("n")))
    kept = rows.filter("NOT (rule_id = 'N' AND n >= 2)").select("native_path_id", F.concat(F.lit("cand-"), "native_path_id").alias("candidate_path_id"))
    return rows.select("native_path_id", "project_id"), kept


@query("c24_pool_coverage", POOL + "SELECT n.native_path_id, project_id, p.native_path_id IS NOT NULL AS covered, candidate_path_id FROM native n LEFT JOIN pool p USING (native_path_id)")
def c24(t):
    return P.pool_coverage(*pools(t))


@query("c24_coverage_totals", POOL + """SELECT count(*) AS expected, count(p.native_path_id) AS covered, round(count(p.native_path_id) / count(*), 6) AS rate, count(*) - count(p.native_path_id) AS lost
    FROM native n LEFT JOIN pool p USING (native_path_id)""")
def c24_totals(t):
    return P.coverage_totals(P.pool_coverage(*pools(t)))


@query("d15_preservation", POOL + """SELECT count(*) AS parsed, count(p.native_path_id) AS adapted, count(*) - count(p.native_path_id) AS lost, CAST(0 AS BIGINT) AS duplicates,
    round(count(p.native_path_id) / count(*), 6) AS preservation_rate, 'FAIL' AS status FROM native n LEFT JOIN pool p USING (native_path_id)""")
def d15(t):
    return P.preservation(*pools(t), "native_path_id")


@query("g03_losses", POOL + "SELECT native_path_id FROM native EXCEPT SELECT native_path_id FROM pool")
def g03(t):
    return P.losses(*pools(t), "native_path_id")


DECLS = "decls AS (SELECT p_partkey, 1 + p_size % 3 AS s, 3 + p_size % 3 AS e FROM part)"


def part_methods(t):
    return t.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("file"), F.col("p_partkey").alias("method_id"),
                         (1 + F.col("p_size") % 3).alias("start"), (3 + F.col("p_size") % 3).alias("end"))


@query("i13_flow_hints", f"""WITH {DECLS}, p AS (SELECT o_custkey AS path_id, concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), 20, '0'), l_linenumber, lpad(CAST(l_partkey AS VARCHAR), 20, '0'), lpad(CAST(l_suppkey AS VARCHAR), 20, '0')) AS pos, l_linenumber AS line,
        CASE WHEN l_linenumber BETWEEN s AND e THEN p_partkey END AS owner FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN decls ON p_partkey = l_partkey),
    h AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY pos) AS rk, count(*) OVER (PARTITION BY path_id) AS n FROM p WHERE owner IS NOT NULL),
    c AS (SELECT path_id, count(*) AS steps FROM p GROUP BY 1)
    SELECT path_id, pos, owner, line, steps - least(n, 32) AS omitted FROM h JOIN c USING (path_id) WHERE n >= 2 AND (n <= 32 OR rk <= 16 OR rk > n - 16)""")
def i13(t):
    pad = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    steps = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("path_id"), F.concat_ws("-", pad("l_orderkey"), F.col("l_linenumber").cast("string"), pad("l_partkey"), pad("l_suppkey")).alias("pos"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("file"), F.col("l_linenumber").alias("line"))
    owned = I.owners(steps, part_methods(t), "file", "line", "method_id")
    return S.flow_hints(owned.select("path_id", "pos", "owner", "line"))


@query("c11_innermost_owner", """WITH d AS (SELECT p_brand AS k, p_partkey AS id, 1 + p_size AS s, 1 + p_size + p_partkey % 40 AS e FROM part),
    pt AS (SELECT DISTINCT p_brand AS k, CAST(l_quantity AS INT) AS line FROM lineitem JOIN part ON p_partkey = l_suppkey),
    h AS (SELECT pt.k, line, id, s, e FROM pt JOIN d ON d.k = pt.k AND line BETWEEN s AND e),
    x AS (SELECT a.k, a.line, a.id FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.k = a.k AND b.line = a.line AND a.s <= b.s AND b.e <= a.e AND (a.s, a.e) <> (b.s, b.e)))
    SELECT pt.k AS file, pt.line, count(x.id) AS n_owners, CASE WHEN count(x.id) = 1 THEN min(x.id) END AS owner,
        CASE count(x.id) WHEN 0 THEN 'unmapped' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS mapping FROM pt LEFT JOIN x ON x.k = pt.k AND x.line = pt.line GROUP BY 1, 2""")
def c11(t):
    decls = t.part.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("id"), (1 + F.col("p_size")).alias("start"), (1 + F.col("p_size") + F.col("p_partkey") % 40).alias("end"))
    lines = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_suppkey"))
    return I.owners(lines.select(F.col("p_brand").alias("file"), F.col("l_quantity").cast("int").alias("line")).distinct(), decls, "file", "line", "id")


@query("c12_map_alerts", f"""WITH {DECLS}, m AS (SELECT l_orderkey, CASE WHEN l_linenumber BETWEEN s AND e THEN 'unique' ELSE 'unmapped' END AS mapping FROM lineitem JOIN decls ON p_partkey = l_partkey)
    SELECT count(DISTINCT l_orderkey) AS alerts, count(*) AS locations, count(*) FILTER (mapping = 'unique') AS uniquely_mapped, round(count(*) FILTER (mapping = 'unique') / count(*), 6) AS mapping_rate,
        count(DISTINCT l_orderkey) FILTER (mapping = 'unique') AS alerts_with_unique_method FROM m""")
def c12(t):
    from pathloom.operators.scoring import alert_mapping

    points = t.lineitem.select(F.col("l_orderkey").alias("alert_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("file"), F.col("l_linenumber").alias("line"))
    return alert_mapping(I.owners(points, part_methods(t), "file", "line", "method_id"))
