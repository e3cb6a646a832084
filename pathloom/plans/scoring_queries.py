"""Scoring against labels: suppliers are projects, target methods are the parts of returned bulk lines."""

from pyspark.sql import functions as F

from pathloom.bindings import oracle
from pathloom.operators import intervals as I
from pathloom.operators import scoring as S
from pathloom.plans.finding_queries import part_methods
from pathloom.registry import query

B = ("projects", "fixes")


def _part_file(c="l_partkey"):
    return F.concat(F.lit("P"), F.col(c).cast("string"))


def targets(t):
    rows = t.lineitem.filter("l_returnflag = 'R' AND l_linestatus = 'F'")
    return rows.select(F.col("l_suppkey").alias("project_id"), F.col("l_partkey").alias("method_id")).distinct()


def owned(t, where="l_returnflag = 'A'"):
    """Alert lines of a supplier's paths with the part method each lies in."""
    points = t.lineitem.filter(where).select(
        F.col("l_suppkey").alias("project_id"), F.col("l_orderkey").alias("path_id"), _part_file().alias("file"), F.col("l_linenumber").alias("line"))
    return I.owners(points, part_methods(t), "file", "line", "method_id")


OWNED = """WITH tg AS (SELECT DISTINCT l_suppkey AS project_id, l_partkey AS method_id FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'),
    st AS (SELECT l_suppkey AS project_id, l_orderkey AS path_id, l_partkey, l_linenumber AS line, l_linestatus, l_linenumber BETWEEN 1 + p_size % 3 AND 3 + p_size % 3 AS inm
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A'),
    hit AS (SELECT s.*, inm AND tg.method_id IS NOT NULL AS h FROM st s LEFT JOIN tg ON tg.project_id = s.project_id AND tg.method_id = s.l_partkey),
    ph AS (SELECT project_id, path_id, count(DISTINCT l_partkey) FILTER (h) AS matched FROM hit GROUP BY 1, 2),
    pm AS (SELECT project_id, count(*) AS paths, count(*) FILTER (matched > 0) AS tp_paths, CAST(max(matched) > 0 AS INT) AS recall, count(*) FILTER (matched > 0) / count(*) AS p FROM ph GROUP BY 1),
    mt AS (SELECT *, round(p, 6) AS precision, round(CASE WHEN recall + p > 0 THEN 2 * recall * p / (recall + p) ELSE 0 END, 6) AS f1 FROM pm)
"""


@query("c26_path_hits", OWNED + "SELECT project_id, path_id, matched FROM ph")
def c26(t):
    return S.path_hits(owned(t), targets(t)).select("project_id", "path_id", "matched")


@query("g04_intersect_targets", OWNED + "SELECT DISTINCT project_id, l_partkey AS method_id FROM hit WHERE h")
def g04(t):
    hits = owned(t).filter("owner IS NOT NULL").select("project_id", F.col("owner").alias("method_id"))
    return hits.intersect(targets(t).select("project_id", "method_id"))


@query("c27_location_hits", OWNED + "SELECT project_id, path_id, concat('P', l_partkey) AS file, line, l_partkey AS owner FROM hit WHERE h")
def c27(t):
    return S.location_hits(owned(t), targets(t)).select("project_id", "path_id", "file", "line", "owner")


def metrics(t, where="l_returnflag = 'A'"):
    return S.path_metrics(S.path_hits(owned(t, where), targets(t)))


@query("d20_path_metrics", OWNED + "SELECT project_id, paths, tp_paths, recall, precision, f1 FROM mt")
def d20(t):
    return metrics(t)


@query("d21_campaign", OWNED + """, s AS (SELECT s_suppkey, mt.*, CASE WHEN s_nationkey % 5 = 0 THEN 'failed' ELSE 'complete' END AS status, s_acctbal >= 0 AS scorable FROM supplier JOIN mt ON project_id = s_suppkey)
    SELECT count(*) AS expected, count(*) FILTER (status = 'complete') AS completed, count(*) FILTER (status = 'complete' AND scorable) AS scorable,
        CAST(sum(recall) FILTER (status = 'complete' AND scorable) AS BIGINT) AS detected, round(avg(recall) FILTER (status = 'complete' AND scorable), 6) AS detection_rate,
        round(avg(f1) FILTER (status = 'complete' AND scorable), 6) AS avg_f1, round(avg(1 - precision) FILTER (status = 'complete' AND scorable AND paths > 0), 6) AS avg_fdr_with_paths,
        count(*) FILTER (status <> 'complete') AS failed_or_unrun FROM s""")
def d21(t):
    status = F.when(F.col("s_nationkey") % 5 == 0, "failed").otherwise("complete")
    samples = t.supplier.join(metrics(t), F.col("s_suppkey") == F.col("project_id")).select("*", status.alias("status"), (F.col("s_acctbal") >= 0).alias("scorable"))
    return S.campaign(samples)


COMPARE = OWNED + """, ph2 AS (SELECT project_id, path_id, count(DISTINCT l_partkey) FILTER (h) AS matched FROM hit WHERE l_linestatus = 'F' GROUP BY 1, 2),
    l AS (SELECT project_id, count(*) AS paths, CAST(max(matched) > 0 AS INT) AS recall, count(*) FILTER (matched > 0) / count(*) AS p FROM ph2 GROUP BY 1),
    lm AS (SELECT project_id, recall, round(p, 6) AS precision, round(CASE WHEN recall + p > 0 THEN 2 * recall * p / (recall + p) ELSE 0 END, 6) AS f1 FROM l JOIN supplier ON s_suppkey = project_id WHERE s_nationkey <> 3),
    rm AS (SELECT mt.* FROM mt JOIN supplier ON s_suppkey = project_id WHERE s_nationkey <> 4)
"""


def _compared(t):
    keep = lambda n: t.supplier.filter(F.col("s_nationkey") != n).select(F.col("s_suppkey").alias("project_id"))
    left = metrics(t, "l_returnflag = 'A' AND l_linestatus = 'F'").join(keep(3), "project_id", "left_semi").withColumnRenamed("project_id", "sample")
    right = metrics(t).join(keep(4), "project_id", "left_semi").withColumnRenamed("project_id", "sample")
    return S.compare_runs(left, right)


@query("c28_compare_runs", COMPARE + """SELECT coalesce(l.project_id, r.project_id) AS sample, CASE WHEN r.recall IS NULL THEN 'left_only' WHEN l.recall IS NULL THEN 'right_only'
    WHEN l.recall < r.recall THEN 'improvement' WHEN l.recall > r.recall THEN 'regression' ELSE 'same' END AS change FROM lm l FULL JOIN rm r ON l.project_id = r.project_id""")
def c28(t):
    return _compared(t)[0]


@query("c28_compare_totals", COMPARE + """SELECT count(*) AS paired, count(*) FILTER (l.recall < r.recall) AS improvements, count(*) FILTER (l.recall > r.recall) AS regressions,
    count(*) FILTER (l.recall < r.recall) - count(*) FILTER (l.recall > r.recall) AS net_change, round(avg(l.recall), 6) AS l_recall_mean, round(avg(l.precision), 6) AS l_precision_mean, round(avg(l.f1), 6) AS l_f1_mean,
    round(avg(r.recall), 6) AS r_recall_mean, round(avg(r.precision), 6) AS r_precision_mean, round(avg(r.f1), 6) AS r_f1_mean FROM lm l JOIN rm r ON l.project_id = r.project_id""")
def c28_totals(t):
    return _compared(t)[1]


FIXROWS = """WITH pr AS (SELECT s_suppkey, concat('proj-', s_suppkey) AS project_slug, concat('ID-', s_nationkey) AS cve_id, concat('Repo', s_nationkey) AS repo, concat('c', s_suppkey, ';', ';c', s_suppkey + 1) AS fix_commits FROM supplier),
    fx AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fix_id, CASE WHEN l_suppkey % 2 = 0 THEN concat('proj-', l_suppkey) ELSE 'other' END AS project_slug,
        concat('ID-', s_nationkey) AS cve_id, concat('REPO', s_nationkey) AS repo, concat('c', l_suppkey) AS commit FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R')
"""


@query("c25_select_labels", FIXROWS + """SELECT p.project_slug, fix_id, 'exact_slug' AS selection FROM pr p JOIN fx ON fx.project_slug = p.project_slug
    UNION ALL SELECT p.project_slug, fix_id, 'cve_repository_fix' FROM pr p JOIN fx ON fx.cve_id = p.cve_id AND lower(fx.repo) = lower(p.repo) AND list_contains(string_split(fix_commits, ';'), commit)
    WHERE p.project_slug NOT IN (SELECT project_slug FROM fx)""")
def c25(t):
    s = lambda c: F.col(c).cast("string")
    projects = t.supplier.select(
        F.concat(F.lit("proj-"), s("s_suppkey")).alias("project_slug"), F.concat(F.lit("ID-"), s("s_nationkey")).alias("cve_id"), F.concat(F.lit("Repo"), s("s_nationkey")).alias("repo"),
        F.concat(F.lit("c"), s("s_suppkey"), F.lit(";;c"), (F.col("s_suppkey") + 1).cast("string")).alias("fix_commits"))
    fixes = t.lineitem.filter("l_returnflag = 'R'").join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey")).select(
        F.concat_ws("-", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey")).alias("fix_id"),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("proj-"), s("l_suppkey"))).otherwise("other").alias("project_slug"),
        F.concat(F.lit("ID-"), s("s_nationkey")).alias("cve_id"), F.concat(F.lit("REPO"), s("s_nationkey")).alias("repo"), F.concat(F.lit("c"), s("l_suppkey")).alias("commit"))
    return S.select_labels(projects, fixes)


def _windows(t):
    return t.part.select(_part_file("p_partkey").alias("file"), (1 + F.col("p_size") % 3).alias("start"), (6 + F.col("p_size") % 3).alias("end"))


@query("c30_read_coverage", """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS id, bool_or(l_linenumber >= 1 + p_size % 3 AND l_linenumber + CAST(l_quantity AS INT) % 5 <= 6 + p_size % 3) AS covered
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def c30(t):
    ident = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")])
    ranges = t.lineitem.select(ident.alias("id"), _part_file().alias("file"), F.col("l_linenumber").alias("first"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 5).alias("last"))
    return S.covered(ranges, _windows(t), "id").select("id", "covered")


@query("c31_patch_methods", oracle("""WITH m AS (SELECT p_partkey AS id, concat('part/P', p_partkey, '.java') AS file, p_name, p_brand, 1 + p_size % 3 AS s, 3 + p_size % 3 AS e, p_size, p_type FROM part
        UNION ALL SELECT p_partkey + 1000000000, concat('part/P', p_partkey, '.java'), p_name, p_brand, 50, 60, p_size, p_type FROM part WHERE p_size >= 44),
    g AS (SELECT f.file, f.class_name, f.method, count(m.id) AS n, min(m.id) AS id, min(s) AS s, min(e) AS e, min(p_size) AS ps FROM (SELECT DISTINCT file, class_name, method FROM fixes) f
        LEFT JOIN m ON m.file = f.file AND m.p_brand = f.class_name AND m.p_name = f.method AND m.p_type <> 'SMALL' GROUP BY 1, 2, 3)
    SELECT file, class_name, method, CASE WHEN n = 1 THEN id END AS method_id, CASE WHEN n = 1 THEN ps >= 10 AND ps % 4 <= e AND ps % 4 + 1 >= s END AS recalled,
        CASE WHEN n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'AMBIGUOUS_METHOD' ELSE 'METHOD_NOT_RESOLVED' END AS status FROM g""", "fixes"))
def c31(t):
    file = F.concat(F.lit("part/P"), F.col("p_partkey").cast("string"), F.lit(".java"))
    p = t.part.select("p_partkey", "p_size", "p_type", file.alias("file"), F.col("p_name").alias("name"), F.concat(F.lit("com.acme."), "p_brand").alias("type_name"))
    one = p.select(F.col("p_partkey").alias("method_id"), "p_type", "file", "name", "type_name", (1 + F.col("p_size") % 3).alias("start"), (3 + F.col("p_size") % 3).alias("end"))
    two = p.filter("p_size >= 44").select((F.col("p_partkey") + 1000000000).alias("method_id"), "p_type", "file", "name", "type_name", F.lit(50).alias("start"), F.lit(60).alias("end"))
    methods = one.unionByName(two).filter("p_type <> 'SMALL'").drop("p_type")
    windows = p.filter("p_size >= 10").select("file", (F.col("p_size") % 4).alias("w_start"), (F.col("p_size") % 4 + 1).alias("w_end"))
    return S.patch_methods(t.fixes, methods, windows)


POS = "((l_linenumber * 1000000) + l_partkey) * 10000 + l_suppkey"


def _nodes(t, where):
    return t.lineitem.filter(where).select(F.col("l_orderkey").alias("path_id"), F.expr(POS.replace("l_linenumber", "CAST(l_linenumber AS BIGINT)")).alias("pos"), F.col("l_suppkey").alias("owner"))


def _pairs_sql(where):
    return f"""(SELECT path_id, owner AS from_method, nx AS to_method, row_number() OVER (PARTITION BY path_id ORDER BY pos) - 1 AS hop FROM (
        SELECT path_id, pos, owner, lead(owner) OVER (PARTITION BY path_id ORDER BY pos) AS nx FROM (
            SELECT l_orderkey AS path_id, {POS.replace("l_linenumber * 1000000", "CAST(l_linenumber AS BIGINT) * 1000000")} AS pos, l_suppkey AS owner,
                lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY {POS.replace("l_linenumber * 1000000", "CAST(l_linenumber AS BIGINT) * 1000000")}) AS pv FROM lineitem WHERE {where})
        WHERE pv IS NULL OR pv <> owner) WHERE nx IS NOT NULL)"""


@query("e09_method_pairs", f"SELECT path_id, from_method, to_method, hop FROM {_pairs_sql('true')}")
def e09(t):
    return S.method_pairs(_nodes(t, "true"))


@query("c29_attribute_hops", f"""WITH h AS (SELECT DISTINCT from_method, to_method FROM {_pairs_sql("l_returnflag = 'R'")}), p AS (SELECT DISTINCT path_id, from_method, to_method FROM {_pairs_sql("l_returnflag = 'A'")}),
    x AS (SELECT from_method, to_method, path_id % 3 > 0 AS recalled, CASE WHEN path_id % 2 = 0 THEN path_id % 4 = 0 END AS mapped FROM {_pairs_sql("l_returnflag = 'N'")}),
    om AS (SELECT DISTINCT from_method, to_method FROM {_pairs_sql("l_linestatus = 'F'")}),
    pv AS (SELECT p.from_method, p.to_method, count(*) AS np, bool_or(o_orderstatus = 'F') AS sup, bool_or(o_orderstatus <> 'O') AS rev, bool_or(o_orderpriority = '1-URGENT') AS sel FROM p JOIN orders ON o_orderkey = path_id GROUP BY 1, 2),
    xs AS (SELECT from_method, to_method, count(*) AS se, count(*) FILTER (recalled) AS re, count(*) FILTER (recalled AND mapped IS NOT NULL) AS vl, coalesce(bool_or(recalled AND coalesce(mapped, false)), false) AS am FROM x GROUP BY 1, 2),
    j AS (SELECT h.*, np, sup, rev, sel, se, re, vl, am, om.from_method IS NOT NULL AS cut FROM h LEFT JOIN pv USING (from_method, to_method) LEFT JOIN xs USING (from_method, to_method)
        LEFT JOIN om ON om.from_method = h.from_method AND om.to_method = h.to_method)
    SELECT from_method, to_method, CASE WHEN np IS NOT NULL THEN CASE WHEN sup THEN 'VERIFIED' ELSE 'SPLICED_UNVERIFIED' END WHEN se IS NULL THEN 'STATIC_MISSING' WHEN re = 0 THEN 'EXPORTED_NOT_RECALLED' ELSE 'RECALLED_NOT_SPLICED' END AS status,
        CASE WHEN np IS NOT NULL AND NOT rev THEN CASE WHEN sel THEN 'REVIEW_NOT_RECORDED' ELSE 'NOT_SELECTED' END
            WHEN np IS NULL AND re > 0 THEN CASE WHEN cut THEN 'PROMPT_RANKING_TRUNCATED' WHEN vl > 0 AND NOT am THEN 'AST_MAPPING_FAILED' WHEN vl = 0 THEN 'NO_RECALLED_VALUE_BRIDGE' ELSE 'SELECTION_STAGE_UNOBSERVED' END END AS reason,
        coalesce(se, 0) AS static_edges, coalesce(re, 0) AS recalled_edges, coalesce(np, 0) AS n_paths FROM j""")
def c29(t):
    hops = S.method_pairs(_nodes(t, "l_returnflag = 'R'"))
    pairs = S.method_pairs(_nodes(t, "l_returnflag = 'A'"))
    pid = F.col("path_id")
    exports = S.method_pairs(_nodes(t, "l_returnflag = 'N'")).select("from_method", "to_method", (pid % 3 > 0).alias("recalled"), F.when(pid % 2 == 0, pid % 4 == 0).alias("mapped"))
    reviews = t.orders.filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("path_id"), F.when(F.col("o_orderstatus") == "F", "SUPPORTED").otherwise("REJECTED").alias("verdict"))
    selected = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("path_id"))
    return S.attribute_hops(hops, pairs, reviews, selected, exports, S.method_pairs(_nodes(t, "l_linestatus = 'F'")))


@query("e10_max_connected", """WITH s AS (SELECT l_orderkey AS id, concat(l_orderkey, ':', l_partkey) AS owner, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ci FROM lineitem),
    p AS (SELECT id, owner, row_number() OVER (PARTITION BY id ORDER BY ci) AS pi FROM s WHERE l_quantity <= 40),
    m AS (SELECT s.id, p.id AS pid, ci, ci - pi AS diag FROM s JOIN p USING (owner)), g AS (SELECT *, ci - row_number() OVER (PARTITION BY id, pid, diag ORDER BY ci) AS isle FROM m),
    r AS (SELECT id, pid, diag, isle, count(*) - 1 AS hops FROM g GROUP BY 1, 2, 3, 4)
    SELECT c.id AS chain_id, coalesce(max(hops), 0) AS max_connected_hops FROM (SELECT DISTINCT id FROM s) c LEFT JOIN r ON r.id = c.id GROUP BY 1""")
def e10(t):
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    owner = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))
    s = t.lineitem.select(F.col("l_orderkey").alias("chain_id"), owner.alias("owner"), "l_quantity", F.row_number().over(order).alias("pos"))
    kept = W.partitionBy("chain_id").orderBy("pos")
    paths = s.filter("l_quantity <= 40").select(F.col("chain_id").alias("path_id"), F.row_number().over(kept).alias("p"), "owner").withColumnRenamed("p", "pos")
    return S.max_connected(s.select("chain_id", "pos", "owner"), paths)


@query("g06_open_obligations", """WITH r AS (SELECT p_partkey AS owner, 1 + p_size AS f, 1 + p_size + CAST(floor(p_retailprice) AS INT) % 200 AS l FROM part),
    c AS (SELECT owner, unnest(generate_series(f, l, 40)) AS c_first, l FROM r), d AS (SELECT owner, c_first, least(c_first + 39, l) AS c_last FROM c)
    SELECT owner, concat('P', owner) AS file, c_first, c_last FROM d WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = owner AND l_quantity <= c_first AND c_last <= l_quantity + 10 * l_linenumber)""")
def g06(t):
    first = 1 + F.col("p_size")
    required = t.part.select(F.col("p_partkey").alias("owner"), _part_file("p_partkey").alias("file"), first.alias("first"), (first + F.col("p_retailprice").cast("int") % 200).alias("last"))
    start = F.col("l_quantity").cast("int")
    windows = t.lineitem.select(_part_file().alias("file"), start.alias("start"), (start + 10 * F.col("l_linenumber")).alias("end")).distinct()
    return S.open_obligations(required, windows)


@query("g07_missing_components", """WITH h AS (SELECT user_id AS case_id, bool_or(event_type = 'signup') AS i, bool_or(event_type IN ('view', 'click')) AS tr, bool_or(event_type = 'purchase') AS e FROM events
        WHERE event_type <> 'error' GROUP BY 1)
    SELECT case_id, concat_ws(',', CASE WHEN NOT i THEN 'EXTERNAL_INPUT' END, CASE WHEN NOT tr THEN 'TRANSFER' END, CASE WHEN NOT e THEN 'SECURITY_EFFECT' END) AS missing FROM h""")
def g07(t):
    kind = F.when(F.col("event_type") == "signup", "EXTERNAL_INPUT").when(F.col("event_type") == "purchase", "SECURITY_EFFECT").when(F.col("event_type") == "view", "WRAPPER_FLOW").otherwise("LIBRARY_FLOW")
    rows = t.events.filter("event_type <> 'error'").select(F.col("user_id").alias("case_id"), kind.alias("proposal_type"))
    return S.missing_components(rows).select("case_id", F.array_join("missing", ",").alias("missing"))


RECALL = """WITH q AS (SELECT l_suppkey AS case_id, l_partkey AS owner, sum(l_quantity) AS s FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, owner) AS rank FROM q),
    tg AS (SELECT DISTINCT l_suppkey AS case_id, l_partkey AS owner FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'),
    b AS (SELECT tg.*, rank AS best_rank FROM tg LEFT JOIN r USING (case_id, owner))
"""


def _recall(t):
    from pyspark.sql import Window as W

    scored = t.lineitem.filter("l_returnflag <> 'R'").groupBy(F.col("l_suppkey").alias("case_id"), F.col("l_partkey").alias("owner")).agg(F.sum("l_quantity").alias("s"))
    rows = scored.withColumn("rank", F.row_number().over(W.partitionBy("case_id").orderBy(F.col("s").desc(), "owner")))
    return S.recall_at(rows, targets(t).withColumnRenamed("project_id", "case_id"))


@query("d24_recall_ranks", RECALL + "SELECT case_id, owner, best_rank FROM b")
def d24(t):
    return _recall(t)[0]


@query("d24_recall_totals", RECALL + "SELECT case_id, count(*) AS targets, count(best_rank) AS recalled_all, count(*) FILTER (best_rank <= 10) AS recalled_10, count(*) FILTER (best_rank <= 30) AS recalled_30 FROM b GROUP BY 1")
def d24_totals(t):
    return _recall(t)[1]


@query("d25_recovery_summary", """WITH r AS (SELECT user_id, bool_or(event_type = 'purchase' AND value > 80) AS rec, bool_or(value > 5) AS causal, arg_max(event_type, event_id) AS flow, user_id % 7 AS project, avg(value) AS wall FROM events GROUP BY 1),
    a AS (SELECT count(*) AS selected_cases, count(DISTINCT project) AS selected_projects, count(*) FILTER (rec) AS recovered_cases, count(DISTINCT project) FILTER (rec) AS recovered_projects, count(DISTINCT flow) FILTER (rec) AS categories,
        count(*) FILTER (rec AND causal) AS causal_cases, round(avg(wall), 6) AS avg_wall_seconds FROM r)
    SELECT *, round(recovered_cases / selected_cases, 6) AS recovery_rate, recovered_cases > 0 AND causal_cases = recovered_cases AS causal_for_all, recovered_cases >= 5 AND recovered_projects >= 3 AS preferred_threshold_met,
        CASE WHEN recovered_cases >= 3 AND recovered_projects >= 2 AND categories >= 2 AND causal_cases = recovered_cases THEN 'PROCEED_M7' ELSE 'REVISE_WORK1_MECHANISM' END AS decision FROM a""")
def d25(t):
    rows = t.events.groupBy("user_id").agg(
        F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 80)).alias("recovered"), F.bool_or(F.col("value") > 5).alias("causal"),
        F.max_by("event_type", "event_id").alias("flow_type"), F.avg("value").alias("wall_seconds"))
    return S.recovery_summary(rows.select(F.col("user_id").alias("case_id"), (F.col("user_id") % 7).alias("project_id"), "recovered", "causal", "flow_type", "wall_seconds"))


@query("c43_path_matches", """WITH a AS (SELECT DISTINCT l_suppkey AS case_id, l_partkey AS part, 1 + p_size % 3 AS s, 3 + p_size % 3 AS e, p_size FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_linestatus = 'F'),
    n AS (SELECT l_suppkey AS case_id, l_orderkey AS path_id, l_partkey AS part, l_linenumber AS line, concat('m', l_partkey, ':', l_linenumber) AS ent FROM lineitem WHERE l_returnflag = 'A')
    SELECT n.case_id, path_id, max(CASE WHEN ent = concat('m', a.part, ':', 7) THEN 'METHOD' WHEN p_size % 5 = 0 THEN 'FILE' ELSE 'METHOD' END) AS level
    FROM n JOIN a ON a.case_id = n.case_id AND a.part = n.part WHERE ent = concat('m', a.part, ':', 7) OR p_size % 5 = 0 OR (line <= e AND s <= line) GROUP BY 1, 2""")
def c43(t):
    rows = t.lineitem.filter("l_returnflag = 'R' AND l_linestatus = 'F'").join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    whole = F.col("p_size") % 5 == 0
    annotations = rows.select(
        F.col("l_suppkey").alias("case_id"), F.concat(F.lit("m"), F.col("l_partkey").cast("string"), F.lit(":7")).alias("entity_id"), F.concat(F.lit("src/"), _part_file()).alias("file"),
        F.when(whole, 0).otherwise(1 + F.col("p_size") % 3).alias("start"), F.when(whole, 0).otherwise(3 + F.col("p_size") % 3).alias("end"), F.lit("").alias("method")).distinct()
    nodes = t.lineitem.filter("l_returnflag = 'A'").select(
        F.col("l_suppkey").alias("case_id"), F.col("l_orderkey").alias("path_id"), F.concat(F.lit("m"), F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("entity_id"),
        F.concat(F.lit("lib/"), _part_file()).alias("file"), F.col("l_linenumber").alias("start"), F.col("l_linenumber").alias("end"))
    return S.path_matches(nodes, annotations)


@query("c42_choose_target", oracle("""WITH h AS (SELECT concat(project_slug, file) AS case_id, class_name AS project, method AS name, file, coalesce(method_start, 0) AS line FROM fixes),
    fc AS (SELECT l_partkey AS id, arg_min(concat(l_orderkey, '-', l_linenumber, '-', l_suppkey), (l_linenumber, concat(l_orderkey, '-', l_linenumber, '-', l_suppkey))) AS call_id FROM lineitem WHERE l_returnflag = 'N' AND l_quantity >= 10 GROUP BY 1),
    c AS (SELECT p_brand AS project, p_partkey AS id, p_name, concat('P', p_partkey, '.java') AS base, 1 + p_size AS s, 1 + p_size + p_size % 3 AS e, p_size % 4 AS params, call_id FROM part JOIN fc ON fc.id = p_partkey WHERE p_size % 4 > 0),
    x AS (SELECT case_id, id, call_id, CASE WHEN name = p_name THEN 100 ELSE 0 END + CASE WHEN split_part(file, '/', 2) = base THEN 50 ELSE 0 END + CASE WHEN line > 0 AND line BETWEEN s AND e THEN 30 ELSE 0 END + params AS score,
        CASE WHEN line > 0 THEN -abs(s - line) ELSE 0 END AS away, -s AS early FROM h JOIN c USING (project))
    SELECT case_id, arg_max(id, (score, away, early, id)) AS entity_id, max(score) AS score, arg_max(call_id, (score, away, early, id)) AS call_id FROM x GROUP BY 1""", "fixes"))
def c42(t):
    hints = t.fixes.select(F.concat("project_slug", "file").alias("case_id"), F.col("class_name").alias("project"), F.col("method").alias("name"), "file", F.coalesce("method_start", F.lit(0)).alias("line"))
    start = 1 + F.col("p_size")
    callables = t.part.select(F.col("p_brand").alias("project"), F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.concat(F.lit("src/part/P"), F.col("p_partkey").cast("string"), F.lit(".java")).alias("file"),
                              start.alias("start"), (start + F.col("p_size") % 3).alias("end"), (F.col("p_size") % 4).alias("params"))
    call = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey")])
    calls = t.lineitem.filter("l_returnflag = 'N'").select(F.col("l_partkey").alias("entity_id"), call.alias("call_id"), F.col("l_linenumber").alias("line"), F.when(F.col("l_quantity") >= 10, 1).otherwise(0).alias("args"))
    return S.choose_target(hints, callables, calls)
