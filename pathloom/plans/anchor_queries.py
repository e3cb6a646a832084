"""Anchors, funnels and attribution over candidates (orders) and their value rows (lines)."""

from pyspark.sql import functions as F

from pathloom.bindings import oracle
from pathloom.functions.scalars import distance_bucket
from pathloom.operators import anchors as A
from pathloom.operators import attribution as T
from pathloom.registry import query

ANCHORS = """WITH anchors AS (
    SELECT c.candidate_id, c.project_id, c.kind AS candidate_kind, c.side,
        CASE WHEN n = 1 THEN a.anchor_kind END AS anchor_kind, CASE WHEN n = 1 THEN a.value_role END AS value_role,
        CASE WHEN n = 1 THEN a.method_identity END AS method_identity, CASE WHEN n = 1 THEN nullif(a.call_identity, '') END AS call_identity,
        CASE WHEN n = 1 AND a.argument_index >= 0 THEN a.argument_index END AS argument_index,
        CASE WHEN n = 1 THEN a.anchor_file END AS anchor_file, CASE WHEN n = 1 THEN a.anchor_line END AS anchor_line,
        CASE WHEN n IS NULL THEN 'UNMAPPABLE' WHEN n = 1 THEN 'MAPPED' ELSE 'ADAPTER_ERROR' END AS mapping_status,
        CASE WHEN n IS NULL THEN 'NO_GENERIC_AST_VALUE_MATCH' WHEN n = 1 THEN 'GENERIC_AST_VALUE_MATCH'
            ELSE 'AMBIGUOUS_GENERIC_AST_VALUE_MATCH' END AS mapping_reason, 'SUCCESS' AS query_status
    FROM candidates c LEFT JOIN (SELECT candidate_entity, count(*) AS n, any_value(anchor_kind) AS anchor_kind, any_value(value_role) AS value_role,
            any_value(method_identity) AS method_identity, any_value(call_identity) AS call_identity, any_value(argument_index) AS argument_index,
            any_value(anchor_file) AS anchor_file, any_value(anchor_line) AS anchor_line
        FROM (SELECT DISTINCT * FROM anchor_rows) GROUP BY 1) a ON a.candidate_entity = c.entity),
nodes AS (SELECT DISTINCT candidate_entity, node_kind, node_entity, node_file, node_line, node_method FROM reach_rows),
ranked AS (SELECT *, row_number() OVER (PARTITION BY candidate_entity
        ORDER BY concat('"', node_entity, '","kind":"', node_kind, '","location":{"file":"', node_file, '","line":', node_line, '},"m":"', node_method)) AS rn FROM nodes),
funnels AS (
    SELECT a.*, coalesce(n, 0) AS reachable_node_count, coalesce(reps, '') AS representative_nodes,
        CASE WHEN mapping_status = 'UNMAPPABLE' THEN concat('UNMAPPABLE_', a.side) WHEN mapping_status = 'ADAPTER_ERROR' THEN 'ADAPTER_ERROR'
            WHEN coalesce(n, 0) > 0 THEN 'ACTIVE' WHEN a.side = 'INPUT' THEN 'EMPTY_FW' ELSE 'EMPTY_BW' END AS funnel_status
    FROM anchors a JOIN candidates c USING (candidate_id) LEFT JOIN (
        SELECT candidate_entity, count(*) AS n, string_agg(CASE WHEN rn <= 5 THEN node_entity END, '|' ORDER BY rn) AS reps FROM ranked GROUP BY 1) r
        ON r.candidate_entity = c.entity)
"""
B = ("candidates", "anchor_rows", "reach_rows")


def anchors(t):
    return A.map_anchors(t.candidates, t.anchor_rows)


def funnels(t):
    return A.funnel(anchors(t), t.candidates, t.reach_rows)


@query("c01_map_anchors", oracle(ANCHORS + "SELECT * FROM anchors", *B))
def c01(t):
    return anchors(t)


@query("d01_reach_funnel", oracle(ANCHORS + "SELECT candidate_id, funnel_status, reachable_node_count, representative_nodes FROM funnels", *B))
def d01(t):
    return funnels(t).select("candidate_id", "funnel_status", "reachable_node_count", F.array_join("representative_nodes", "|").alias("representative_nodes"))


@query("d02_funnel_summary", oracle(ANCHORS + """SELECT side, count(*) AS candidate_total,
    count(*) FILTER (mapping_status = 'MAPPED') AS anchor_mappable, count(*) FILTER (funnel_status LIKE 'UNMAPPABLE%') AS anchor_unmappable,
    count(*) FILTER (funnel_status = 'ADAPTER_ERROR') AS adapter_error, count(*) FILTER (reachable_node_count > 0) AS non_empty,
    count(*) FILTER (funnel_status LIKE 'EMPTY%') AS empty FROM funnels GROUP BY side""", *B))
def d02(t):
    return A.funnel_summary(funnels(t))


def _frontiers(t):
    """A frontier row per line of the order it shares with the candidate of its part key."""
    c = t.candidates
    left = c.filter("side = 'INPUT'").select(F.col("k"), F.col("candidate_id").alias("input_candidate_id"), "project_id")
    right = c.filter("side = 'EFFECT'").select(F.col("k").alias("pk"), F.col("candidate_id").alias("effect_candidate_id"))
    reason = (
        F.when(F.col("l_linenumber") == 1, "SAME_METHOD").when(F.col("l_linenumber") == 2, "CALL_ADJACENT")
        .when(F.col("l_linenumber") == 3, "SAME_RECEIVER").when(F.col("l_linenumber") == 4, "FIELD_RELATED")
        .when(F.col("l_linenumber") == 5, "NEAR_CALL_REGION").when(F.col("l_linenumber") == 6, "SOMETHING_ELSE")
    )
    return (
        t.lineitem.filter("l_returnflag = 'A'").join(left, F.col("l_orderkey") == F.col("k")).join(right, F.col("l_partkey") == F.col("pk"))
        .select("project_id", "input_candidate_id", "effect_candidate_id", reason.alias("frontier_reason"),
                (F.col("l_linenumber") - 2).alias("structural_distance"),
                F.when(F.col("l_quantity") >= 45, "FIELD_READ").otherwise("EXPR").alias("fw_kind"),
                F.when(F.col("l_quantity") <= 5, "receiver").otherwise("PARAMETER").alias("bw_kind"),
                F.when(F.col("l_linestatus") == "O", "PARAMETER").alias("input_role"), F.lit("CALL_ARGUMENT").alias("effect_role"),
                F.col("l_suppkey").alias("fw_node"), F.col("l_linenumber").alias("bw_node"))
    )


FRONTIERS = """WITH frontiers AS (
    SELECT i.project_id, i.candidate_id AS input_candidate_id, e.candidate_id AS effect_candidate_id,
        CASE l_linenumber WHEN 1 THEN 'SAME_METHOD' WHEN 2 THEN 'CALL_ADJACENT' WHEN 3 THEN 'SAME_RECEIVER' WHEN 4 THEN 'FIELD_RELATED'
            WHEN 5 THEN 'NEAR_CALL_REGION' WHEN 6 THEN 'SOMETHING_ELSE' END AS frontier_reason, l_linenumber - 2 AS structural_distance,
        CASE WHEN l_quantity >= 45 THEN 'FIELD_STATE_LIKE' WHEN l_quantity <= 5 OR l_linenumber = 3 THEN 'OBJECT_RECEIVER_RELATED'
            WHEN l_linenumber = 1 THEN 'SAME_METHOD_UNRESOLVED' WHEN l_linenumber = 2 THEN 'DIRECT_DATA_CALL_NEAR_MISS'
            WHEN l_linenumber = 5 THEN 'CALL_BOUNDARY_UNRESOLVED' ELSE 'UNKNOWN_STRUCTURAL' END AS likely_class,
        CASE WHEN l_quantity >= 45 OR l_quantity <= 5 OR l_linenumber IN (1, 3) THEN 'HIGH' WHEN l_linenumber IN (2, 5) THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
        l_suppkey AS fw_node, l_linenumber AS bw_node
    FROM lineitem JOIN candidates i ON l_orderkey = i.k AND i.side = 'INPUT' JOIN candidates e ON l_partkey = e.k AND e.side = 'EFFECT'
    WHERE l_returnflag = 'A')
"""


@query("p07_classify_frontier", oracle(FRONTIERS + """SELECT input_candidate_id, effect_candidate_id, fw_node, bw_node, likely_class, confidence FROM frontiers""", "candidates"))
def p07(t):
    return T.classify_frontier(_frontiers(t)).select("input_candidate_id", "effect_candidate_id", "fw_node", "bw_node", "likely_class", "confidence")


@query("d10_frontier_shares", oracle(FRONTIERS + """SELECT likely_class, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percentage
    FROM frontiers GROUP BY 1""", "candidates"))
def d10_frontiers(t):
    return T.share(T.classify_frontier(_frontiers(t)), "likely_class")


@query("d10_distance_shares", oracle(FRONTIERS + """SELECT CASE WHEN structural_distance < 0 THEN 'UNKNOWN' WHEN structural_distance >= 3 THEN '3+'
    ELSE CAST(structural_distance AS VARCHAR) END AS bucket, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percentage
    FROM frontiers GROUP BY 1""", "candidates"))
def d10_distance(t):
    return T.share(_frontiers(t).withColumn("bucket", distance_bucket(F.col("structural_distance"))), "bucket")


@query("d11_distinct_levels", oracle(FRONTIERS + """SELECT count(*) AS raw_count,
    count(DISTINCT (project_id, input_candidate_id, effect_candidate_id, fw_node, bw_node)) AS node_pairs,
    count(DISTINCT (project_id, input_candidate_id, effect_candidate_id)) AS endpoint_pairs,
    count(DISTINCT (project_id, fw_node, frontier_reason)) AS method_regions FROM frontiers""", "candidates"))
def d11(t):
    reason = F.coalesce("frontier_reason", F.lit("<none>"))
    return T.distinct_levels(_frontiers(t).withColumn("frontier_reason", reason), {
        "node_pairs": ["project_id", "input_candidate_id", "effect_candidate_id", "fw_node", "bw_node"],
        "endpoint_pairs": ["project_id", "input_candidate_id", "effect_candidate_id"],
        "method_regions": ["project_id", "fw_node", "frontier_reason"],
    })


@query("d13_concentration", oracle(FRONTIERS + """, g AS (SELECT project_id, count(*) AS n FROM frontiers GROUP BY 1),
    r AS (SELECT n, row_number() OVER (ORDER BY n DESC, project_id) AS rn, sum(n) OVER () AS total FROM g),
    u AS (SELECT avg(CASE WHEN likely_class = 'UNKNOWN_STRUCTURAL' THEN 1.0 ELSE 0 END) AS us FROM frontiers),
    v AS (SELECT max(n) / max(total) AS t1, sum(CASE WHEN rn <= 3 THEN n END) / max(total) AS t3, max(us) AS us FROM r, u)
    SELECT round(t1, 6) AS top1_share, round(t3, 6) AS top3_share, round(us, 6) AS unknown_share, CASE WHEN t1 >= 0.8 THEN
        'PROJECT_CONCENTRATED_EVIDENCE; INSUFFICIENT_EVIDENCE_FOR_E2' WHEN us >= 0.5 THEN 'INSUFFICIENT_EVIDENCE_FOR_E2'
        ELSE 'FIX_W1_E1_IMPLEMENTATION' END AS recommendation FROM v""", "candidates"))
def d13(t):
    return T.concentration(T.classify_frontier(_frontiers(t)), "project_id", "likely_class")


@query("p09_diagnose", oracle(ANCHORS + "," + FRONTIERS[5:] + """, conn AS (
        SELECT DISTINCT unnest([i.candidate_id, e.candidate_id]) AS candidate_id FROM lineitem
        JOIN candidates i ON l_orderkey = i.k AND i.side = 'INPUT' JOIN candidates e ON l_partkey = e.k AND e.side = 'EFFECT' WHERE l_returnflag = 'R'),
    fr AS (SELECT DISTINCT unnest([input_candidate_id, effect_candidate_id]) AS candidate_id FROM frontiers)
    SELECT f.candidate_id, f.project_id, candidate_kind, mapping_status, reachable_node_count,
        CASE WHEN f.candidate_id IN (FROM conn) THEN 'STATIC_CONNECTED' WHEN f.candidate_id IN (FROM fr) THEN 'STRUCTURAL_FRONTIER'
            WHEN mapping_status = 'UNMAPPABLE' THEN concat('UNMAPPABLE_', side) WHEN mapping_status = 'ADAPTER_ERROR' THEN 'ADAPTER_ERROR'
            WHEN reachable_node_count = 0 THEN CASE WHEN side = 'INPUT' THEN 'EMPTY_FW' ELSE 'EMPTY_BW' END
            ELSE 'DIFFERENT_CALL_REGION' END AS classification FROM funnels f""", *B))
def p09(t):
    return A.diagnose(funnels(t), _connected(t), _frontiers(t))


def _flow_rows(t):
    """Flow rows as an analyzer exports them: entity, file and line of both ends, not candidate ids."""
    c = t.candidates

    def end(word):
        return c.select(F.col("k").alias(f"{word}_k"), F.col("side").alias(f"{word}_side"), F.col("entity").alias(f"{word}_entity"),
                        F.concat(F.lit("./"), F.upper("file")).alias(f"{word}_file"), F.col("line").alias(f"{word}_line"))

    return (
        t.lineitem.filter("l_returnflag = 'R'").join(end("input"), F.col("l_orderkey") == F.col("input_k"))
        .join(end("effect"), F.col("l_partkey") == F.col("effect_k"))
        .select("input_entity", "input_file", "input_line", "effect_entity", "effect_file", "effect_line")
    )


def _connected(t):
    pairs, _ = A.resolve_pairs(_flow_rows(t), t.candidates, anchors(t))
    return pairs


@query("c02_resolve_pairs", oracle(ANCHORS + """SELECT DISTINCT i.candidate_id AS input_candidate_id, e.candidate_id AS effect_candidate_id,
        ia.mapping_status AS input_status, ea.mapping_status AS effect_status FROM lineitem
    JOIN candidates i ON l_orderkey = i.k AND i.side = 'INPUT' JOIN candidates e ON l_partkey = e.k AND e.side = 'EFFECT'
    JOIN anchors ia ON ia.candidate_id = i.candidate_id JOIN anchors ea ON ea.candidate_id = e.candidate_id
    WHERE l_returnflag = 'R'""", *B))
def c02(t):
    return _connected(t)


@query("c02_unmapped_rows", oracle("""SELECT count(*) FILTER (NOT (i.side = 'INPUT' AND e.side = 'EFFECT')) AS unmapped,
    count(*) FILTER (i.side = 'INPUT' AND e.side = 'EFFECT') AS resolved_rows
    FROM lineitem JOIN candidates i ON l_orderkey = i.k JOIN candidates e ON l_partkey = e.k WHERE l_returnflag = 'R'""", "candidates"))
def c02_unmapped(t):
    return A.resolve_pairs(_flow_rows(t), t.candidates, anchors(t))[1]


BACKWARD = ANCHORS + """, bw AS (SELECT candidate_id, project_id, side, mapping_status, coalesce(value_role, 'UNKNOWN') AS value_role, call_identity,
        reachable_node_count > 0 AS bw_active,
        CASE WHEN mapping_status <> 'MAPPED' THEN 'ANCHOR_UNMAPPABLE' WHEN reachable_node_count > 0 THEN 'BW_ACTIVE' ELSE 'MAPPED_BUT_EMPTY_BW' END AS root_cause,
        CASE WHEN mapping_status <> 'MAPPED' THEN 'UNKNOWN' WHEN reachable_node_count > 0 THEN 'NOT_APPLICABLE'
            WHEN call_identity IS NULL THEN 'CALLSITE_RESOLUTION_LIMITATION' ELSE 'NO_PREDECESSOR_IN_BASE_DATA_CALL' END AS secondary_root_cause
    FROM funnels WHERE side = 'EFFECT')
"""


def _backward(t):
    return T.backward_cases(funnels(t).filter("side = 'EFFECT'"))


@query("p08_backward_causes", oracle(BACKWARD + "SELECT candidate_id, bw_active, root_cause, secondary_root_cause FROM bw", *B))
def p08(t):
    return _backward(t).select("candidate_id", "bw_active", "root_cause", "secondary_root_cause")


@query("d14_activity_by_role", oracle(BACKWARD + """SELECT value_role, count(*) AS total, count(*) FILTER (mapping_status = 'MAPPED') AS mapped,
    count(*) FILTER (bw_active) AS bw_active, count(*) FILTER (NOT bw_active) AS bw_inactive,
    round(count(*) FILTER (bw_active) / count(*), 6) AS bw_active_rate FROM bw GROUP BY 1""", *B))
def d14(t):
    return T.activity_by(_backward(t), "value_role")


@query("d12_collapse_candidates", """
    WITH r AS (SELECT l_suppkey AS candidate_id, l_returnflag = 'R' AND l_quantity >= 49 AS act, l_linestatus,
            row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus, l_quantity) AS rn,
            l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS seq, CASE WHEN l_linestatus = 'O' THEN 'MAPPED' ELSE 'UNMAPPABLE' END AS st
        FROM lineitem)
    SELECT candidate_id, bool_or(act) AS bw_active, CASE WHEN bool_or(act) THEN arg_min(st, seq) FILTER (act)
        WHEN bool_or(st = 'MAPPED') THEN 'MAPPED' ELSE arg_min(st, seq) END AS mapping_status, false AS conflict
    FROM r GROUP BY 1""")
def d12(t):
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("candidate_id"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49)).alias("bw_active"),
        F.when(F.col("l_linestatus") == "O", "MAPPED").otherwise("UNMAPPABLE").alias("mapping_status"), F.lit("FILE_WRITE").alias("effect_type"),
        (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("seq"))
    return T.collapse(rows).select("candidate_id", "bw_active", "mapping_status", "conflict")
