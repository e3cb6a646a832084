"""Journals: conversations are runs (user turn starts, next assistant turn answers); events are ordered task rows."""

from pyspark.sql import functions as F

from pathloom.bindings import oracle
from pathloom.operators import journal as J
from pathloom.registry import query

RUNS = """WITH starts AS (SELECT conv_id, request_key, turn AS seq, reserved_tokens FROM journal WHERE role = 'user'),
    resp AS (SELECT concat(conv_id, '-', turn - 1) AS request_key, max(charged_tokens) AS total_tokens FROM journal WHERE role = 'assistant' GROUP BY 1),
    outc AS (SELECT concat(conv_id, '-', turn + 1) AS request_key, 'FAILED_HTTP' AS outcome FROM journal WHERE role = 'system'
        UNION ALL SELECT concat(conv_id, '-', turn - 1), 'UNKNOWN_QUARANTINED' FROM journal WHERE role = 'user' AND turn > 0),
    o1 AS (SELECT request_key, min(outcome) AS outcome FROM outc GROUP BY 1),
    settled AS (SELECT s.*, o1.outcome, coalesce(total_tokens, 0) AS reported_tokens, CASE WHEN total_tokens IS NULL THEN reserved_tokens ELSE 0 END AS open_reserve,
        total_tokens IS NOT NULL AS settled FROM starts s LEFT JOIN resp USING (request_key) LEFT JOIN o1 USING (request_key))
"""


def events(t):
    """Starts, responses and outcomes of the journal."""
    j = t.journal
    key = lambda step: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") + step).cast("string")).alias("request_key")
    starts = j.filter("role = 'user'").select("conv_id", "request_key", F.col("turn").alias("seq"), "reserved_tokens")
    responses = j.filter("role = 'assistant'").select(key(-1), F.col("charged_tokens").alias("total_tokens"))
    outcomes = j.filter("role = 'system'").select(key(1), F.lit("FAILED_HTTP").alias("outcome")).unionByName(
        j.filter("role = 'user' AND turn > 0").select(key(-1), F.lit("UNKNOWN_QUARANTINED").alias("outcome")))
    return starts, responses, outcomes


def settled(t):
    return J.settle(*events(t))


@query("k02_settlement_batch", oracle(RUNS + "SELECT request_key, settled, reported_tokens, open_reserve, outcome FROM settled", "journal"))
def k02(t):
    return settled(t).select("request_key", "settled", "reported_tokens", "open_reserve", "outcome")


@query("d29_accounting", oracle(RUNS + """SELECT conv_id, count(*) AS physical_requests, CAST(sum(reported_tokens) AS BIGINT) AS reported_tokens,
    CAST(sum(open_reserve) AS BIGINT) AS unsettled_reserved_tokens, count(*) FILTER (NOT settled) AS unsettled_requests,
    count(*) FILTER (NOT settled AND outcome IS NULL) AS active_unsettled_requests, count(*) FILTER (NOT settled AND outcome IS NOT NULL) AS quarantined_requests,
    count(*) FILTER (NOT settled AND outcome = 'FAILED_HTTP') AS failed_http_requests,
    count(*) FILTER (NOT settled AND outcome = 'UNKNOWN_QUARANTINED') AS unknown_quarantined_requests, coalesce(any_value(h), 0) AS historical_quarantined_requests
    FROM settled LEFT JOIN (SELECT conv_id, count(DISTINCT request_key) AS h FROM journal WHERE role = 'system' GROUP BY 1) USING (conv_id) GROUP BY 1
    UNION ALL SELECT conv_id, 0, 0, 0, 0, 0, 0, 0, 0, count(DISTINCT request_key) FROM journal WHERE role = 'system' AND conv_id NOT IN (SELECT conv_id FROM starts) GROUP BY 1""", "journal"))
def d29(t):
    return J.accounting(settled(t), ["conv_id"], t.journal.filter("role = 'system'").select("conv_id", "request_key"))


@query("d29_faults", oracle(RUNS + """SELECT request_key, 'CONFLICTING_OUTCOMES' AS fault FROM outc GROUP BY 1 HAVING min(outcome) <> max(outcome)
    UNION ALL SELECT DISTINCT request_key, 'OUTCOME_WITHOUT_START' FROM outc WHERE request_key NOT IN (SELECT request_key FROM starts)
    UNION ALL SELECT request_key, 'DUPLICATE_START' FROM starts GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT concat(conv_id, '-', turn - 1), 'DUPLICATE_RESPONSE' FROM journal WHERE role = 'assistant' GROUP BY 1 HAVING count(*) > 1""", "journal"))
def d29_faults(t):
    return J.faults(*events(t))


CALLS = """WITH tc AS (SELECT event_type AS tool, value AS seconds, value >= 200 AS truncated, event_id,
    CASE WHEN value < 20 THEN 'EMPTY' WHEN value < 40 THEN 'ERROR' ELSE 'OK' END AS status, CASE WHEN value < 30 THEN 'TIMEOUT' END AS reason FROM events),
    both_ AS (SELECT * FROM tc UNION ALL SELECT * REPLACE ('*' AS tool) FROM tc)
"""


def tool_calls(t):
    v = F.col("value")
    return t.events.select(
        F.col("event_type").alias("tool"), v.alias("seconds"), (v >= 200).alias("truncated"),
        F.when(v < 20, "EMPTY").when(v < 40, "ERROR").otherwise("OK").alias("status"), F.when(v < 30, "TIMEOUT").alias("reason"))


LAT = """count(*) AS calls, round(avg(seconds), 6) AS avg, round(max(seconds), 6) AS max, quantile_disc(seconds, 0.5) AS p50, quantile_disc(seconds, 0.95) AS p95"""


@query("d28_latency", oracle(CALLS + f"SELECT tool, {LAT} FROM tc GROUP BY 1"))
def d28(t):
    return J.latency(tool_calls(t), ["tool"], "seconds")


@query("d41_tool_report", oracle(CALLS + f"""SELECT tool, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'EMPTY') AS empty, count(*) FILTER (status = 'ERROR') AS error,
    round(count(*) FILTER (status <> 'ERROR') / count(*), 6) AS success_rate, round(count(*) FILTER (truncated) / count(*), 6) AS truncation_rate, {LAT} FROM both_ GROUP BY 1"""))
def d41(t):
    return J.tool_report(tool_calls(t))


@query("d41_failure_reasons", oracle(CALLS + "SELECT coalesce(reason, 'UNKNOWN') AS reason, count(*) AS count FROM tc WHERE status = 'ERROR' GROUP BY 1"))
def d41_reasons(t):
    return J.failure_reasons(tool_calls(t))


STATUS = "CASE WHEN event_type = 'error' AND value > 60 THEN 'FAILED' ELSE 'SUCCESS' END"


def _statuses(t):
    bad = (F.col("event_type") == "error") & (F.col("value") > 60)
    return t.events.select("user_id", F.when(bad, "FAILED").otherwise("SUCCESS").alias("status"), F.col("event_id").alias("project"),
                           F.get_json_object("props", "$.k").cast("int").alias("path_count"), F.length("event_type").alias("alert_count"))


@query("d17_rollup", f"""SELECT user_id, count(*) AS total, count(*) FILTER (s = 'SUCCESS') AS successes, CASE WHEN count(*) = count(*) FILTER (s = 'SUCCESS') THEN 'SUCCESS'
    WHEN count(*) FILTER (s = 'SUCCESS') > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM (SELECT *, {STATUS} AS s FROM events) GROUP BY 1""")
def d17(t):
    return J.rollup(_statuses(t), ["user_id"])


SUMS = f"""SELECT count(*) FILTER (s = 'SUCCESS') AS projects_success, count(*) FILTER (s <> 'SUCCESS') AS projects_failed,
    CAST(sum(length(event_type)) FILTER (s = 'SUCCESS') AS BIGINT) AS baseline_alerts, CAST(sum(k) FILTER (s = 'SUCCESS') AS BIGINT) AS baseline_paths
    FROM (SELECT *, {STATUS} AS s, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"""


@query("d18_run_report", SUMS)
def d18(t):
    return J.run_report(_statuses(t))[0]


@query("d18_failures", f"SELECT event_id AS project, user_id FROM events WHERE {STATUS} = 'FAILED'")
def d18_failures(t):
    return J.run_report(_statuses(t))[1].select("project", "user_id")


@query("d19_merge_report", f"""WITH s AS ({SUMS}), d AS (SELECT count(*) AS candidate_paths FROM lineitem), c AS (SELECT count(*) AS evaluable FROM supplier)
    SELECT candidate_paths, evaluable, baseline_paths, round(candidate_paths / baseline_paths, 6) AS expansion_factor FROM s, d, c""")
def d19(t):
    detector = t.lineitem.agg(F.count(F.lit(1)).alias("candidate_paths"))
    return J.merge_report(detector, t.supplier.agg(F.count(F.lit(1)).alias("evaluable")), _statuses(t))


CHAIN = """WITH h AS (SELECT event_id, event_type, sha256(concat(event_id, '|', props)) AS digest FROM events),
    e AS (SELECT h.event_id, event_type, CASE WHEN event_type = 'error' THEN upper(digest) ELSE digest END AS digest, digest AS good, lag(digest) OVER (ORDER BY event_id) AS prior,
        lag(event_type) OVER (ORDER BY event_id) AS pt FROM h)
"""


def _chain(t):
    body = F.concat(F.col("event_id").cast("string"), F.lit("|"), F.col("props"))
    good = t.events.select("event_id", "event_type", "props", F.sha2(body, 256).alias("good"))
    prior = good.select((F.col("event_id") + 1).alias("event_id"), F.col("good").alias("previous"))
    digest = F.when(F.col("event_type") == "error", F.upper("good")).otherwise(F.col("good"))
    return good.join(prior, "event_id", "left").select("event_id", F.coalesce("previous", F.lit("")).alias("previous"), digest.alias("digest"), body.alias("body"))


@query("e07_verify_chain", CHAIN + """SELECT event_id, digest = good AS hash_ok, prior IS NULL OR pt <> 'error' AS link_ok, true AS dense FROM e
    WHERE digest <> good OR (prior IS NOT NULL AND pt = 'error')""")
def e07(t):
    return J.verify_chain(_chain(t), [], "event_id", F.col("body"), "previous", "digest")


@query("e08_prefix_reuse", """WITH p AS (SELECT a.conv_id AS new_run, a.conv_id + 1 AS old_run, min(CASE WHEN b.role IS NULL OR a.role <> b.role THEN a.turn END) AS d, max(a.turn) + 1 AS n
    FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id + 1 AND b.turn = a.turn GROUP BY 1, 2) SELECT new_run, old_run, coalesce(d, n) AS prefix FROM p""")
def e08(t):
    c = t.conversations.select("conv_id", "turn", "role")
    runs = c.select(F.col("conv_id").alias("new_run"), (F.col("conv_id") + 1).alias("old_run"))
    return J.prefix_reuse(c, c, runs, "conv_id", "turn", "role")


@query("e12_admit_budget", """WITH r AS (SELECT event_id, event_type, sum(CAST(floor(value) AS BIGINT)) OVER w AS used, count(*) OVER w AS position FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) SELECT event_id, event_type, CAST(used AS BIGINT) AS used, position, used <= 20000 AND position <= 150 AS admitted FROM r""")
def e12(t):
    reserve = F.floor("value").cast("long").alias("reserve")
    rows = t.events.select("event_id", "event_type", reserve)
    return J.admit_budget(rows, ["event_type"], "event_id", "reserve", 20000, 150).select("event_id", "event_type", "used", "position", "admitted")


@query("e13_lane_order", """SELECT event_id, event_type AS category, CASE WHEN value >= 50 THEN 'REASSESS' ELSE 'INVESTIGATE' END AS kind,
    row_number() OVER (PARTITION BY event_type, value >= 50 ORDER BY event_id) AS turn FROM events""")
def e13(t):
    kind = F.when(F.col("value") >= 50, "REASSESS").otherwise("INVESTIGATE")
    rows = t.events.select("event_id", F.col("event_type").alias("category"), kind.alias("kind"))
    return J.lane_order(rows, ["category", "kind"], "event_id")


@query("e17_fit_budget", """SELECT conv_id, turn, CAST(sum(strlen(text)) OVER w AS BIGINT) AS bytes_so_far, sum(strlen(text)) OVER w <= 600 AS kept FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def e17(t):
    rows = t.conversations.select("conv_id", "turn", "text")
    return J.fit_budget(rows, ["conv_id"], "turn", F.octet_length("text"), 600).select("conv_id", "turn", "bytes_so_far", "kept")


@query("e18_pack", oracle("""WITH f AS (SELECT type_name, file, min(method_id) AS m FROM scored_methods GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY type_name ORDER BY m) - 1 AS entry_index FROM f)
    SELECT s.method_id, s.type_name, s.file, entry_index, sum(length(name) + 40) OVER (PARTITION BY s.type_name ORDER BY method_id) + 1000 <= 9000 AS detailed
    FROM scored_methods s JOIN i ON i.type_name = s.type_name AND i.file = s.file""", "scored_methods"))
def e18(t):
    rows = t.scored_methods.select("method_id", "type_name", "file", (F.length("name") + 40).alias("size"))
    return J.pack(rows, "type_name", "method_id", "file", "size", 1000, 9000).select("method_id", "type_name", "file", "entry_index", "detailed")


@query("d43_reserve_plan", """WITH p AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS batch FROM events WHERE event_type IN ('view', 'click')),
    c AS (SELECT DISTINCT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS batch FROM events WHERE event_type = 'purchase')
    SELECT p.user_id, p.batch, count(*) AS candidates, any_value(c.batch) IS NOT NULL AS cached, CASE WHEN any_value(c.batch) IS NULL THEN 1 ELSE 0 END AS held_requests,
        CASE WHEN any_value(c.batch) IS NULL THEN CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) ELSE 0 END AS held_tokens FROM p LEFT JOIN c ON c.user_id = p.user_id AND c.batch = p.batch GROUP BY 1, 2""")
def d43(t):
    pending = t.events.filter("event_type IN ('view', 'click')").select("user_id", "event_id", F.floor("value").cast("long").alias("reserve"))
    cached = t.events.filter("event_type = 'purchase'").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("batch"))
    return J.reserve_plan(pending, cached, "user_id", "event_id", "reserve")


@query("d44_provenance", """SELECT user_id AS candidate_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS roles, count(DISTINCT json_extract_string(props, '$.k')) AS exact_paths,
    count(DISTINCT event_id) AS submissions FROM events GROUP BY 1""")
def d44(t):
    subs = t.events.select(F.col("user_id").alias("candidate_id"), F.col("event_type").alias("role"), F.get_json_object("props", "$.k").alias("path"), F.col("event_id").alias("submission"))
    return J.provenance(subs).withColumn("roles", F.array_join("roles", ","))


@query("d38_ledger_state", """WITH f AS (SELECT user_id AS segment, arg_min(CASE WHEN value > 50 THEN 'static_value_hop' ELSE 'call_argument_hop' END, event_id) AS relation FROM events GROUP BY 1),
    r AS (SELECT user_id AS segment, arg_max(event_type, event_id) AS v FROM events WHERE event_type IN ('purchase', 'error') AND value > 250 GROUP BY 1)
    SELECT f.segment, relation, CASE WHEN v = 'purchase' THEN 'VERIFIER_CONFIRMED' WHEN v = 'error' THEN 'VERIFIER_REFUTED' WHEN relation = 'static_value_hop' THEN 'STATIC_MAY_FLOW'
        ELSE 'SOURCE_GROUNDED_PENDING_REVIEW' END AS status FROM f LEFT JOIN r USING (segment)""")
def d38(t):
    relation = F.when(F.col("value") > 50, "static_value_hop").otherwise("call_argument_hop")
    facts = t.events.select(F.col("user_id").alias("segment"), F.col("event_id").alias("seq"), relation.alias("relation"))
    verdict = F.when(F.col("event_type") == "purchase", "SUPPORTED").when(F.col("event_type") == "error", "REJECTED")
    reviews = t.events.filter("value > 250").select(F.col("user_id").alias("segment"), F.col("event_id").alias("seq"), verdict.alias("verdict"))
    return J.ledger_state(facts, reviews)


@query("c39_lookup_history", """WITH r AS (SELECT concat(user_id, '/', json_extract_string(props, '$.k')) AS key, CASE WHEN value > 150 THEN 'big' ELSE 'small' END AS body_hash, event_id AS created, event_type AS payload
        FROM events WHERE event_type IN ('purchase', 'view')),
    l AS (SELECT DISTINCT concat(user_id, '/', json_extract_string(props, '$.k')) AS key, 'small' AS body_hash FROM events WHERE event_type = 'click')
    SELECT key, body_hash, min(created) AS created, arg_min(payload, created) AS payload FROM r JOIN l USING (key, body_hash)
    WHERE key IN (SELECT key FROM r GROUP BY 1 HAVING count(DISTINCT body_hash) = 1) GROUP BY 1, 2""")
def c39(t):
    key = F.concat_ws("/", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("key")
    body = F.when(F.col("value") > 150, "big").otherwise("small").alias("body_hash")
    records = t.events.filter("event_type IN ('purchase', 'view')").select(key, body, F.col("event_id").alias("created"), F.col("event_type").alias("payload"))
    wanted = t.events.filter("event_type = 'click'").select(key, F.lit("small").alias("body_hash"))
    return J.lookup_history(wanted, records, ["key", "body_hash"])


@query("d22_score_cases", """WITH m AS (SELECT user_id, count(*) FILTER (event_type IN ('view', 'purchase')) AS predictions, count(*) FILTER (event_type = 'purchase' AND value > 100) AS tp, count(*) AS n FROM events GROUP BY 1),
    x AS (SELECT *, CASE WHEN predictions > 0 THEN tp / predictions ELSE 0 END AS p, CASE WHEN tp > 0 THEN 1 ELSE 0 END AS r FROM m)
    SELECT user_id, CASE WHEN 4 * p + r > 0 THEN round(5 * p * r / (4 * p + r), 6) ELSE 0 END AS f2,
        CASE WHEN r > 0 THEN 'DETECTED' WHEN predictions > 0 THEN 'VERIFIED_PATH_LABEL_MISS' ELSE 'NO_VERIFIED_CANDIDATE' END AS classification,
        CAST(round(n * 0.000002 + predictions * 0.00001, 8) AS DOUBLE) AS usd FROM x""")
def d22(t):
    tp = F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 100))
    m = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type").isin("view", "purchase")).alias("predictions"), tp.alias("tp"), F.count(F.lit(1)).alias("n"))
    scored = m.withColumn("precision", F.coalesce(F.try_divide("tp", "predictions"), F.lit(0.0))).withColumn("recall", (F.col("tp") > 0).cast("int"))
    return J.score_cases(scored).select("user_id", "f2", "classification", J.usage_cost(F.col("n"), F.col("predictions")).alias("usd"))


@query("d23_audit_cases", """WITH rq AS (SELECT conv_id, count(*) FILTER (role = 'user') AS requests, coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS tokens,
        count(*) FILTER (role = 'user') - count(*) FILTER (role = 'assistant') AS unsettled FROM conversations GROUP BY 1),
    cd AS (SELECT user_id, count(*) AS candidates, count(*) FILTER (value > 20) AS retained, count(*) FILTER (value > 100) AS strict_verified,
        bool_or(event_type = 'purchase') AS a, bool_or(event_type = 'purchase' AND value > 120) AS k, bool_and(event_type <> 'error' OR value < 150) AS rd FROM events GROUP BY 1)
    SELECT conv_id AS case_id, requests, tokens, unsettled, coalesce(candidates, 0) AS candidates, coalesce(retained, 0) AS retained, coalesce(strict_verified, 0) AS strict_verified,
        CASE WHEN rd IS NOT TRUE THEN 'RETRIEVAL' WHEN a IS NOT TRUE THEN 'CANDIDATE_CONSTRUCTION' WHEN k IS NOT TRUE THEN 'STRICT_VERIFICATION_FILTER' ELSE 'DETECTED' END AS earliest_failure
    FROM rq LEFT JOIN cd ON user_id = conv_id""")
def d23(t):
    c = t.conversations
    cases = c.select(F.col("conv_id").alias("case_id")).distinct()
    event = F.when(F.col("role") == "user", "request_started").when(F.col("role") == "assistant", "response")
    requests = c.select(F.col("conv_id").alias("case_id"), event.alias("event"), F.length("text").alias("charged_tokens"))
    e = t.events.withColumnRenamed("user_id", "case_id")
    buys = F.col("event_type") == "purchase"
    candidates = e.select("case_id", (F.col("value") > 20).alias("retained"), (F.col("value") > 100).alias("verified"))
    methods = e.select("case_id", ((F.col("event_type") != "error") | (F.col("value") < 150)).alias("recalled"))
    hits = e.select("case_id", buys.alias("any_hit"), (buys & (F.col("value") > 120)).alias("retained_hit"))
    return J.audit_cases(cases, requests, candidates, methods, hits)


@query("p20_case_status", """WITH st AS (SELECT user_id AS case_id, event_id AS pos, CASE event_type WHEN 'signup' THEN 'SOURCE' WHEN 'purchase' THEN 'SINK' WHEN 'error' THEN 'GUARD' ELSE 'STEP' END AS kind FROM events
        WHERE event_type <> 'error' OR value > 250),
    fa AS (SELECT user_id AS case_id, event_id AS seq, CASE WHEN event_type = 'view' THEN 'guard_condition' ELSE 'sanitizer_result' END AS type,
        CASE WHEN value > 150 THEN 'blocks' WHEN value > 60 THEN 'unknown' WHEN value > 20 THEN 'not_dominating' ELSE 'bypassed' END AS effect, value > 180 AS checked
        FROM events WHERE event_type = 'view' OR (event_type = 'click' AND value > 120)),
    la AS (SELECT case_id, type, arg_max(CASE WHEN effect = 'blocks' AND NOT checked THEN 'unknown' ELSE effect END, seq) AS e FROM fa GROUP BY 1, 2),
    c AS (SELECT case_id, min(pos) FILTER (kind = 'SOURCE') AS s, min(pos) FILTER (kind = 'SINK') AS k, bool_or(kind = 'GUARD') AS ng FROM st GROUP BY 1),
    x AS (SELECT c.*, coalesce(ss.e, '') AS es, coalesce(gg.e, '') AS eg FROM c LEFT JOIN la ss ON ss.case_id = c.case_id AND ss.type = 'sanitizer_result' LEFT JOIN la gg ON gg.case_id = c.case_id AND gg.type = 'guard_condition')
    SELECT case_id, CASE WHEN es = 'blocks' OR eg = 'blocks' THEN 'DEAD_END' WHEN s < k AND es NOT IN ('unknown') AND (eg IN ('bypassed', 'not_dominating') OR (eg = '' AND NOT ng)) THEN 'CONFIRMED' ELSE 'EXPLORING' END AS status,
        es AS sanitizer_effect, eg AS guard_effect FROM x""")
def p20(t):
    e = t.events.withColumnRenamed("user_id", "case_id")
    v = F.col("value")
    kind = F.when(F.col("event_type") == "signup", "SOURCE").when(F.col("event_type") == "purchase", "SINK").when(F.col("event_type") == "error", "GUARD").otherwise("STEP")
    steps = e.filter("event_type <> 'error' OR value > 250").select("case_id", F.col("event_id").alias("pos"), kind.alias("kind"))
    effect = F.when(v > 150, " Blocks").when(v > 60, "unknown").when(v > 20, "not-dominating").otherwise("BYPASSED")
    facts = e.filter("event_type = 'view' OR (event_type = 'click' AND value > 120)").select(
        "case_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "Guard_Condition").otherwise("sanitizer_result").alias("type"), effect.alias("effect"), (v > 180).alias("checked"))
    cases = steps.select("case_id", F.lit("SINK").alias("seed_kind")).distinct()
    return J.case_status(steps, facts, cases)
