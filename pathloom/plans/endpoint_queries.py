"""Classification and ranking: a part is a method, its lines are calls; declared types and names cycle through rule and near-miss values."""

from pyspark.sql import functions as F

from pathloom.bindings import oracle
from pathloom.operators import endpoints as E
from pathloom.operators import ranking as K
from pathloom.operators import rules as R
from pathloom.registry import query


def _pick(values, index):
    """The value at ``index`` of a literal list, for Spark."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _sql_list(values):
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _values(rows):
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v + "'" for v in r) + ")" for r in rows)


SITE = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)"


def site():
    """The line's key as one text, as ``SITE`` says it in SQL."""
    return F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")])

CALL_NAMES = [f"{r[0]}#{r[1]}" for r in R.effect_rows()] + ["com.acme.Files#copy", "java.lang.Runtime#gc", "com.acme.Cipher#getInstance"]
ACCESSORS = ["", "javax.servlet.ServletResponse#getWriter", "jakarta.servlet.http.HttpServletResponse#getOutputStream", "com.acme.ServletResponse#getWriter"]


def calls(t):
    pick = _pick(CALL_NAMES, F.col("l_partkey") + 7 * F.col("l_suppkey"))
    body = F.col("l_linenumber") == 7
    acc = _pick(ACCESSORS, F.col("l_suppkey"))
    name = F.when(body, _pick(R.BODY_WRITES, F.col("l_partkey"))).otherwise(F.split(pick, "#")[1])
    return t.lineitem.select(
        site().alias("call_id"), F.col("l_orderkey").alias("method_id"), F.when(body, "java.io.PrintWriter").otherwise(F.split(pick, "#")[0]).alias("type"), name.alias("name"),
        F.split(acc, "#")[0].alias("accessor_type"), F.when(body, F.try_element_at(F.split(acc, "#"), F.lit(2))).alias("accessor"), F.col("l_linenumber").alias("line"))


CALLS = f"""WITH rules(type, name, effect_type, rule, mechanism, argument_index) AS (VALUES {_values(R.effect_rows())}),
    c0 AS (SELECT *, {_sql_list(CALL_NAMES)}[(l_partkey + 7 * l_suppkey) % {len(CALL_NAMES)} + 1] AS pick, {_sql_list(ACCESSORS)}[l_suppkey % {len(ACCESSORS)} + 1] AS acc FROM lineitem),
    calls AS (SELECT {SITE} AS call_id, l_orderkey AS method_id, CASE WHEN l_linenumber = 7 THEN 'java.io.PrintWriter' ELSE split_part(pick, '#', 1) END AS type,
        CASE WHEN l_linenumber = 7 THEN {_sql_list(R.BODY_WRITES)}[l_partkey % {len(R.BODY_WRITES)} + 1] ELSE split_part(pick, '#', 2) END AS name, acc, l_linenumber FROM c0),
    eff AS (SELECT call_id, method_id, effect_type, rule, mechanism, argument_index FROM calls JOIN rules USING (type, name)
        UNION ALL SELECT call_id, method_id, 'RENDERING', 'SERVLET_RESPONSE_BODY_ARG0', concat('SERVLET_RESPONSE_', split_part(acc, '#', 2), '_', name), 0 FROM calls WHERE l_linenumber = 7 AND (acc LIKE 'javax%' OR acc LIKE 'jakarta%'))
"""


@query("p02_security_effects", CALLS + "SELECT * FROM eff")
def p02(t):
    return E.security_effects(calls(t))


@query("p03_effect_wrappers", CALLS + """SELECT eff.method_id, call_id, effect_type, concat('v', l_suppkey) AS variable, p.i AS parameter_index FROM eff JOIN (SELECT *, l_orderkey AS mid FROM lineitem) l ON call_id = """ + SITE + """
    JOIN (VALUES (0), (1), (2)) p(i) ON concat('v', l_suppkey) = concat('v', (eff.method_id * 3 + p.i) % 97) WHERE argument_index = 0""")
def p03(t):
    arguments = t.lineitem.select(site().alias("call_id"), F.lit(0).alias("index"), F.concat(F.lit("v"), F.col("l_suppkey").cast("string")).alias("variable"))
    position = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    params = t.orders.select(F.col("o_orderkey").alias("method_id"), position.alias("position")).withColumn(
        "name", F.concat(F.lit("v"), ((F.col("method_id") * 3 + F.col("position")) % 97).cast("string")))
    return E.effect_wrappers(E.security_effects(calls(t)), arguments, params)


ANNOTATIONS = [f"{p}#{n}" for p, n, _ in R.annotation_rows()] + ["com.acme#RequestParam", "javax.ws.rs#Context"]
ACCESS = [f"{a}#{b}" for a, b, _ in R.accessor_rows()] + ["com.acme.Request#getParameter", "javax.servlet.ServletRequest#getLocale"]


@query("p01_external_inputs", f"""WITH ar(package, annotation, mechanism) AS (VALUES {_values(R.annotation_rows())}), cr(type, name, mechanism) AS (VALUES {_values(R.accessor_rows())}),
    p AS (SELECT o_orderkey AS param_id, o_custkey AS method_id, {_sql_list(ANNOTATIONS)}[o_orderkey % {len(ANNOTATIONS)} + 1] AS a FROM orders),
    pm AS (SELECT p.*, mechanism FROM p JOIN ar ON a = concat(package, '#', annotation)),
    c AS (SELECT {SITE} AS call_id, l_orderkey AS method_id, l_linenumber, {_sql_list(ACCESS)}[(l_partkey + l_suppkey) % {len(ACCESS)} + 1] AS a FROM lineitem), cm AS (SELECT c.*, mechanism FROM c JOIN cr ON a = concat(type, '#', name))
    SELECT DISTINCT mechanism, CAST(param_id AS VARCHAR) AS entity, 'ANNOTATED_PARAMETER' AS evidence_kind, concat('M', method_id) AS file, 1 AS line, 'STATIC' AS source FROM pm
    UNION SELECT mechanism, CAST(call_id AS VARCHAR), 'SERVLET_ACCESSOR_CALL', concat('M', method_id), l_linenumber, 'STATIC' FROM cm
    UNION SELECT mechanism, CAST(method_id AS VARCHAR), 'DIRECT_RETURN_WRAPPER', concat('M', method_id), 100 + l_linenumber, 'STATIC_DERIVED' FROM cm WHERE l_linenumber >= 6
    UNION SELECT mechanism, CAST(method_id AS VARCHAR), 'DIRECT_PARAMETER_RETURN_WRAPPER', concat('M', method_id), 200, 'STATIC_DERIVED' FROM pm JOIN orders ON o_orderkey = param_id AND o_orderstatus = 'P'""")
def p01(t):
    a = _pick(ANNOTATIONS, F.col("o_orderkey"))
    file = lambda c: F.concat(F.lit("M"), F.col(c).cast("string")).alias("file")
    params = t.orders.select(F.col("o_orderkey").alias("param_id"), F.col("o_custkey").alias("method_id"), F.split(a, "#")[0].alias("package"), F.split(a, "#")[1].alias("annotation"), file("o_custkey"), F.lit(1).alias("line"))
    c = _pick(ACCESS, F.col("l_partkey") + F.col("l_suppkey"))
    lines = t.lineitem.select(site().alias("call_id"), F.col("l_orderkey").alias("method_id"), F.split(c, "#")[0].alias("type"), F.split(c, "#")[1].alias("name"), file("l_orderkey"), F.col("l_linenumber").alias("line"))
    none, no_call = F.lit(None).cast("long"), F.lit(None).cast("string")
    by_call = lines.filter("line >= 6").select("method_id", "call_id", none.alias("param_id"), "file", (F.col("line") + 100).alias("line"))
    by_param = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("method_id"), no_call.alias("call_id"), F.col("o_orderkey").alias("param_id"), file("o_custkey"), F.lit(200).alias("line"))
    return E.external_inputs(params, lines, by_call.unionByName(by_param))


TYPES = ["com.acme.HttpServletRequest", "com.acme.EvalContext", "com.acme.ClickEvent", "com.acme.Order", "java.lang.String", "com.acme.LoadPayload"]
NAMES = ["onMessage", "handle", "list", "find", "accept"]
HANDLERS = [f"{a}#{b}" for a, b, _, _ in R.handler_rows()] + ["com.acme#GetMapping"] * 30


@query("p04_boundary_candidates", f"""WITH h(package, annotation, reason, evidence_kind) AS (VALUES {_values(R.handler_rows())}),
    p AS (SELECT o_orderkey AS param_id, o_custkey AS method_id, {_sql_list(NAMES)}[o_custkey % {len(NAMES)} + 1] AS mname, {_sql_list(TYPES)}[o_orderkey % {len(TYPES)} + 1] AS type, o_custkey % 3 = 0 AS ov FROM orders),
    an AS (SELECT c_custkey AS method_id, {_sql_list(HANDLERS)}[c_custkey % {len(HANDLERS)} + 1] AS a FROM customer), hd AS (SELECT DISTINCT method_id, reason, evidence_kind FROM an JOIN h ON a = concat(package, '#', annotation)),
    q AS (SELECT *, regexp_matches(type, '(Request|Context|Event|Message|Payload)$') AS rl, mname IN ('onMessage', 'onEvent', 'handle', 'handleRequest', 'accept', 'apply', 'invoke') AS cb FROM p)
    SELECT param_id, reason, evidence_kind, 'STRUCTURE_HIGH' AS confidence FROM q JOIN hd USING (method_id)
    UNION ALL SELECT param_id, 'OVERRIDE_PARAMETER', 'OVERRIDDEN_REQUEST_LIKE_PARAMETER', 'STRUCTURE_HIGH' FROM q WHERE rl AND ov
    UNION ALL SELECT param_id, 'CALLBACK_PARAMETER', 'CALLBACK_REQUEST_LIKE_PARAMETER', 'STRUCTURE_MEDIUM' FROM q WHERE rl AND NOT ov AND cb
    UNION ALL SELECT param_id, 'REQUEST_CONTEXT_TYPE', 'REQUEST_LIKE_PARAMETER_TYPE', 'OPEN_CANDIDATE' FROM q WHERE rl AND NOT ov AND NOT cb AND method_id NOT IN (SELECT method_id FROM hd)""")
def p04(t):
    params = t.orders.select(F.col("o_orderkey").alias("param_id"), F.col("o_custkey").alias("method_id"), _pick(NAMES, F.col("o_custkey")).alias("method_name"), _pick(TYPES, F.col("o_orderkey")).alias("type"), (F.col("o_custkey") % 3 == 0).alias("overrides"))
    a = _pick(HANDLERS, F.col("c_custkey"))
    notes = t.customer.select(F.col("c_custkey").alias("method_id"), F.split(a, "#")[0].alias("package"), F.split(a, "#")[1].alias("annotation"))
    return E.boundary_candidates(params, notes)


RECEIVER_NAMES = [f"com.acme.My{s}#{m}" for suffixes, methods, *_ in R.RECEIVERS for s in suffixes for m in methods[:2]] + ["com.acme.Shop#save", "com.acme.UserStore#close"]
RECEIVER_ROWS = [(f"com.acme.My{s}#{m}", reason, category, ev, conf) for suffixes, methods, reason, category, ev, conf in R.RECEIVERS for s in suffixes for m in methods]


@query("p05_receiver_effects", f"""WITH r(k, reason, category, evidence_kind, confidence) AS (VALUES {_values(RECEIVER_ROWS)}), c AS (SELECT {SITE} AS call_id, l_linenumber % 3 AS n, {_sql_list(RECEIVER_NAMES)}[(l_partkey + l_suppkey) % {len(RECEIVER_NAMES)} + 1] AS k FROM lineitem)
    SELECT call_id, reason, category, evidence_kind, confidence, CASE WHEN n > 0 THEN 'CALL_ARGUMENT' ELSE 'RECEIVER' END AS value_role, CASE WHEN n > 0 THEN 0 ELSE -1 END AS argument_index FROM c JOIN r USING (k)""")
def p05(t):
    k = _pick(RECEIVER_NAMES, F.col("l_partkey") + F.col("l_suppkey"))
    return E.receiver_effects(t.lineitem.select(site().alias("call_id"), F.split(k, "#")[0].alias("type"), F.split(k, "#")[1].alias("name"), (F.col("l_linenumber") % 3).alias("n_args")))


@query("p06_entity_facts", f"""WITH f AS (SELECT {SITE} AS entity_id, l_partkey AS file, l_linenumber AS s, l_linenumber + CAST(l_quantity AS INT) % 4 AS e, l_returnflag AS kind, l_orderkey FROM lineitem),
    sp AS (SELECT p_partkey AS span_id, 2 + p_size % 3 AS s, 4 + p_size % 3 AS e FROM part),
    a AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_linestatus)), '|') AS an FROM lineitem GROUP BY 1), su AS (SELECT o_orderkey, concat('C', o_custkey) AS st FROM orders)
    SELECT span_id, entity_id, kind, concat('m', l_orderkey) AS name, concat('T', f.s, ',int') AS parameters, an AS annotations, st AS supertypes FROM f JOIN sp ON file = span_id AND f.s <= sp.e AND sp.s <= f.e
        JOIN a USING (l_orderkey) JOIN su ON o_orderkey = l_orderkey""")
def p06(t):
    line = F.col("l_linenumber")
    base = t.lineitem.select(site().alias("entity_id"), F.col("l_partkey").alias("file"), line.alias("start"), (line + F.col("l_quantity").cast("int") % 4).alias("end"), F.col("l_returnflag").alias("kind"),
                             F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("name"), F.col("l_orderkey").alias("type_id"))
    params = base.select("entity_id", F.posexplode(F.array(F.concat(F.lit("T"), F.col("start").cast("string")), F.lit("int"))).alias("position", "type"))
    status = t.lineitem.select(F.col("l_orderkey").alias("type_id"), F.col("l_linestatus").alias("annotation")).distinct()
    notes = base.select("entity_id", "type_id").join(status, "type_id").select("entity_id", "annotation")
    parents = t.orders.select(F.col("o_orderkey").alias("type_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("supertype"))
    spans = t.part.select(F.col("p_partkey").alias("span_id"), F.col("p_partkey").alias("file"), (2 + F.col("p_size") % 3).alias("s_start"), (4 + F.col("p_size") % 3).alias("s_end"))
    return E.entity_facts(base, params, notes, parents, spans)


SINK_NAMES = ["exec", "start", "write", "eval", "copy", "open", "delete", "render", "compile", "println"]
SINK_CATEGORY = ["CWE-78", "CWE-78", "CWE-79", "CWE-94", "CWE-22", "CWE-22", "CWE-22", "CWE-79", "CWE-94", "CWE-79"]


@query("p12_controllable_sinks", f"""WITH c AS (SELECT {SITE} AS id, {_sql_list(SINK_NAMES)}[l_partkey % 10 + 1] AS name, {_sql_list(SINK_CATEGORY)}[l_partkey % 10 + 1] AS cat, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber % 4 END AS arity,
        CASE WHEN l_linenumber = 2 THEN 'java.lang.Runtime' WHEN l_linenumber = 3 THEN 'java.lang.ProcessBuilder' END AS target, l_returnflag = 'R' AS c0, l_linestatus = 'O' AS c1, l_quantity > 45 AS recv FROM lineitem),
    s AS (SELECT *, CASE WHEN (cat = 'CWE-78' AND name = 'exec' AND target IS NOT DISTINCT FROM 'java.lang.Runtime') OR (cat = 'CWE-79' AND name IN ('write', 'println')) OR (cat = 'CWE-94' AND name IN ('eval', 'compile')) THEN 1 WHEN name = 'copy' THEN least(2, arity) ELSE arity END AS n FROM c)
    SELECT id AS call_id FROM s WHERE NOT (name = 'start' AND target IS NOT NULL AND target <> 'java.lang.ProcessBuilder') AND (arity IS NULL OR (arity = 0 AND (name IN ('start', 'delete', 'open') OR recv))
        OR (arity > 0 AND ((n >= 1 AND NOT c0) OR (n >= 2 AND NOT c1) OR n >= 3)))""")
def p12(t):
    line = F.col("l_linenumber")
    rows = t.lineitem.select(
        site().alias("call_id"), _pick(SINK_CATEGORY, F.col("l_partkey")).alias("category"), _pick(SINK_NAMES, F.col("l_partkey")).alias("name"), F.when(line != 7, line % 4).alias("arity"),
        F.when(line == 2, "java.lang.Runtime").when(line == 3, "java.lang.ProcessBuilder").alias("target"))
    constants = t.lineitem.filter("l_returnflag = 'R'").select(site().alias("call_id"), F.lit(0).alias("index")).unionByName(
        t.lineitem.filter("l_linestatus = 'O'").select(site().alias("call_id"), F.lit(1).alias("index")))
    return E.controllable_sinks(rows, constants, t.lineitem.filter("l_quantity > 45").select(site().alias("call_id"))).select("call_id")


WORDS = ["getParameter", "readLine", "execute", "writeLine", "openFile", "main", "compileAll", "launch", "toString", "renderView"]


@query("p13_name_match", f"""WITH w AS (SELECT p_partkey, {_sql_list(WORDS)}[p_partkey % {len(WORDS)} + 1] AS name FROM part)
    SELECT p_partkey, name IN ('getParameter', 'readLine', 'main') AS is_source, CASE name WHEN 'execute' THEN 'CWE-78,CWE-94' WHEN 'writeLine' THEN 'CWE-79' WHEN 'openFile' THEN 'CWE-22' WHEN 'compileAll' THEN 'CWE-94'
        WHEN 'launch' THEN 'CWE-78' WHEN 'renderView' THEN 'CWE-79,CWE-94' ELSE '' END AS sinks FROM w""")
def p13(t):
    return E.name_match(t.part.select("p_partkey", _pick(WORDS, F.col("p_partkey")).alias("name")), "name").select("p_partkey", "is_source", F.array_join("sink_categories", ",").alias("sinks"))


SIGNALS = """WITH cats(category, lane) AS (VALUES ('CWE-22', 1), ('CWE-78', 2), ('CWE-79', 3), ('CWE-94', 4)),
    d AS (SELECT method_id, category, count(*) FILTER (dangerous) AS m, count(*) FILTER (dangerous AND dynamic_args) AS dy, count(*) FILTER (alerted AND line = 1) AS nat FROM scored_calls GROUP BY 1, 2),
    so AS (SELECT method_id, count(*) FILTER (is_source) AS s FROM scored_calls GROUP BY 1),
    sc AS (SELECT me.method_id, me.file, me.start_line, c.category, lane, 24 * least(coalesce(nat, 0), 2) + 8 * least(coalesce(m, 0), 3) + 3 * least(coalesce(dy, 0), 2) + 4 * least(coalesce(s, 0), 2)
        + 2 * CAST(me.category IS NOT NULL AS INT) + 2 * CAST(start_line > 25 AS INT) AS score FROM scored_methods me CROSS JOIN cats c LEFT JOIN d ON d.method_id = me.method_id AND d.category = c.category LEFT JOIN so ON so.method_id = me.method_id)
"""
SB = ("scored_methods", "scored_calls")


def signals(t):
    methods = t.scored_methods.select("method_id", F.col("category").isNotNull().alias("binding"), (F.col("start_line") > 25).alias("related"))
    rows = t.scored_calls.withColumnRenamed("dynamic_args", "dynamic")
    return E.method_signals(methods, rows, t.scored_calls.filter("alerted AND line = 1").select("method_id", "category"))


@query("d31_method_signals", oracle(SIGNALS + "SELECT method_id, category, score FROM sc", *SB))
def d31(t):
    return signals(t)


def located(t):
    return signals(t).join(t.scored_methods.select("method_id", "file", "start_line"), "method_id")


@query("e03_interleave", oracle(SIGNALS + """, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, file, start_line, method_id) AS rank FROM sc),
    k AS (SELECT method_id, min((rank, lane)) AS k FROM r GROUP BY 1) SELECT method_id, row_number() OVER (ORDER BY k) AS position FROM k ORDER BY k LIMIT 120""", *SB))
def e03(t):
    order = [F.col("score").desc(), F.col("file"), F.col("start_line"), F.col("method_id")]
    return K.interleave(located(t), R.CATEGORIES, order, 120).select("method_id", "position")


BEST = SIGNALS + """, best AS (SELECT method_id, file, arg_min(category, (-score, lane)) AS category, max(score) AS score FROM sc GROUP BY 1, 2)
"""


@query("e04_capped_inventory", oracle(BEST + """, c AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, method_id) AS f FROM best)
    SELECT method_id, row_number() OVER (ORDER BY score DESC, file, method_id) AS position FROM c WHERE f <= 12 ORDER BY position LIMIT 36""", *SB))
def e04(t):
    best = E.first_signal(signals(t)).join(t.scored_methods.select("method_id", "file"), "method_id")
    return K.capped_inventory(best, "file", [F.col("score").desc(), F.col("file"), F.col("method_id")]).select("method_id", "position")


@query("e04_inventory_omitted", oracle(BEST + """, c AS (SELECT file, count(*) AS n FROM best GROUP BY 1)
    SELECT CAST(sum(n) - sum(least(n, 12)) AS BIGINT) AS omitted_by_group, CAST(greatest(sum(least(n, 12)) - 36, 0) AS BIGINT) AS omitted_by_total FROM c""", *SB))
def e04_omitted(t):
    best = E.first_signal(signals(t)).join(t.scored_methods.select("method_id", "file"), "method_id")
    return K.inventory_omitted(best, "file")


def leads(t):
    best = E.first_signal(signals(t)).join(t.scored_methods.select("method_id", "file", "type_name"), "method_id")
    return best.select(F.col("type_name").alias("project"), "method_id", "category", "file", "score")


@query("e05_diverse_leads", oracle(BEST.replace("WITH cats", "WITH RECURSIVE cats") + """, c AS (SELECT type_name AS project, b.method_id, b.category, b.file, b.score FROM best b JOIN scored_methods USING (method_id)),
    g AS (SELECT DISTINCT project, 0 AS n, [method_id][1:0] AS ids, CAST([] AS VARCHAR[]) AS cats, CAST([] AS VARCHAR[]) AS files, CAST(NULL AS BIGINT) AS method_id, CAST(NULL AS VARCHAR) AS category FROM c
        UNION ALL SELECT project, n + 1, list_append(ids, m), list_append(cats, cat), list_append(files, f), m, cat FROM (
            SELECT g.project, n, ids, cats, files, c.method_id AS m, c.category AS cat, c.file AS f,
                row_number() OVER (PARTITION BY g.project ORDER BY c.score - 7 * len([x for x in cats if x = c.category]) - 2 * len([x for x in files if x = c.file]) DESC, c.file, c.method_id) AS r
            FROM g JOIN c ON c.project = g.project AND NOT list_contains(ids, c.method_id) WHERE n < 48) WHERE r = 1)
    SELECT project, method_id, category, n AS position FROM g WHERE n > 0""", *SB))
def e05(t):
    return K.diverse_leads(leads(t))


@query("e05_merge_leads", oracle(BEST + """, pr AS (SELECT p_partkey AS method_id, 'CWE-79' AS wanted FROM part WHERE p_size > 40), w AS (SELECT pr.*, score AS ws FROM pr JOIN sc ON sc.method_id = pr.method_id AND sc.category = 'CWE-79')
    SELECT b.method_id, CASE WHEN ws >= b.score THEN wanted ELSE b.category END AS category, b.score + CASE WHEN wanted IS NOT NULL THEN 3 ELSE 0 END AS score FROM best b LEFT JOIN w USING (method_id)""", *SB))
def e05_merge(t):
    wanted = t.part.filter("p_size > 40").select(F.col("p_partkey").alias("method_id"), F.lit("CWE-79").alias("category"))
    proposals = wanted.join(signals(t).withColumnRenamed("score", "wanted_score"), ["method_id", "category"])
    return K.merge_leads(leads(t), proposals).select("method_id", "category", "score")


NAMED = ["getQuery", "openFile", "execIt", "println", "evalAll", "toText", "copyTo", "spawnIt"]
PATTERNED = ["path to file and file", "response html response", "plain words", "script eval expression", "shell command exec"]


@query("d32_boundary_scores", f"""WITH cn AS (SELECT DISTINCT l_partkey AS method_id, {_sql_list(NAMED)}[l_suppkey % {len(NAMED)} + 1] AS name FROM lineitem),
    k(name, category) AS (VALUES ('openFile', 'CWE-22'), ('copyTo', 'CWE-22'), ('execIt', 'CWE-78'), ('spawnIt', 'CWE-78'), ('println', 'CWE-79'), ('evalAll', 'CWE-94')),
    api AS (SELECT method_id, category, count(*) AS n FROM cn JOIN k USING (name) GROUP BY 1, 2), en AS (SELECT DISTINCT method_id FROM cn WHERE name = 'getQuery'),
    te(i, category, n) AS (VALUES (0, 'CWE-22', 2), (1, 'CWE-79', 2), (3, 'CWE-78', 1), (3, 'CWE-94', 3), (4, 'CWE-78', 3)), cats(category) AS (VALUES ('CWE-22'), ('CWE-78'), ('CWE-79'), ('CWE-94'))
    SELECT p_partkey AS method_id, cats.category, 3 * least(coalesce(api.n, 0), 4) + coalesce(te.n, 0) + CASE WHEN en.method_id IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN p_size > 30 THEN 5 ELSE 0 END AS score
    FROM part CROSS JOIN cats LEFT JOIN api ON api.method_id = p_partkey AND api.category = cats.category LEFT JOIN en ON en.method_id = p_partkey LEFT JOIN te ON te.i = p_partkey % 5 AND te.category = cats.category""")
def d32(t):
    methods = t.part.select(F.col("p_partkey").alias("method_id"), _pick(PATTERNED, F.col("p_partkey")).alias("text"), (F.col("p_size") > 30).alias("alerted"))
    named = t.lineitem.select(F.col("l_partkey").alias("method_id"), _pick(NAMED, F.col("l_suppkey")).alias("name"))
    return E.boundary_scores(methods, named)


DOM = ["getChildNodes", "removeChild", "run", "getFirstChild", "encodeForHTML"]


@query("d40_mechanisms", f"""WITH s AS (SELECT o_custkey AS file, o_orderkey AS method_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderstatus = 'F'),
    c AS (SELECT o_custkey AS file, l_orderkey AS method_id, {_sql_list(DOM)}[l_partkey % 5 + 1] AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    d AS (SELECT * FROM c WHERE file IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE') AND name IN ('getChildNodes', 'removeChild', 'getFirstChild')), f AS (SELECT file FROM d GROUP BY 1 HAVING bool_or(name = 'removeChild') AND bool_or(name <> 'removeChild'))
    SELECT 'WEB_SURFACE' AS kind, file, CAST((pos - 1) // 3 AS VARCHAR) AS part, method_id FROM s
    UNION ALL SELECT DISTINCT 'DOM_TRANSFORM', file, CAST(method_id AS VARCHAR), method_id FROM d WHERE file IN (FROM f)
    UNION ALL SELECT DISTINCT 'ENCODING_USE', file, CAST(method_id AS VARCHAR), method_id FROM c WHERE name = 'encodeForHTML' AND file IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def d40(t):
    o = t.orders
    surfaces = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("line"), F.col("o_orderkey").alias("method_id"))
    methods = o.select(F.col("o_orderkey").alias("method_id"), F.col("o_custkey").alias("file"), F.lit(1).alias("line"))
    name = _pick(DOM, F.col("l_partkey"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("method_id"), name.alias("name"), F.when(name == "encodeForHTML", "Encode").otherwise("node").alias("receiver"))
    c = t.customer
    imports = c.filter("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("file"), F.lit("org.w3c.dom.Node").alias("class_name"), F.lit(False).alias("watched")).unionByName(
        c.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("file"), F.lit("org.owasp.Encode").alias("class_name"), F.lit(True).alias("watched")))
    return E.mechanisms(surfaces, methods, rows, imports)


@query("f02_context_page", oracle("""WITH r AS (SELECT DISTINCT callee AS method_id, CASE WHEN line = 4 THEN 'FIELD_STATE' ELSE kind END AS kind, caller AS l, receiver AS r FROM calls),
    p AS (SELECT *, row_number() OVER (PARTITION BY method_id ORDER BY CASE kind WHEN 'DIRECT_CALL' THEN 0 WHEN 'CALL' THEN 1 ELSE 2 END, kind, l, r) AS position FROM r)
    SELECT method_id, kind, l AS "left", r AS "right", position FROM p WHERE position BETWEEN 3 AND 8""", "calls"))
def f02(t):
    kind = F.when(F.col("line") == 4, "FIELD_STATE").otherwise(F.col("kind"))
    rows = t.calls.select(F.col("callee").alias("method_id"), kind.alias("kind"), F.col("caller").alias("left"), F.col("receiver").alias("right"))
    return K.context_page(rows, 6, 2).select("method_id", "kind", "left", "right", "position")


@query("f03_rank_endpoints", """SELECT p_partkey AS entity_id, row_number() OVER (ORDER BY p_type = 'SMALL', p_size % 10 DESC, CASE WHEN p_size < 40 THEN p_size % 6 END NULLS LAST, p_type <> 'PROMO', p_brand, p_size, p_partkey) AS position FROM part ORDER BY position LIMIT 200""")
def f03(t):
    rows = t.part.select(F.col("p_partkey").alias("entity_id"), (F.col("p_type") == "SMALL").alias("is_test"), (F.col("p_size") % 10).alias("score"), F.when(F.col("p_size") < 40, F.col("p_size") % 6).alias("distance"),
                         F.when(F.col("p_type") == "PROMO", "CALL").otherwise("METHOD").alias("kind"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"))
    return K.rank_endpoints(rows, 200).select("entity_id", "position")


@query("f04_rank_paths", """WITH p AS (SELECT l_orderkey AS path_id, count(*) FILTER (l_returnflag <> 'N') AS relaxed, CAST(sum(l_linenumber) AS BIGINT) AS fanout, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS cr, count(*) FILTER (l_returnflag = 'R') AS sh, count(*) AS n FROM lineitem GROUP BY 1),
    q AS (SELECT p.*, o_orderstatus = 'P' AS test, o_orderstatus <> 'F' AS open_end, CASE WHEN o_custkey % 3 = 0 THEN 1000 ELSE o_custkey % 9 END AS dist, 4 * CAST(o_orderpriority = '1-URGENT' AS INT) + 3 * least(cr, 6) - 2 * relaxed - 4 * sh AS strength FROM p JOIN orders ON o_orderkey = path_id)
    SELECT path_id, strength, row_number() OVER (ORDER BY test, relaxed, fanout, open_end, dist, strength DESC, n, path_id) AS position FROM q ORDER BY position LIMIT 300""")
def f04(t):
    kind = F.when(F.col("l_returnflag") == "N", "static").when(F.col("l_returnflag") == "R", "shared_class_hop").otherwise("field_state_bridge")
    edge = F.struct(kind.alias("kind"), (F.col("l_linestatus") == "O").alias("crosses"), F.col("l_linenumber").alias("fanout"))
    edges = t.lineitem.groupBy(F.col("l_orderkey").alias("path_id")).agg(F.collect_list(edge).alias("edges"))
    rows = edges.join(t.orders, F.col("o_orderkey") == F.col("path_id")).select(
        "path_id", "edges", (F.col("o_orderstatus") == "P").alias("is_test"), (F.col("o_orderstatus") == "F").alias("sink_known"), (F.col("o_orderpriority") == "1-URGENT").alias("source_known"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 9).alias("distance"))
    return K.rank_paths(rows, 300).select("path_id", "strength", "position")


@query("f05_top_spines", """WITH s AS (SELECT l_orderkey AS id, min(l_suppkey) AS a, max(l_suppkey) AS b, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS br FROM lineitem GROUP BY 1),
    q AS (SELECT id, o_custkey AS grp, a, b, n, br, o_orderstatus = 'F' AS typed FROM s JOIN orders ON o_orderkey = id),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp, a, b ORDER BY NOT (typed AND n >= 3), n = 1, NOT typed, -br, -n, id) AS d FROM q)
    SELECT grp, id, a AS first, b AS last, row_number() OVER (PARTITION BY grp ORDER BY NOT (typed AND n >= 3), n = 1, NOT typed, -br, -n, id) AS rank FROM r WHERE d = 1 QUALIFY rank <= 5""")
def f05(t):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("l_suppkey")).alias("methods"), F.count_if(F.col("l_returnflag") == "N").alias("bridges"))
    spines = rows.join(t.orders, F.col("o_orderkey") == F.col("id")).select("id", "methods", "bridges", F.col("o_custkey").alias("grp"), (F.col("o_orderstatus") == "F").alias("typed"))
    return K.top_spines(spines, "grp")


@query("f06_top_neighbors", oracle(SIGNALS + """, b AS (SELECT method_id, file, start_line, max(score) AS best FROM sc GROUP BY 1, 2, 3), e AS (SELECT DISTINCT l_suppkey AS m, l_partkey AS o FROM lineitem WHERE l_suppkey <> l_partkey AND l_returnflag = 'R')
    SELECT m AS method_id, o AS other, row_number() OVER (PARTITION BY m ORDER BY best DESC, file, start_line, o) AS rank FROM e JOIN b ON b.method_id = o QUALIFY rank <= 16""", *SB))
def f06(t):
    best = signals(t).groupBy("method_id").agg(F.max("score").alias("best")).join(t.scored_methods.select("method_id", "file", F.col("start_line").alias("line")), "method_id")
    edges = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("method_id"), F.col("l_partkey").alias("other"))
    return K.top_neighbors(edges, best).select("method_id", "other", "rank")


@query("f08_limit_flag", oracle("""WITH r AS (SELECT callee, site_id, row_number() OVER (PARTITION BY callee ORDER BY site_id) AS position, count(*) OVER (PARTITION BY callee) > 9 AS truncated FROM calls) SELECT * FROM r WHERE position <= 9""", "calls"))
def f08(t):
    return K.limit_flag(t.calls.select("callee", "site_id"), ["callee"], [F.col("site_id")], 9)


@query("f09_select_focus", """WITH b AS (SELECT user_id AS case_id, event_type AS category, count(*) FILTER (value > 150) AS cand, count(*) FILTER (value > 100) AS fr, bool_or(value > 60) AS proved, bool_or(value < 10) AS act, count(*) FILTER (value > 5) AS sinks, count(*) FILTER (value > 80) AS sources,
        CASE WHEN min(value) < 8 THEN CAST(floor(min(value)) AS INT) END AS dist, CASE WHEN max(value) > 250 THEN 'REVIEW_COMPLETE' END AS resolved FROM events GROUP BY 1, 2),
    s AS (SELECT *, CASE WHEN cand > 0 THEN 4 WHEN fr > 0 THEN 3 WHEN proved THEN 2 WHEN act THEN 1 ELSE 0 END AS evidence_score, act OR cand > 0 AS a FROM b),
    c AS (SELECT *, coalesce(resolved, CASE WHEN sinks = 0 OR NOT (a OR fr > 0) THEN 'PRUNED_LOW_POTENTIAL' END) AS closed FROM s),
    r AS (SELECT *, CASE WHEN closed IS NULL THEN row_number() OVER (PARTITION BY case_id, closed IS NULL ORDER BY evidence_score DESC, sources = 0, dist NULLS LAST, NOT a, category) END AS place FROM c)
    SELECT case_id, category, evidence_score, CASE WHEN closed IS NOT NULL THEN closed WHEN place <= 2 THEN 'FOCUS_SELECTED' ELSE 'FOCUS_NOT_SELECTED' END AS reason FROM r""")
def f09(t):
    v = F.col("value")
    branches = t.events.groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("category")).agg(
        F.count_if(v > 150).alias("candidates"), F.count_if(v > 100).alias("frontiers"), F.bool_or(v > 60).alias("static_proved"), F.bool_or(v < 10).alias("active"), F.count_if(v > 5).alias("sinks"), F.count_if(v > 80).alias("sources"),
        F.when(F.min(v) < 8, F.floor(F.min(v)).cast("int")).alias("distance"), F.when(F.max(v) > 250, "REVIEW_COMPLETE").alias("resolved"))
    return K.select_focus(branches)


@query("f10_top_links", oracle("""WITH l AS (SELECT caller AS o, callee AS n, min((kind <> 'CALL', a.class <> b.class, a.project <> b.project, CASE WHEN line < 6 THEN line ELSE 1073741824 END)) AS k FROM calls JOIN methods a ON a.method = caller JOIN methods b ON b.method = callee GROUP BY 1, 2)
    SELECT o AS owner, n AS neighbor, row_number() OVER (PARTITION BY o ORDER BY k, n) AS rank FROM l QUALIFY rank <= 2""", "calls", "methods"))
def f10(t):
    m = t.methods
    a = m.select(F.col("method").alias("caller"), F.col("class").alias("ac"), F.col("project").alias("ap"))
    b = m.select(F.col("method").alias("callee"), F.col("class").alias("bc"), F.col("project").alias("bp"))
    links = t.calls.join(a, "caller").join(b, "callee").select(
        F.col("caller").alias("owner"), F.col("callee").alias("neighbor"), F.when(F.col("kind") == "CALL", "VALUE_BRIDGE").otherwise("CALL").alias("kind"),
        (F.col("ac") == F.col("bc")).alias("same_type"), (F.col("ap") == F.col("bp")).alias("same_package"), F.when(F.col("line") < 6, F.col("line")).alias("distance"))
    return K.top_links(links)


@query("f11_pick_holdout", """SELECT l_suppkey AS id, count(*) AS size FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1 ORDER BY size, id LIMIT 1""")
def f11(t):
    projects = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    return K.pick_holdout(projects, t.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("id")))


@query("g05_all_candidates", oracle("SELECT input_id AS id, 'EXTERNAL_INPUT' AS kind FROM inputs UNION ALL SELECT effect_id, 'SECURITY_EFFECT' FROM effects", "inputs", "effects"))
def g05(t):
    return t.inputs.select(F.col("input_id").alias("id"), F.lit("EXTERNAL_INPUT").alias("kind")).unionByName(t.effects.select(F.col("effect_id").alias("id"), F.lit("SECURITY_EFFECT").alias("kind")))


@query("e02_dedup_last", """SELECT l_partkey AS id, max(""" + SITE + """) AS seq, arg_max(l_returnflag, """ + SITE + """) AS flag FROM lineitem GROUP BY 1""")
def e02(t):
    from pathloom.operators.pools import dedup

    return dedup(t.lineitem.select(F.col("l_partkey").alias("id"), site().alias("seq"), F.col("l_returnflag").alias("flag")), "id", "seq")


@query("e02_dedup_first", """SELECT l_partkey AS id, min(""" + SITE + """) AS seq, arg_min(l_returnflag, """ + SITE + """) AS flag FROM lineitem GROUP BY 1""")
def e02_first(t):
    from pathloom.operators.pools import dedup

    return dedup(t.lineitem.select(F.col("l_partkey").alias("id"), site().alias("seq"), F.col("l_returnflag").alias("flag")), "id", "seq", keep="first")
