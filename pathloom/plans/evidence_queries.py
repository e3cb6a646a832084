"""Evidence graph, proposals, audits and nested records over orders and their lines."""

from pyspark.sql import functions as F

from pathloom.bindings import oracle
from pathloom.operators import evidence as V
from pathloom.operators import records as N
from pathloom.registry import query
from pathloom.session import stored

SITE = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)"


def site():
    """The line's key as one text, as ``SITE`` says it in SQL."""
    return F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")])

ROLES = ["ARGUMENT", "PARAMETER", "RETURN", "FIELD", "ENTITY", "METHOD", "RECEIVER"]
KINDS = {"ECONOMY": "METHOD", "LARGE": "CALL", "MEDIUM": "PARAMETER", "PROMO": "FIELD", "SMALL": "CONSTRUCTOR", "STANDARD": "TYPE"}


def role_entities(t):
    kind = F.col("p_type")
    mapped = F.lit(None).cast("string")
    for name, value in KINDS.items():
        mapped = F.when(kind == name, value).otherwise(mapped)
    return t.part.select(F.col("p_partkey").alias("entity_id"), mapped.alias("kind"), (F.col("p_size") % 4).alias("n_params"), F.when(F.col("p_size") < 45, F.col("p_size") % 5).alias("n_args"), (F.col("p_size") % 3).alias("parameter_index"))


def role_refs(t):
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("l_linenumber"))
    index = F.when((F.col("l_returnflag") == "R") | ((F.col("l_linenumber") <= 2) & (F.col("l_returnflag") == "A")), (F.col("l_quantity") % 4).cast("int"))
    entity = F.when(F.col("l_quantity") == 50, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey"))
    return t.lineitem.select(site().alias("ref_id"), F.col("l_orderkey").alias("proposal_id"), entity.alias("entity_id"), role.alias("role"), index.alias("index"))


ROLE_SQL = f"""WITH ent AS (SELECT p_partkey AS id, CASE p_type WHEN 'ECONOMY' THEN 'METHOD' WHEN 'LARGE' THEN 'CALL' WHEN 'MEDIUM' THEN 'PARAMETER' WHEN 'PROMO' THEN 'FIELD' WHEN 'SMALL' THEN 'CONSTRUCTOR' ELSE 'TYPE' END AS kind,
        p_size % 4 AS np, CASE WHEN p_size < 45 THEN p_size % 5 END AS na, p_size % 3 AS pi FROM part),
    r AS (SELECT {SITE} AS ref_id, l_orderkey, CASE WHEN l_quantity = 50 THEN -l_partkey - 1 ELSE l_partkey END AS id, ['ARGUMENT', 'PARAMETER', 'RETURN', 'FIELD', 'ENTITY', 'METHOD', 'RECEIVER'][l_linenumber] AS role,
        CASE WHEN l_returnflag = 'R' OR (l_linenumber <= 2 AND l_returnflag = 'A') THEN CAST(l_quantity AS INT) % 4 END AS ix FROM lineitem),
    roles AS (SELECT r.ref_id, l_orderkey, CASE WHEN kind IS NULL THEN 'ENTITY_NOT_FOUND' WHEN role IN ('ARGUMENT', 'PARAMETER') AND ix IS NULL THEN 'ROLE_INDEX_REQUIRED' WHEN role NOT IN ('ARGUMENT', 'PARAMETER') AND ix IS NOT NULL THEN 'ROLE_INDEX_NOT_ALLOWED'
        WHEN NOT (role = 'ENTITY' OR (role = 'ARGUMENT' AND kind = 'CALL') OR (role = 'PARAMETER' AND kind IN ('METHOD', 'CONSTRUCTOR', 'PARAMETER')) OR (role = 'RETURN' AND kind IN ('METHOD', 'CONSTRUCTOR')) OR (role = 'FIELD' AND kind = 'FIELD')
            OR (role = 'METHOD' AND kind = 'METHOD') OR (role = 'RECEIVER' AND kind IN ('CALL', 'METHOD'))) THEN 'ROLE_ENTITY_KIND_MISMATCH'
        WHEN role = 'ARGUMENT' AND (na IS NULL OR ix >= na) THEN 'ARGUMENT_INDEX_OUT_OF_RANGE' WHEN role = 'PARAMETER' AND kind = 'PARAMETER' AND pi <> ix THEN 'PARAMETER_INDEX_MISMATCH'
        WHEN role = 'PARAMETER' AND kind <> 'PARAMETER' AND ix >= np THEN 'PARAMETER_INDEX_OUT_OF_RANGE' END AS error FROM r LEFT JOIN ent USING (id))
"""


@query("p17_validate_roles", ROLE_SQL + "SELECT ref_id, error FROM roles")
def p17(t):
    return V.validate_roles(role_refs(t), role_entities(t)).select("ref_id", "error")


TYPES = ["EXTERNAL_INPUT", "SECURITY_EFFECT", "WRAPPER_FLOW", "FIELD_STATE", "FRAMEWORK_RELATION", "CALLBACK_RELATION", "LIBRARY_FLOW"]


def proposals(t):
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    end = lambda name, role, kind: F.struct(F.concat(F.lit(name), k.cast("string")).alias("entity_id"), role.alias("role"), F.lit(kind).alias("kind"))
    none = F.lit(None).cast("struct<entity_id:string,role:string,kind:string>")
    scope = F.array(F.concat(F.lit("s"), k.cast("string")), F.concat(F.lit("a"), k.cast("string")), F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("b"), k.cast("string"))).otherwise("x.*"))
    return t.orders.select(
        k.alias("proposal_id"), pick(TYPES, k).alias("proposal_type"), pick(["HTTP", "NETWORK", "BOGUS"], c).alias("category"), pick(["CALLABLE", "FIELD"], c).alias("scope_kind"), scope.alias("scope"), F.lit("p").alias("project_id"),
        end("s", F.when(F.col("o_orderstatus") == "F", "FIELD").otherwise("METHOD"), "FIELD").alias("subject"), F.when(F.col("o_orderstatus") != "P", end("a", F.lit("ARGUMENT"), "CALL")).otherwise(none).alias("source"),
        F.when(F.col("o_orderstatus") != "O", end("b", F.lit("RETURN"), "METHOD")).otherwise(none).alias("target"))


SHAPE = """WITH p AS (SELECT o_orderkey AS id, ['EXTERNAL_INPUT', 'SECURITY_EFFECT', 'WRAPPER_FLOW', 'FIELD_STATE', 'FRAMEWORK_RELATION', 'CALLBACK_RELATION', 'LIBRARY_FLOW'][o_orderkey % 7 + 1] AS ty, ['HTTP', 'NETWORK', 'BOGUS'][o_custkey % 3 + 1] AS cat,
        o_custkey % 2 = 0 AS callable, o_orderstatus <> 'P' AS s, o_orderstatus <> 'O' AS t, o_orderstatus AS st, o_orderpriority = '5-LOW' AS low FROM orders),
    shape AS (SELECT id, concat_ws(',', CASE WHEN ty = 'EXTERNAL_INPUT' THEN 'EXTERNAL_INPUT_HAS_FLOW_ENDPOINTS' END, CASE WHEN ty = 'EXTERNAL_INPUT' AND cat <> 'HTTP' THEN 'INVALID_EXTERNAL_INPUT_CATEGORY' END,
        CASE WHEN ty = 'SECURITY_EFFECT' THEN 'SECURITY_EFFECT_HAS_FLOW_ENDPOINTS' END, CASE WHEN ty = 'SECURITY_EFFECT' AND cat <> 'NETWORK' THEN 'INVALID_SECURITY_EFFECT_CATEGORY' END,
        CASE WHEN ty IN ('WRAPPER_FLOW', 'LIBRARY_FLOW') AND NOT (s AND t) THEN 'FLOW_ENDPOINT_REQUIRED' END, CASE WHEN ty IN ('WRAPPER_FLOW', 'LIBRARY_FLOW') AND NOT callable THEN 'FLOW_SCOPE_MUST_BE_CALLABLE' END,
        CASE WHEN ty = 'FIELD_STATE' AND NOT (s AND t) THEN 'FIELD_STATE_ANCHORS_REQUIRED' END, CASE WHEN ty = 'FIELD_STATE' AND s AND t AND st <> 'F' THEN 'FIELD_STATE_FIELD_ROLE_REQUIRED' END,
        CASE WHEN ty = 'FRAMEWORK_RELATION' AND NOT t THEN 'FRAMEWORK_TARGET_REQUIRED' END, CASE WHEN ty = 'CALLBACK_RELATION' AND NOT t THEN 'CALLBACK_TARGET_REQUIRED' END, CASE WHEN ty = 'CALLBACK_RELATION' AND t THEN 'CALLBACK_TARGET_ROLE_INVALID' END) AS shape_errors,
        concat_ws(',', CASE WHEN low THEN 'WILDCARD_OR_UNBOUNDED_SCOPE' END, CASE WHEN low AND t THEN 'SCOPE_DOES_NOT_BOUND_ALL_ANCHORS' END) AS scope_errors FROM p)
"""


@query("p18_validate_shape", SHAPE + "SELECT id AS proposal_id, shape_errors, scope_errors FROM shape")
def p18(t):
    return V.validate_shape(proposals(t)).select("proposal_id", F.array_join("shape_errors", ",").alias("shape_errors"), F.array_join("scope_errors", ",").alias("scope_errors"))


def gated(t):
    """A proposal per order: its first two lines' parts are its ends, lines with flag N its citations; parts are entities."""
    entities = role_entities(t).join(t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("file"), F.col("p_size").alias("start"), (F.col("p_size") + 1).alias("end"), F.col("p_name").alias("enclosing")), "entity_id")
    files = t.part.select(F.col("p_brand").alias("file"), F.lit(50).alias("n_lines")).distinct()
    refs = role_refs(t).join(t.lineitem.filter("l_returnflag = 'N'").select(site().alias("ref_id")), "ref_id", "left_semi").withColumn("role", F.lit("ENTITY")).withColumn("index", F.lit(None).cast("int"))
    flow = t.lineitem.filter("l_returnflag = 'A'")
    part = F.when(F.col("l_linenumber") >= 6, F.col("l_partkey")).otherwise(F.col("l_partkey") + 0)
    evidence = flow.select(site().alias("evidence_id"), part.alias("entity_id"), (F.col("l_quantity") <= 40).alias("resolved"), (F.col("l_linestatus") == "O").alias("weak"), (F.col("l_linenumber") == 1).alias("proven"))
    # Evidence of an order cites the entity of its own reference when the line is late, so locality both holds and fails.
    own = refs.groupBy(F.col("proposal_id")).agg(F.min("entity_id").alias("own"))
    evidence = evidence.join(flow.select(site().alias("evidence_id"), F.col("l_orderkey").alias("proposal_id"), "l_linenumber"), "evidence_id").join(own, "proposal_id", "left").select(
        "evidence_id", F.when((F.col("l_linenumber") <= 5) & F.col("own").isNotNull(), F.col("own")).otherwise(F.col("entity_id")).alias("entity_id"), "resolved", "weak", "proven")
    citations = flow.select(F.col("l_orderkey").alias("proposal_id"), site().alias("evidence_id"))
    rows = t.orders.select(F.col("o_orderkey").alias("proposal_id"), F.col("o_orderkey").alias("seq"), F.floor(F.col("o_totalprice") / 300).cast("long").alias("proposal_key"))
    native = t.customer.select((F.col("c_custkey") + 100).alias("proposal_key"))
    shape = V.validate_shape(proposals(t)).withColumn("shape_errors", F.filter("shape_errors", lambda e: e == "FLOW_ENDPOINT_REQUIRED")).withColumn("scope_errors", F.filter("scope_errors", lambda e: e == "SCOPE_DOES_NOT_BOUND_ALL_ANCHORS"))
    return V.gate(rows, refs, entities, files, citations, evidence, native, shape)


GATE = SHAPE[:-1].replace("WITH p AS", ROLE_SQL[:-1] + ", p AS") + f""",
    rf AS (SELECT l_orderkey AS pid, CASE WHEN l_quantity = 50 THEN -l_partkey - 1 ELSE l_partkey END AS id FROM lineitem WHERE l_returnflag = 'N'),
    en AS (SELECT pid, bool_or(p_partkey IS NULL) AS noent, bool_or(p_size + 1 > 50) AS badloc, min(id) AS own FROM rf LEFT JOIN part ON p_partkey = id GROUP BY 1),
    ev AS (SELECT l_orderkey AS pid, {SITE} AS eid, CASE WHEN l_linenumber <= 5 AND own IS NOT NULL THEN own ELSE l_partkey END AS ent, l_quantity <= 40 AS res, l_linestatus = 'O' AS weak, l_linenumber = 1 AS proven FROM lineitem LEFT JOIN en ON en.pid = l_orderkey WHERE l_returnflag = 'A'),
    nr AS (SELECT ev.pid, eid, any_value(res) AS res, any_value(weak) AS weak, any_value(proven) AS proven, bool_or(coalesce(ev.ent = rf.id OR (ep.p_brand = ap.p_brand AND ep.p_name = ap.p_name), false)) AS loc
        FROM ev JOIN rf ON rf.pid = ev.pid LEFT JOIN part ep ON ep.p_partkey = ev.ent LEFT JOIN part ap ON ap.p_partkey = rf.id GROUP BY 1, 2),
    pf AS (SELECT pid, bool_or(NOT res) AS unres, bool_or(NOT loc) AS unrel, bool_and(weak) AS ow, bool_or(proven) AS pv FROM nr GROUP BY 1),
    w AS (SELECT o_orderkey AS pid, CAST(floor(o_totalprice / 300) AS BIGINT) AS key, CASE WHEN noent THEN 'ENTITY_EXISTENCE' WHEN badloc THEN 'LOCATION_VALIDITY' WHEN contains(shape_errors, 'FLOW_ENDPOINT_REQUIRED') THEN 'ROLE_COMPATIBILITY'
            WHEN unres THEN 'EVIDENCE_RESOLUTION' WHEN unrel THEN 'EVIDENCE_LOCALITY' WHEN contains(scope_errors, 'BOUND_ALL') THEN 'SCOPE_BOUND' END AS fc, pf.pid IS NULL OR ow AS thin, pv FROM orders LEFT JOIN en ON en.pid = o_orderkey LEFT JOIN pf ON pf.pid = o_orderkey LEFT JOIN shape ON id = o_orderkey),
    x AS (SELECT w.*, c_custkey IS NOT NULL AS nat, min(CASE WHEN fc IS NULL AND c_custkey IS NULL THEN pid END) OVER (PARTITION BY key) AS f FROM w LEFT JOIN customer ON c_custkey + 100 = key),
    gate AS (SELECT pid AS proposal_id, CASE WHEN fc IS NOT NULL THEN 'REJECTED' WHEN nat THEN 'ALREADY_SUPPORTED' WHEN f <> pid THEN 'DUPLICATE' WHEN thin THEN 'NEEDS_MORE_EVIDENCE' ELSE 'ADMISSIBLE' END AS status, fc, pv FROM x)
"""


@query("p16_gate", GATE + """SELECT proposal_id, status, coalesce(fc, CASE WHEN status = 'NEEDS_MORE_EVIDENCE' THEN 'EVIDENCE_SUFFICIENCY' END) AS failed_check, CASE WHEN status = 'ADMISSIBLE' THEN CASE WHEN pv THEN 'CODEQL_ASSISTED' ELSE 'REPOSITORY_ONLY' END END AS admission_basis FROM gate""")
def p16(t):
    return gated(t)


@query("d37_gate_counts", GATE + """SELECT count(*) FILTER (status = 'ADMISSIBLE') AS admissible, count(*) FILTER (status = 'ALREADY_SUPPORTED') AS already_supported, count(*) FILTER (status = 'DUPLICATE') AS duplicate,
    count(*) FILTER (status = 'NEEDS_MORE_EVIDENCE') AS needs_more_evidence, count(*) FILTER (status = 'REJECTED') AS rejected FROM gate""")
def d37(t):
    return V.gate_counts(gated(t))


RELATIONS = ["CODEQL_CALL", "LEXICAL_CALL", "WRAPPER_FLOW", "CODEQL_DATAFLOW", "DECLARES", "NONSENSE"]
SUPPORTS = ["DETERMINISTIC_FACT", "STRUCTURAL_EVIDENCE", "ADMISSIBLE_SEMANTIC_PROPOSAL", "DETERMINISTIC_FACT", "STRUCTURAL_EVIDENCE", "STRUCTURAL_EVIDENCE"]


def graph_edges(t):
    """An edge per line from its order's customer to its part; a citation, a tool call and a proposal hang on it."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("l_suppkey") % len(values) + 1).cast("int"))
    li = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("o_orderkey") == F.col("l_orderkey"))
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    # Lines meet their orders once; all that hangs on an edge is read from this table.
    e = stored(li.select(
        F.concat_ws("-", site(), F.col("l_quantity").cast("int").cast("string"), "l_returnflag").alias("edge_id"),
        "l_orderkey", "o_custkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag", "l_linestatus"))
    edges = e.select("edge_id", s("c", "o_custkey").alias("src"), s("p", "l_partkey").alias("dst"), pick(RELATIONS).alias("relation"), F.when(F.col("l_linenumber") == 7, "STRUCTURAL_EVIDENCE").otherwise(pick(SUPPORTS)).alias("support"),
                     F.col("l_orderkey").alias("proposal_id"), (F.col("l_quantity") > 2).alias("provenance"))
    refs = e.filter("l_quantity > 4").select("edge_id", F.when(F.col("l_quantity") == 50, F.concat(F.lit("x"), "edge_id")).otherwise(F.col("edge_id")).alias("evidence_id"))
    tools_used = e.filter("l_tax > 0.005").select("edge_id", F.col("l_orderkey").alias("tool_id"))
    nodes = t.customer.select(s("c", "c_custkey").alias("node"), F.when(F.col("c_nationkey") == 0, "other").otherwise("main").alias("project")).unionByName(
        t.part.filter("p_size > 1").select(s("p", "p_partkey").alias("node"), F.lit("main").alias("project")))
    kind = F.when(F.col("l_returnflag") == "R", "SOURCE_SNIPPET").otherwise(pick(RELATIONS))
    evidence = e.select(F.col("edge_id").alias("evidence_id"), kind.alias("source_kind"), F.when(F.col("l_linestatus") == "O", F.col("l_orderkey")).otherwise(-1).alias("tool_id"))
    covers = e.select(F.col("edge_id").alias("evidence_id"), s("c", "o_custkey").alias("node")).unionByName(e.filter("l_linenumber <> 3").select(F.col("edge_id").alias("evidence_id"), s("p", "l_partkey").alias("node"))).unionByName(
        e.filter("l_quantity = 49").select(F.col("edge_id").alias("evidence_id"), F.lit("gone").alias("node")))
    tools = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("tool_id"), F.when(F.col("o_orderpriority") == "5-LOW", "ERROR").otherwise("OK").alias("status"))
    props = t.orders.select(F.col("o_orderkey").alias("proposal_id"), F.when(F.col("o_orderstatus") == "F", "ADMISSIBLE").otherwise("REJECTED").alias("status"))
    prop_refs = refs.join(edges.select("edge_id", "proposal_id"), "edge_id").select("proposal_id", "evidence_id")
    return V.admit_edges(edges, refs, tools_used, nodes, evidence, covers, tools, props, prop_refs)


ADMIT = f"""WITH e0 AS (SELECT concat_ws('-', {SITE}, CAST(l_quantity AS INT), l_returnflag) AS edge_id, l.*, o_custkey, o_orderstatus, o_orderpriority, {RELATIONS}[l_suppkey % 6 + 1] AS relation, CASE WHEN l_linenumber = 7 THEN 'STRUCTURAL_EVIDENCE' ELSE {SUPPORTS}[l_suppkey % 6 + 1] END AS support
        FROM lineitem l JOIN orders ON o_orderkey = l_orderkey),
    w AS (SELECT l_orderkey, count(*) AS nw FROM e0 WHERE l_quantity > 4 GROUP BY 1),
    j AS (SELECT e0.*, c_nationkey, p_size, coalesce(nw, 0) AS nw, CASE WHEN l_returnflag = 'R' THEN 'SOURCE_SNIPPET' ELSE relation END AS sk, l_linenumber <> 3 AND p_size > 1 AS both_ends FROM e0 JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey LEFT JOIN w USING (l_orderkey)),
    judged AS (SELECT edge_id, relation, support, CASE WHEN relation = 'NONSENSE' THEN 'UNKNOWN_RELATION_OR_SUPPORT' WHEN p_size <= 1 THEN 'EDGE_NODE_NOT_FOUND' WHEN c_nationkey = 0 THEN 'CROSS_REPOSITORY_EDGE'
        WHEN l_linenumber = 7 AND relation NOT IN ('LEXICAL_CALL', 'DECLARES') THEN 'SUPPORT_CLASS_MISMATCH' WHEN l_quantity <= 4 THEN 'ANONYMOUS_EDGE' WHEN l_quantity <= 2 THEN 'EDGE_PROVENANCE_REQUIRED'
        WHEN l_quantity = 50 THEN 'EVIDENCE_REF_NOT_FOUND' WHEN l_quantity = 49 THEN 'EVIDENCE_ENTITY_NOT_FOUND'
        WHEN relation LIKE 'CODEQL%' AND sk <> relation THEN 'FABRICATED_CODEQL_EDGE' WHEN relation LIKE 'CODEQL%' AND (l_tax <= 0.005 OR o_orderstatus = 'P') THEN 'CODEQL_TOOL_CALL_NOT_FOUND' WHEN relation LIKE 'CODEQL%' AND o_orderpriority = '5-LOW' THEN 'CODEQL_TOOL_CALL_NOT_OK'
        WHEN relation LIKE 'CODEQL%' AND NOT (both_ends AND l_linestatus = 'O') THEN 'CODEQL_TOOL_EVIDENCE_MISMATCH' WHEN relation IN ('LEXICAL_CALL', 'DECLARES') AND sk <> 'SOURCE_SNIPPET' THEN 'REPOSITORY_EVIDENCE_REQUIRED'
        WHEN relation IN ('LEXICAL_CALL', 'DECLARES') AND NOT both_ends THEN 'REPOSITORY_EVIDENCE_ENDPOINT_MISMATCH' WHEN relation = 'WRAPPER_FLOW' AND o_orderstatus <> 'F' THEN 'PROPOSAL_NOT_ADMISSIBLE'
        WHEN relation = 'WRAPPER_FLOW' AND nw <> 1 THEN 'PROPOSAL_EVIDENCE_MISMATCH' END AS code FROM j)
"""


@query("p15_admit_edges", ADMIT + "SELECT edge_id FROM judged WHERE code IS NULL")
def p15(t):
    return graph_edges(t)[0].select("edge_id")


@query("p15_refused_edges", ADMIT + "SELECT edge_id, code FROM judged WHERE code IS NOT NULL")
def p15_refused(t):
    return graph_edges(t)[1]


@query("d27_graph_summary", ADMIT + """, pa AS (SELECT l_orderkey, count(*) AS length FROM lineitem GROUP BY 1)
    SELECT concat('relation:', relation) AS name, CAST(count(*) AS DOUBLE) AS value FROM judged WHERE code IS NULL GROUP BY 1 UNION ALL SELECT concat('support:', support), count(*) FROM judged WHERE code IS NULL GROUP BY 1
    UNION ALL SELECT concat('refused:', code), count(*) FROM judged WHERE code IS NOT NULL GROUP BY 1 UNION ALL SELECT 'edges', count(*) FROM judged WHERE code IS NULL
    UNION ALL SELECT 'paths', count(*) FROM pa UNION ALL SELECT 'average_path_length', round(avg(length), 6) FROM pa""")
def d27(t):
    good, bad = graph_edges(t)
    return V.graph_summary(good, t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("length")), bad)


# -- replay: a case per customer; its orders are nodes, calls are program edges, some carry a proposal step ----------

def replay(t):
    """Per customer a chain of three nodes 0 -> 1 -> 2; every order adds an edge, numbered by status and priority."""
    o = t.orders
    hop = F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    step = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    edges = o.select(F.col("o_custkey").alias("case_id"), hop.alias("src"), (hop + 1).alias("dst"), step.alias("step")).distinct()
    ends = o.select(F.col("o_custkey").alias("case_id"), F.lit(0).alias("input"), F.lit(2).alias("effect")).distinct()
    return edges, ends


REPLAY = """WITH e AS (SELECT DISTINCT o_custkey AS c, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS h, CAST(left(o_orderpriority, 1) AS INT) - 1 AS step FROM orders),
    m AS (SELECT c, CASE WHEN count(DISTINCT h) = 2 THEN greatest(min(step) FILTER (h = 0), min(step) FILTER (h = 1)) END AS rec FROM e GROUP BY 1)
"""


def recovery(t):
    return V.first_recovery(*replay(t))


@query("e14_first_recovery", REPLAY + "SELECT c AS case_id, rec AS recovered_step FROM m")
def e14(t):
    return recovery(t).select("case_id", F.col("recovered_step").cast("int").alias("recovered_step"))


@query("e16_counterfactual", REPLAY + "SELECT c AS case_id, rec IS NOT NULL AS recovered, coalesce(rec = 0, false) AS recovered_without, coalesce(rec > 0, false) AS recovery_removed FROM m")
def e16(t):
    return V.counterfactual(recovery(t))


LOO = REPLAY + """, u AS (SELECT DISTINCT e.c, step AS omitted, rec FROM e JOIN m ON m.c = e.c WHERE step > 0 AND step <= rec),
    loo AS (SELECT u.c, omitted, EXISTS (SELECT 1 FROM e WHERE e.c = u.c AND h = 0 AND step <= rec AND step <> omitted) AND EXISTS (SELECT 1 FROM e WHERE e.c = u.c AND h = 1 AND step <= rec AND step <> omitted) AS still FROM u)
"""


@query("e15_leave_one_out", LOO + "SELECT c AS case_id, omitted, still AS still_recovered FROM loo")
def e15(t):
    edges, ends = replay(t)
    return V.leave_one_out(edges, ends, recovery(t))


@query("e15_minimality", LOO + "SELECT c AS case_id, count(*) AS used, bool_and(NOT still) AS all_necessary FROM loo GROUP BY 1")
def e15_minimality(t):
    edges, ends = replay(t)
    return V.minimality(V.leave_one_out(edges, ends, recovery(t)))


INVENTORY = """WITH i AS (SELECT l_suppkey AS p, l_orderkey AS c, s_acctbal > 0 AS src, s_nationkey <> 3 AS db, bool_or(l_returnflag = 'R') AS det, bool_or(l_quantity >= 25) AS hint FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3, 4),
    inv AS (SELECT p AS project_id, c AS case_id, concat_ws('|', CASE WHEN NOT src THEN 'SOURCE_NOT_READY' END, CASE WHEN NOT db THEN 'CODEQL_DB_NOT_READY' END, CASE WHEN det THEN 'BASELINE_DETECTED' END, CASE WHEN NOT hint THEN 'BENCHMARK_ANNOTATION_UNAVAILABLE' END) AS exclusion_reason FROM i)
"""


def case_rows(t):
    cases = t.lineitem.groupBy(F.col("l_suppkey").alias("project_id"), F.col("l_orderkey").alias("case_id")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("detected"))
    projects = t.supplier.select(F.col("s_suppkey").alias("project_id"), (F.col("s_acctbal") > 0).alias("source_ready"), (F.col("s_nationkey") != 3).alias("db_ready"))
    told = t.lineitem.filter("l_quantity >= 25").select(F.col("l_suppkey").alias("project_id"), F.col("l_orderkey").alias("case_id"))
    return V.case_inventory(cases, projects, told)


@query("p21_case_inventory", INVENTORY + "SELECT project_id, case_id, exclusion_reason = '' AS eligible, exclusion_reason FROM inv")
def p21(t):
    return case_rows(t)


@query("p21_select_cases", INVENTORY + "SELECT project_id, case_id, row_number() OVER (ORDER BY project_id, case_id) AS selection_rank, 'PROJECT_ID_THEN_CASE_ID_FIRST_12' AS selection_rule FROM inv WHERE exclusion_reason = '' ORDER BY project_id, case_id LIMIT 12")
def p21_select(t):
    return V.select_cases(case_rows(t))


@query("p22_hints", f"""WITH f AS (SELECT l_orderkey AS case_id, {SITE} AS seq, concat('P', l_partkey) AS file, CASE WHEN l_returnflag <> 'N' THEN concat('m', l_suppkey) ELSE '' END AS method, l_linenumber % 3 AS n, CASE WHEN l_quantity > 10 THEN l_linenumber END AS s FROM lineitem),
    b AS (SELECT case_id, min(seq) AS seq FROM f WHERE method <> '' AND n > 0 GROUP BY 1)
    SELECT c.case_id, f.file, f.method, CASE WHEN f.method IS NOT NULL THEN coalesce(s, 0) END AS start_line, CASE WHEN f.method IS NOT NULL THEN coalesce(s + 5, 0) END AS end_line, CASE WHEN f.method IS NULL THEN 'INSUFFICIENT_PROGRAM_EVIDENCE' END AS status
    FROM (SELECT DISTINCT case_id FROM f) c LEFT JOIN b USING (case_id) LEFT JOIN f ON f.case_id = b.case_id AND f.seq = b.seq""")
def p22(t):
    start = F.when(F.col("l_quantity") > 10, F.col("l_linenumber"))
    return V.hints(t.lineitem.select(
        F.col("l_orderkey").alias("case_id"), site().alias("seq"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("file"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("m"), F.col("l_suppkey").cast("string"))).otherwise("").alias("method"), (F.col("l_linenumber") % 3).alias("n_params"), start.alias("start"), (start + 5).alias("end")))


@query("d26_audit_artifacts", """WITH f AS (SELECT DISTINCT l_orderkey AS c, concat('f', l_linenumber) AS name FROM lineitem), h AS (SELECT l_orderkey AS c, concat('f', l_linenumber) AS name, bool_or(l_quantity = 13) AS bad FROM lineitem GROUP BY 1, 2),
    ms AS (SELECT o_orderkey AS c, n.name FROM orders CROSS JOIN (VALUES ('f2'), ('f5')) n(name) WHERE (o_orderkey, n.name) NOT IN (SELECT (c, name) FROM f)), ok AS (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT c FROM ms)),
    r AS (SELECT o_orderkey AS c, o_orderstatus = 'F' AS rec, o_orderpriority <> '5-LOW' AS causal, o_orderpriority <> '4-NOT SPECIFIED' AS minimal, o_custkey % 8 AS props, o_custkey % 4 AS paths, CASE WHEN o_orderstatus = 'O' THEN 'GATE_BLOCKED' ELSE 'STRANGE' END AS fr FROM ok)
    SELECT c AS case_id, 'MISSING_CASE_FILES' AS violation, name AS subject FROM ms UNION ALL SELECT h.c, 'CASE_HASH_MISMATCH', name FROM h JOIN ok ON o_orderkey = h.c WHERE bad
    UNION ALL SELECT c, 'PROPOSAL_BUDGET_EXCEEDED', '' FROM r WHERE props > 6 UNION ALL SELECT c, 'COUNTERFACTUAL_NOT_CAUSAL', '' FROM r WHERE rec AND NOT causal UNION ALL SELECT c, 'PROPOSAL_SET_NOT_MINIMAL', '' FROM r WHERE rec AND props > 1 AND NOT minimal
    UNION ALL SELECT c, 'RECOVERY_PATH_MISSING', '' FROM r WHERE rec AND paths = 0 UNION ALL SELECT c, 'FAILURE_TAXONOMY_INVALID', '' FROM r WHERE NOT rec AND fr <> 'GATE_BLOCKED'""")
def d26(t):
    name = F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))
    held = t.lineitem.groupBy(F.col("l_orderkey").alias("case_id"), name.alias("name")).agg(F.bool_or(F.col("l_quantity") == 13).alias("bad"))
    files = held.select("case_id", "name", F.lit("a").alias("sha256"))
    hashes = held.select("case_id", "name", F.when(F.col("bad"), "b").otherwise("a").alias("expected"))
    o = t.orders
    results = o.select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderstatus") == "F").alias("recovered"), (F.col("o_orderpriority") != "5-LOW").alias("causal"), (F.col("o_orderpriority") != "4-NOT SPECIFIED").alias("minimal"),
                       (F.col("o_custkey") % 8).alias("proposals"), (F.col("o_custkey") % 4).alias("paths"), F.when(F.col("o_orderstatus") == "O", "GATE_BLOCKED").otherwise("STRANGE").alias("failure_reason"))
    return V.audit_artifacts(o.select(F.col("o_orderkey").alias("case_id")), files, hashes, results, ["f2", "f5"], ["GATE_BLOCKED", "NOT_EXPRESSIBLE"], 6)


# -- nested records --------------------------------------------------------------------------------

def manifests(t):
    """A project record per order; some carry a label key two levels down, lack a field or hold an empty one."""
    k = F.col("o_orderkey").cast("string")
    inner = F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", F.struct(F.lit("x").alias("CWE_id"))).alias("deep"))
    rec = F.struct(
        F.concat(F.lit("p"), F.when(F.col("o_orderstatus") == "P", F.col("o_custkey")).otherwise(F.col("o_orderkey") + 1000000000).cast("string")).alias("project"), F.lit("r").alias("revision"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "").otherwise("s").alias("source_path"), F.when(F.col("o_orderpriority") != "5-LOW", k).alias("codeql_db_path"), F.when(F.col("o_orderpriority") == "1-URGENT", inner).alias("notes"))
    return t.orders.select(F.col("o_orderkey").alias("key"), F.to_json(rec).alias("text"))


@query("p14_validate_contract", """WITH d AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
    SELECT o_orderkey AS key, 'FORBIDDEN_KEY' AS violation, 'cwe_id' AS detail FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 'FIELD_CONTRACT', 'missing=;extra=notes' FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_orderkey, 'EMPTY_FIELD', '' FROM orders WHERE o_orderpriority IN ('2-HIGH', '1-URGENT') UNION ALL SELECT o_orderkey, 'FIELD_CONTRACT', 'missing=codeql_db_path;extra=' FROM orders WHERE o_orderpriority = '5-LOW'
    UNION ALL SELECT o_orderkey, 'DUPLICATE_PROJECT', concat('p', o_custkey) FROM orders JOIN d USING (o_custkey) WHERE o_orderstatus = 'P' AND n > 1""")
def p14(t):
    return N.validate_contract(manifests(t), "key", "text", "project")


def contexts(t):
    """A context per order: each line leaves a source note, an inventory item and a shared profile of its part."""
    rows = t.lineitem.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")))).alias("s"))
    least = F.array_min(F.transform("s", lambda x: F.struct((x["supp"] % 5).alias("k"), F.concat(F.lit("P"), x["part"].cast("string")).alias("name"))))
    profile = F.struct(least["name"].alias("name"), F.repeat(F.lit("x"), 260).alias("text"))
    same = F.struct(F.lit("common").alias("name"), F.repeat(F.lit("y"), 300).alias("text"))
    rec = F.struct(
        F.transform("s", lambda x: F.struct(x["line"].alias("line"), x["part"].alias("part"))).alias("source_evidence"), F.transform("s", lambda x: x["supp"]).alias("inventory"),
        F.transform("s", lambda x: same).alias("feedback"), profile.alias("profile"))
    return t.orders.join(rows, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("key"), F.to_json(rec).alias("text"))


@query("d35_component_sizes", """SELECT 'source' AS component, 2 * count(*) AS leaves, CAST(sum(length(CAST(l_linenumber AS VARCHAR)) + length(CAST(l_partkey AS VARCHAR))) AS BIGINT) AS bytes FROM lineitem
    UNION ALL SELECT 'inventory', count(*), CAST(sum(length(CAST(l_suppkey AS VARCHAR))) AS BIGINT) FROM lineitem UNION ALL SELECT 'historical_observations', 2 * count(*), count(*) * (8 + 302) FROM lineitem
    UNION ALL SELECT 'other_and_framing', 2 * count(*), CAST(sum(262 + 3 + length(CAST(p AS VARCHAR))) AS BIGINT) FROM (SELECT l_orderkey, arg_min(l_partkey, (l_suppkey % 5, concat('P', l_partkey))) AS p FROM lineitem GROUP BY 1)""")
def d35(t):
    return N.component_sizes(N.json_nodes(contexts(t), "key", "text"))


@query("d36_factor_repeats", "SELECT l_orderkey AS key, count(*) AS occurrences FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def d36(t):
    return N.factor_repeats(N.json_nodes(contexts(t), "key", "text"))[0].select("key", "occurrences")


@query("d36_references", """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
    SELECT l_orderkey AS key, concat('feedback.', i) AS path FROM s WHERE n > 1""")
def d36_references(t):
    refs = N.factor_repeats(N.json_nodes(contexts(t), "key", "text"))[1]
    return refs.select("key", F.array_join("path", ".").alias("path"))
