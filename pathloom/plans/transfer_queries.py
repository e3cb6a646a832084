"""Value transfers, value paths and symbol work: orders are callables, lines are calls into the order named by the part key."""

from pyspark.sql import functions as F

from pathloom.bindings import oracle
from pathloom.operators import graph as G
from pathloom.operators import reach as R
from pathloom.operators import symbols as Y
from pathloom.operators import transfers as X
from pathloom.registry import query

CB = ("calls", "sites", "methods", "inputs", "effects", "flow_edges")


def call_rows(t):
    return t.calls.select(F.col("site_id").alias("call"), F.col("callee").alias("target"), (F.col("kind") == "DIRECT_CALL").alias("direct"))


def argument_rows(calls):
    """Every call has three arguments; the one at its line's place modulo three is a constant."""
    return calls.select(F.col("site_id").alias("call"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("index"), "line").select(
        "call", "index", (F.col("line") % 3 == F.col("index")).alias("constant"))


def param_rows(t):
    return t.methods.select(F.col("method").alias("target"), F.explode(F.array(F.lit(0), F.lit(1))).alias("position"), "status").select(
        "target", "position", ((F.col("position") == 1) & (F.col("status") == "O")).alias("varargs"))


ARGS = """WITH cl AS (SELECT site_id AS call, callee AS target, kind = 'DIRECT_CALL' AS direct, line FROM calls), ar AS (SELECT call, i AS ix FROM cl CROSS JOIN (VALUES (0), (1), (2)) v(i) WHERE line % 3 <> i),
    pa AS (SELECT method AS target, i AS position, i = 1 AND status = 'O' AS varargs FROM methods CROSS JOIN (VALUES (0), (1)) v(i))
"""


@query("c21_static_transfers", oracle(ARGS + """SELECT i.input_id AS source, 'CALL_RESULT' AS from_role, -1 AS from_index, e.effect_id AS sink, 'ARGUMENT' AS to_role, CAST(e.line % 3 AS INT) AS to_index, 'static' AS kind FROM inputs i JOIN effects e ON e.method = i.method AND i.line < e.line
    UNION SELECT cl.call, 'ARGUMENT', ix, cl.call, 'CALL_RESULT', -1, 'static' FROM cl JOIN ar USING (call) JOIN methods ON method = target AND status = 'F' WHERE direct AND ix = 0
    UNION SELECT cl.call, 'ARGUMENT', ix, CAST(cl.target AS VARCHAR), 'PARAMETER', ix, 'static' FROM cl JOIN ar USING (call) JOIN pa ON pa.target = cl.target AND position = ix WHERE direct AND NOT varargs
    UNION SELECT CAST(target AS VARCHAR), 'RETURN', -1, cl.call, 'CALL_RESULT', -1, 'static' FROM cl JOIN methods ON method = target AND status <> 'P' WHERE direct""", *CB))
def c21(t):
    inputs = t.inputs.select(F.col("method").alias("owner"), F.col("input_id").alias("site"), F.lit("CALL_RESULT").alias("role"), F.lit(-1).alias("index"), F.col("input_id").alias("node"), "line")
    outputs = t.effects.select(F.col("method").alias("owner"), F.col("effect_id").alias("site"), F.lit("ARGUMENT").alias("role"), (F.col("line") % 3).alias("index"), F.col("effect_id").alias("node"), "line")
    flow = inputs.select("owner", F.col("node").alias("src"), F.col("line").alias("a")).join(outputs.select("owner", F.col("node").alias("dst"), F.col("line").alias("b")), "owner").filter("a < b")
    through = t.methods.filter("status = 'F'").select(F.col("method").alias("target"), F.lit(0).alias("position"))
    returns = t.methods.filter("status <> 'P'").select(F.col("method").alias("target"))
    return X.static_transfers(inputs, outputs, flow, call_rows(t), argument_rows(t.calls), param_rows(t), through, returns)


@query("c22_closure_transfers", oracle(ARGS + """, al AS (SELECT call, target AS ctor, target AS ty FROM cl WHERE NOT direct), cb AS (SELECT package AS ty, method FROM methods WHERE status = 'F'),
    cp AS (SELECT method AS ctor, 0 AS position, package AS field FROM methods WHERE status <> 'P'), fo AS (SELECT m.package AS field, e.method, e.effect_id AS site, CAST(e.line % 3 AS INT) AS ix FROM effects e JOIN methods m ON m.method = e.method)
    SELECT al.call AS source, 'ARGUMENT' AS from_role, ar.ix AS from_index, CAST(cb.method AS VARCHAR) AS sink, 'RECEIVER' AS to_role, -1 AS to_index, 'closure_object_bridge' AS kind FROM al JOIN ar USING (call) JOIN cb USING (ty)
    UNION SELECT al.call, 'ARGUMENT', ar.ix, fo.site, 'ARGUMENT', fo.ix, 'closure_object_bridge' FROM al JOIN ar USING (call) JOIN cb USING (ty) JOIN cp ON cp.ctor = al.ctor AND cp.position = ar.ix JOIN fo ON fo.field = cp.field AND fo.method = cb.method""", *CB))
def c22_closure(t):
    allocations = call_rows(t).filter("NOT direct").select("call", F.col("target").alias("ctor"), F.col("target").alias("type"))
    callbacks = t.methods.filter("status = 'F'").select(F.col("package").alias("type"), "method")
    captures = t.methods.filter("status <> 'P'").select(F.col("method").alias("ctor"), F.lit(0).alias("position"), F.col("package").alias("field"))
    outputs = t.effects.join(t.methods.select("method", F.col("package").alias("field")), "method").select("field", "method", F.col("effect_id").alias("site"), F.lit("ARGUMENT").alias("role"), (F.col("line") % 3).alias("index"))
    # Direct calls allocate nothing, so their arguments meet no allocation.
    return X.closure_transfers(allocations, argument_rows(t.calls.filter("kind <> 'DIRECT_CALL'")), callbacks, captures, outputs)


@query("c22_builder_transfers", oracle(ARGS + """, up AS (SELECT site_id AS call, caller AS method, CASE WHEN receiver % 2 = 0 THEN 0 END AS variable, line, receiver, callee % 3 > 0 AS recv FROM calls), gv AS (SELECT up.*, ix FROM up JOIN ar USING (call))
    SELECT call AS source, 'ARGUMENT' AS from_role, ix AS from_index, call AS sink, 'CALL_RESULT' AS to_role, -1 AS to_index, 'builder_receiver_bridge' AS kind FROM gv
    UNION SELECT call, 'ARGUMENT', ix, call, 'CALL_RECEIVER', -1, 'builder_receiver_bridge' FROM gv WHERE recv
    UNION SELECT gv.call, 'ARGUMENT', ix, u.call, 'CALL_RECEIVER', -1, 'builder_receiver_bridge' FROM gv JOIN up u ON u.method = gv.method AND u.variable = gv.variable AND u.call <> gv.call AND (gv.line, gv.receiver) < (u.line, u.receiver)""", *CB))
def c22_builder(t):
    rows = t.calls.select(F.col("site_id").alias("call"), F.col("caller").alias("method"), F.when(F.col("receiver") % 2 == 0, 0).alias("variable"), "line", F.col("receiver").alias("col"), (F.col("callee") % 3 > 0).alias("has_receiver"))
    return X.builder_transfers(rows, argument_rows(t.calls), rows)


@query("c23_array_transfers", oracle(ARGS + """SELECT cl.call AS source, 'ARGUMENT' AS from_role, ix AS from_index, CAST(cl.target AS VARCHAR) AS sink, 'PARAMETER' AS to_role, position AS to_index, 'array_varargs_bridge' AS kind
        FROM cl JOIN ar USING (call) JOIN pa ON pa.target = cl.target AND varargs AND ix >= position WHERE direct
    UNION SELECT i.input_id, 'CALL_RESULT', -1, e.effect_id, 'ARGUMENT', CAST(e.line % 3 AS INT), 'array_varargs_bridge' FROM inputs i JOIN effects e ON e.part = i.part AND e.supp = i.supp""", *CB))
def c23(t):
    array = F.concat_ws(":", F.col("part").cast("string"), F.col("supp").cast("string")).alias("array")
    into = t.inputs.select(array, F.col("input_id").alias("site"), F.lit("CALL_RESULT").alias("role"), F.lit(-1).alias("index"))
    out = t.effects.select(array, F.col("effect_id").alias("site"), F.lit("ARGUMENT").alias("role"), (F.col("line") % 3).alias("index"))
    return X.array_transfers(call_rows(t), argument_rows(t.calls), param_rows(t), into, out)


# -- value paths -----------------------------------------------------------------------------------

def value_edges(t):
    kind = F.when(F.col("kind") == "DIRECT_CALL", "static").otherwise("cha_poly_bridge")
    return t.calls.filter("callee < caller").select(F.col("caller").alias("src"), F.col("callee").alias("dst"), kind.alias("kind"), F.when(F.col("line") == 7, 9).otherwise(F.col("line")).alias("fanout"))


def value_ends(t):
    return t.methods.filter("status = 'F'").select(F.col("method").alias("node")), t.methods.filter("status = 'P'").select(F.col("method").alias("node"))


VALUE = """WITH RECURSIVE ed AS (SELECT caller AS src, callee AS dst, kind = 'DIRECT_CALL' AS st, CASE WHEN line = 7 THEN 9 ELSE line END AS fo FROM calls WHERE callee < caller),
    und AS (SELECT src AS a, dst AS b FROM ed WHERE st UNION SELECT dst, src FROM ed WHERE st), cc AS (SELECT DISTINCT a AS node, a AS lab FROM und UNION SELECT cc.node, b FROM cc JOIN und ON a = cc.lab),
    comp AS (SELECT node, min(lab) AS label FROM cc GROUP BY 1),
    u AS (SELECT src, dst, min(CASE WHEN st THEN 0 ELSE 1 END) AS weak FROM ed LEFT JOIN comp c1 ON c1.node = src LEFT JOIN comp c2 ON c2.node = dst JOIN methods ms ON ms.method = src JOIN methods md ON md.method = dst
        WHERE fo <= 8 AND (st OR (c1.label IS NULL OR c1.label IS DISTINCT FROM c2.label) AND (c1.label IS NOT NULL OR ms.status = 'F') AND (c2.label IS NOT NULL OR md.status = 'P')) GROUP BY 1, 2)
"""


@query("i05_usable_edges", oracle(VALUE + "SELECT src, dst, weak FROM u", "calls", "methods"))
def i05_edges(t):
    return X.usable_edges(value_edges(t), *value_ends(t))


@query("i05_value_paths", oracle("""WITH RECURSIVE u AS (SELECT caller AS src, callee AS dst, min(CASE WHEN kind = 'DIRECT_CALL' THEN 0 ELSE 1 END) AS weak FROM calls WHERE callee < caller GROUP BY 1, 2),
    p AS (SELECT method AS a, method AS z, [method] AS path, 0 AS weak FROM methods WHERE status = 'F' UNION ALL SELECT a, dst, list_append(path, dst), p.weak + u.weak FROM p JOIN u ON src = z WHERE len(path) <= 12)
    SELECT a AS start, z AS "end", array_to_string(path, '>') AS path, len(path) - 1 AS length, weak FROM p JOIN methods ON method = z AND status = 'P' WHERE len(path) > 1""", "calls", "methods"))
def i05(t):
    weak = F.min(F.when(F.col("kind") == "static", 0).otherwise(1)).alias("weak")
    edges = value_edges(t).groupBy("src", "dst").agg(weak)
    rows = X.value_paths(edges, *value_ends(t), 12)
    return rows.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query("i06_structural_meetings", oracle("""WITH l AS (SELECT DISTINCT input_id AS tip, i.method AS owner, package AS ty FROM inputs i JOIN methods m ON m.method = i.method), r AS (SELECT DISTINCT effect_id AS tip, e.method AS owner, package AS ty FROM effects e JOIN methods m ON m.method = e.method)
    SELECT l.tip AS "left", r.tip AS "right", CASE WHEN l.owner = r.owner THEN 'intra_method_hop' ELSE 'shared_class_hop' END AS kind FROM l JOIN r USING (ty)
    WHERE (l.owner, r.owner) NOT IN (SELECT (src, dst) FROM call_edges)""", "inputs", "effects", "methods", "call_edges"))
def i06(t):
    typed = lambda df, c: df.join(t.methods.select("method", F.col("package").alias("type")), "method").select(F.col(c).alias("tip"), F.col("method").alias("owner"), "type")
    left, right = typed(t.inputs, "input_id"), typed(t.effects, "effect_id")
    linked = left.join(t.call_edges, F.col("owner") == F.col("src")).select(F.col("tip").alias("a"), "dst").join(right.select(F.col("tip").alias("b"), F.col("owner").alias("dst")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return X.structural_meetings(left, right, linked)


@query("i06_meetings_omitted", oracle("""WITH r AS (SELECT DISTINCT effect_id AS tip, e.method AS owner, package AS ty FROM effects e JOIN methods m ON m.method = e.method)
    SELECT ty AS type, count(*) - 20 AS omitted FROM r GROUP BY 1 HAVING count(*) > 20""", "effects", "methods"))
def i06_omitted(t):
    right = t.effects.join(t.methods.select("method", F.col("package").alias("type")), "method").select(F.col("effect_id").alias("tip"), F.col("method").alias("owner"), "type")
    return X.meetings_omitted(right)


@query("i09_hierarchy_closure", oracle("""WITH RECURSIVE r AS (SELECT method AS seed, method AS node, 0 AS d FROM methods WHERE status = 'P' UNION SELECT seed, dst, d + 1 FROM r JOIN flow_edges ON src = node) SELECT seed, node, min(d) AS depth FROM r GROUP BY 1, 2""", "methods", "flow_edges"))
def i09(t):
    return G.reach(t.flow_edges, t.methods.filter("status = 'P'").select(F.col("method").alias("seed"), F.col("method").alias("node")))


@query("i11_fact_chains", oracle("""WITH RECURSIVE f AS (SELECT site_id AS id, caller AS src, callee AS dst FROM calls WHERE callee < caller AND line <= 2),
    p AS (SELECT dst AS tip, [id] AS chain FROM f WHERE src NOT IN (SELECT dst FROM f) UNION ALL SELECT dst, list_append(chain, id) FROM p JOIN f ON src = tip WHERE len(chain) < 24)
    SELECT array_to_string(chain, '>') AS chain, len(chain) AS length FROM p WHERE tip NOT IN (SELECT src FROM f)""", "calls"))
def i11(t):
    status = F.when(F.col("line") <= 2, "PENDING").otherwise("VERIFIER_REFUTED")
    facts = t.calls.filter("callee < caller").select(F.col("site_id").alias("edge_id"), F.col("caller").alias("src"), F.col("callee").alias("dst"), status.alias("status"))
    return X.fact_chains(facts, 24, None).withColumn("chain", F.array_join("chain", ">"))


@query("i11_acyclic_edges", """WITH RECURSIVE e AS (SELECT o_custkey AS c, substr(o_orderpriority, 1, 1) AS a, CAST(o_orderkey % 5 + 1 AS VARCHAR) AS b, o_orderkey AS seq,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    w AS (SELECT DISTINCT c, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS reach, '' AS a, '' AS b, CAST(0 AS BIGINT) AS seq, false AS kept FROM e
        UNION ALL SELECT c, n, CASE WHEN fine THEN list_distinct(list_concat(reach, flatten([[x || y for y in list_concat([b], [z[2] for z in reach if z[1] = b])] for x in list_concat([a], [z[1] for z in reach if z[2] = a])]))) ELSE reach END,
            a, b, seq, fine FROM (
            SELECT w.c, e.n, reach, e.a, e.b, e.seq, e.a <> e.b AND NOT list_contains(reach, e.b || e.a) AS fine FROM w JOIN e ON e.c = w.c AND e.n = w.n + 1))
    SELECT concat(c, ':', a) AS src, concat(c, ':', b) AS dst, seq, kept FROM w WHERE n > 0""")
def i11_acyclic(t):
    o = t.orders.select(F.col("o_custkey").alias("case_id"), F.substring("o_orderpriority", 1, 1).alias("src"), ((F.col("o_orderkey") % 5) + 1).cast("string").alias("dst"), F.col("o_orderkey").alias("seq"))
    kept, refused = R.acyclic_edges(o, case=["case_id"])
    both = kept.withColumn("kept", F.lit(True)).unionByName(refused.withColumn("kept", F.lit(False)))
    named = lambda c: F.concat_ws(":", F.col("case_id").cast("string"), c).alias(c)
    return both.select(named("src"), named("dst"), "seq", "kept")


@query("i12_backward_slices", oracle("""WITH s AS (SELECT package AS case_id, method, row_number() OVER (PARTITION BY package ORDER BY method) AS place FROM methods m JOIN effect_methods USING (method) QUALIFY place <= 3), l AS (SELECT src AS caller, dst AS callee FROM call_edges),
    n AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY callee ORDER BY caller) <= 3), f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY callee ORDER BY caller) <= 1)
    SELECT case_id, concat_ws('>', n.caller, s.method) AS methods FROM s JOIN n ON n.callee = s.method UNION ALL SELECT case_id, concat_ws('>', f.caller, n.caller, s.method) FROM s JOIN n ON n.callee = s.method JOIN f ON f.callee = n.caller AND f.caller <> s.method""", "methods", "effect_methods", "call_edges"))
def i12(t):
    sinks = t.methods.join(t.effect_methods, "method").select(F.col("package").alias("case_id"), F.col("method").alias("rank"), "method")
    rows = X.backward_slices(sinks, t.call_edges.select(F.col("src").alias("caller"), F.col("dst").alias("callee")))
    return rows.select("case_id", F.array_join(F.col("methods").cast("array<string>"), ">").alias("methods"))


@query("i12_slices_omitted", oracle("""WITH a AS (SELECT package AS case_id, method, row_number() OVER (PARTITION BY package ORDER BY method) AS place FROM methods m JOIN effect_methods USING (method))
    SELECT 'sinks' AS kind, CAST(case_id AS VARCHAR) AS key, count(*) - 3 AS omitted FROM a GROUP BY case_id HAVING count(*) > 3
    UNION ALL SELECT 'callers', CAST(dst AS VARCHAR), count(*) - 3 FROM call_edges WHERE dst IN (SELECT method FROM a WHERE place <= 3) GROUP BY dst HAVING count(*) > 3""", "methods", "effect_methods", "call_edges"))
def i12_omitted(t):
    sinks = t.methods.join(t.effect_methods, "method").select(F.col("package").alias("case_id"), F.col("method").alias("rank"), "method")
    return X.slices_omitted(sinks, t.call_edges.select(F.col("src").alias("caller"), F.col("dst").alias("callee")))


@query("i11_chains_omitted", oracle("""WITH RECURSIVE f AS (SELECT site_id AS id, caller AS src, callee AS dst FROM calls WHERE callee < caller AND line <= 2),
    p AS (SELECT dst AS tip, [id] AS chain FROM f WHERE src NOT IN (SELECT dst FROM f) UNION ALL SELECT dst, list_append(chain, id) FROM p JOIN f ON src = tip WHERE len(chain) < 24)
    SELECT count(*) AS chains, greatest(count(*) - 16, 0) AS omitted FROM p WHERE tip NOT IN (SELECT src FROM f)""", "calls"))
def i11_omitted(t):
    status = F.when(F.col("line") <= 2, "PENDING").otherwise("VERIFIER_REFUTED")
    facts = t.calls.filter("callee < caller").select(F.col("site_id").alias("edge_id"), F.col("caller").alias("src"), F.col("callee").alias("dst"), status.alias("status"))
    return X.chains_omitted(X.fact_chains(facts, 24, None))


@query("i14_link_steps", oracle("""WITH s AS (SELECT package AS chain, method, row_number() OVER (PARTITION BY package ORDER BY method) AS pos, method % 4 + 1 AS f, method % 4 + 4 AS l FROM methods), p AS (SELECT a.chain, a.pos, a.method AS le, b.method AS ri, a.f, a.l, b.f AS rf, b.l AS rl FROM s a JOIN s b ON b.chain = a.chain AND b.pos = a.pos + 1),
    tr AS (SELECT DISTINCT i.method AS le, e.method AS ri, CASE WHEN i.part % 2 = 0 THEN 'static' ELSE 'cha_poly_bridge' END AS k, i.line AS ll, e.line AS rr FROM inputs i JOIN effects e ON i.part = e.part JOIN methods a ON a.method = i.method JOIN methods b ON b.method = e.method AND a.package = b.package),
    mv AS (SELECT p.chain, p.pos, min(CASE WHEN k = 'static' THEN 'static_value_hop' ELSE k END) AS v FROM p JOIN tr USING (le, ri) WHERE ll BETWEEN f AND l AND rr BETWEEN rf AND rl GROUP BY 1, 2),
    fd AS (SELECT DISTINCT si.method, package AS ty, part AS fld FROM sites si JOIN methods m ON m.method = si.method),
    sh AS (SELECT DISTINCT p.chain, p.pos FROM p JOIN fd a ON a.method = le JOIN fd b ON b.method = ri AND a.ty = b.ty AND a.fld = b.fld),
    cr AS (SELECT DISTINCT caller AS le, callee AS ri, line AS ll FROM calls), rl AS (SELECT DISTINCT p.chain, p.pos FROM p JOIN cr USING (le, ri) WHERE ll BETWEEN f AND l)
    SELECT p.chain AS chain_id, p.pos, le AS "left", ri AS "right", coalesce(v, CASE WHEN rl.chain IS NOT NULL THEN 'call_argument_hop' END, CASE WHEN sh.chain IS NOT NULL THEN 'field_state_bridge' END) AS kind
    FROM p LEFT JOIN mv USING (chain, pos) LEFT JOIN sh USING (chain, pos) LEFT JOIN rl USING (chain, pos)""", *CB))
def i14(t):
    from pyspark.sql import Window as W

    order = W.partitionBy("package").orderBy("method")
    m = F.col("method")
    steps = t.methods.select(F.col("package").alias("chain_id"), F.row_number().over(order).alias("pos"), "method", (m % 4 + 1).alias("first"), (m % 4 + 4).alias("last"))
    pk = t.methods.select("method", "package")
    i = t.inputs.join(pk, "method").select(F.col("method").alias("left"), "part", "package", F.col("line").alias("l_line"))
    e = t.effects.join(pk, "method").select(F.col("method").alias("right"), "part", "package", F.col("line").alias("r_line"))
    transfers = i.join(e, ["part", "package"]).select("left", "right", F.when(F.col("part") % 2 == 0, "static").otherwise("cha_poly_bridge").alias("kind"), "l_line", "r_line").distinct()
    relations = t.calls.select(F.col("caller").alias("left"), F.col("callee").alias("right"), F.lit("CALL").alias("kind"), F.col("line").alias("l_line"), F.lit(1).alias("r_line")).distinct()
    fields = t.sites.join(pk, "method").select("method", F.col("package").alias("type_name"), F.col("part").alias("field"))
    return X.link_steps(steps, transfers, relations, fields)


# -- symbols and types -----------------------------------------------------------------------------

@query("c10_map_entities", """WITH e AS (SELECT p_partkey AS id, p_size % 3 + 1 AS s, p_size % 3 + 4 AS e, CASE WHEN p_size > 25 THEN 'CALL' ELSE 'FIELD_READ' END AS kind, p_brand AS q, p_type AS sg FROM part),
    f AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fid, l_partkey AS file, l_linenumber AS s, l_linenumber + 1 AS e, CASE l_returnflag WHEN 'R' THEN 'CALL' WHEN 'A' THEN 'FIELD_ACCESS' ELSE 'FIELD_READ' END AS kind, concat('Brand#', l_suppkey % 25 + 1) AS q, CASE WHEN l_quantity > 30 THEN 'PROMO' ELSE 'SMALL' END AS sg FROM lineitem),
    h AS (SELECT id, fid, e.q = f.q AS fq, e.sg = f.sg AS fs FROM e JOIN f ON file = id AND f.s <= e.e AND e.s <= f.e AND (f.kind = e.kind OR (e.kind = 'FIELD_READ' AND f.kind = 'FIELD_ACCESS'))),
    a AS (SELECT *, bool_or(fq) OVER (PARTITION BY id) AS aq FROM h), b AS (SELECT * FROM a WHERE fq OR NOT aq), c AS (SELECT *, bool_or(fs) OVER (PARTITION BY id) AS as_ FROM b), d AS (SELECT * FROM c WHERE fs OR NOT as_),
    g AS (SELECT id, count(*) AS n, min(fid) AS one, max(3 + CAST(aq AS INT) + CAST(as_ AS INT)) AS pr FROM d GROUP BY 1)
    SELECT e.id AS entity_id, coalesce(n, 0) AS candidate_count, CASE WHEN n IS NULL THEN 'NOT_MAPPED' WHEN n > 1 THEN 'MAPPED_AMBIGUOUS' ELSE 'MAPPED_UNIQUE' END AS status, CASE WHEN n = 1 THEN one END AS fact_id,
        CASE WHEN n IS NULL THEN 'NONE' WHEN n > 1 THEN 'AMBIGUOUS' WHEN pr >= 4 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM e LEFT JOIN g ON g.id = e.id""")
def c10(t):
    none = F.lit(None).cast("string")
    size = F.col("p_size") % 3
    entities = t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_partkey").alias("file"), (size + 1).alias("start"), (size + 4).alias("end"), F.when(F.col("p_size") > 25, "CALL").otherwise("FIELD_READ").alias("kind"),
                             F.col("p_brand").alias("qualified_name"), F.col("p_type").alias("signature"), none.alias("enclosing_type"), none.alias("enclosing_callable"))
    kind = F.when(F.col("l_returnflag") == "R", "CALL").when(F.col("l_returnflag") == "A", "FIELD_ACCESS").otherwise("FIELD_READ")
    line = F.col("l_linenumber")
    facts = t.lineitem.select(
        F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("fact_id"), F.col("l_partkey").alias("file"), line.alias("f_start"), (line + 1).alias("f_end"), kind.alias("f_kind"),
        F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string")).alias("f_qualified_name"), F.when(F.col("l_quantity") > 30, "PROMO").otherwise("SMALL").alias("f_signature"), none.alias("f_enclosing_type"), none.alias("f_enclosing_callable"))
    return Y.map_entities(entities, facts)


@query("c32_resolve_symbols", """WITH m AS (SELECT o_orderkey AS id, concat('com.C', o_custkey) AS ty, concat('m', o_orderpriority[1]) AS name, CASE o_orderstatus WHEN 'F' THEN '(int)' WHEN 'O' THEN '(java.util.List<String>)' ELSE '()' END AS sg, o_totalprice > 300000 AS pv FROM orders),
    pr AS (SELECT c_custkey AS c, concat('com.C', c_custkey) AS ty, concat('com.C', c_custkey - 1) AS pa FROM customer WHERE c_custkey > 0 AND c_mktsegment = 'FURNITURE'),
    q AS (SELECT c_custkey AS id, concat('com.C', c_custkey) AS ty, CASE WHEN c_nationkey < 12 THEN '(int)' WHEN c_nationkey < 20 THEN '(List)' END AS sg FROM customer),
    cl AS (WITH RECURSIVE r AS (SELECT id, ty AS node, 0 AS d FROM q UNION ALL SELECT r.id, pa, d + 1 FROM r JOIN pr ON pr.ty = r.node) SELECT * FROM r),
    h AS (SELECT q.id, m.id AS mid, m.sg, d, q.sg IS NULL OR q.sg = m.sg AS ex, q.sg IS NULL OR q.sg = m.sg OR (q.sg = '(List)' AND m.sg LIKE '%List%') AS lo FROM q JOIN cl ON cl.id = q.id JOIN m ON m.ty = cl.node AND m.name = 'm1' WHERE d = 0 OR NOT pv),
    k AS (SELECT * FROM (SELECT *, bool_or(ex) OVER (PARTITION BY id) AS anyx FROM h) WHERE CASE WHEN anyx THEN ex ELSE lo END)
    SELECT id AS query_id, mid AS method_id FROM k WHERE d = 0 OR (id, sg) NOT IN (SELECT (id, sg) FROM k WHERE d = 0)""")
def c32(t):
    c = lambda col: F.concat(F.lit("com.C"), col.cast("string"))
    signature = F.when(F.col("o_orderstatus") == "F", "(int)").when(F.col("o_orderstatus") == "O", "(java.util.List<String>)").otherwise("()")
    name = F.concat(F.lit("m"), F.substring("o_orderpriority", 1, 1))
    methods = t.orders.select(F.col("o_orderkey").alias("method_id"), c(F.col("o_custkey")).alias("type_name"), name.alias("name"), F.concat(name, signature).alias("signature"), (F.col("o_totalprice") > 300000).alias("private"))
    parents = t.customer.filter("c_custkey > 0 AND c_mktsegment = 'FURNITURE'").select(c(F.col("c_custkey")).alias("type_name"), F.concat(F.lit("C"), (F.col("c_custkey") - 1).cast("string"), F.lit("<T>")).alias("parent"))
    wanted = F.when(F.col("c_nationkey") < 12, "( int )").when(F.col("c_nationkey") < 20, "(List)").otherwise("")
    queries = t.customer.select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit("#m1"), wanted).alias("symbol"))
    return Y.resolve_symbols(queries, methods, parents)


def type_links(t):
    return t.customer.filter("c_mktsegment IN ('FURNITURE', 'MACHINERY') AND c_custkey > 0").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") - 1).alias("dst"))


@query("c33_type_family", """WITH l AS (SELECT c_custkey AS k, c_custkey > 0 AND c_mktsegment IN ('FURNITURE', 'MACHINERY') AS up FROM customer), g AS (SELECT k, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (ORDER BY k) AS grp FROM l),
    f AS (SELECT k, min(k) OVER (PARTITION BY grp) AS label, count(*) OVER (PARTITION BY grp) AS n FROM g) SELECT k AS node, label FROM f WHERE n > 1""")
def c33(t):
    return Y.type_family(type_links(t))


@query("c33_visible_types", """WITH RECURSIVE pa AS (SELECT c_custkey AS t, c_custkey - 1 AS p FROM customer WHERE c_custkey > 0 AND c_mktsegment = 'FURNITURE'), ou AS (SELECT c_custkey AS t, c_custkey - 2 AS p FROM customer WHERE c_custkey > 1 AND c_mktsegment = 'MACHINERY'),
    sh AS (SELECT c_custkey AS seed, c_custkey AS node, 0 AS d FROM customer UNION ALL SELECT seed, p, d + 1 FROM sh JOIN ou ON t = node), up AS (SELECT seed, node AS shell, node, d AS shells, 0 AS ups FROM sh UNION ALL SELECT seed, shell, p, shells, ups + 1 FROM up JOIN pa ON t = node)
    SELECT seed, node, min((shells, ups))[1] AS shells, min((shells, ups))[2] AS ups FROM up GROUP BY 1, 2""")
def c33_visible(t):
    c = t.customer
    parents = c.filter("c_custkey > 0 AND c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("type_name"), (F.col("c_custkey") - 1).alias("parent"))
    outer = c.filter("c_custkey > 1 AND c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("type_name"), (F.col("c_custkey") - 2).alias("outer"))
    return Y.visible_types(c.select(F.col("c_custkey").alias("type_name")), parents, outer)


@query("c34_state_query", """WITH l AS (SELECT c_custkey AS k, c_custkey > 0 AND c_mktsegment IN ('FURNITURE', 'MACHINERY') AS up FROM customer), g AS (SELECT k, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (ORDER BY k) AS grp FROM l), f AS (SELECT k, min(k) OVER (PARTITION BY grp) AS label, count(*) OVER (PARTITION BY grp) AS n FROM g),
    fam AS (SELECT k, label FROM f WHERE n > 1), q AS (SELECT c_custkey AS id, concat('f', c_nationkey % 5) AS sym, CASE WHEN c_acctbal > 5000 THEN 'READ' WHEN c_acctbal > 2000 THEN 'WRITE' END AS acc, label FROM customer JOIN fam ON k = c_custkey),
    a AS (SELECT concat('f', l_linenumber % 5) AS sym, label, l_orderkey AS mid, l_partkey AS file, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 'READ' ELSE 'WRITE' END AS acc FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN fam ON k = o_custkey),
    m AS (SELECT concat('f', o_orderpriority[1]) AS sym, label, o_orderkey AS mid, -1 AS file, 0 AS line FROM orders JOIN fam ON k = o_custkey),
    h AS (SELECT DISTINCT q.id, 'FIELD_STATE' AS kind, mid, file, line FROM q JOIN a ON a.sym = q.sym AND a.label = q.label AND (q.acc IS NULL OR q.acc = a.acc) UNION SELECT q.id, 'SCOPED_DISPATCH', mid, file, line FROM q JOIN m ON m.sym = q.sym AND m.label = q.label),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind, file, line, mid) AS rank, count(*) OVER (PARTITION BY id) AS total FROM h) SELECT id AS query_id, kind, mid AS method_id, file, line, rank, greatest(total - 8, 0) AS omitted FROM r WHERE rank <= 8""")
def c34(t):
    direction = F.when(F.col("c_acctbal") > 5000, "forward").when(F.col("c_acctbal") > 2000, "backward").otherwise("both")
    queries = t.customer.select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("f"), (F.col("c_nationkey") % 5).cast("string")).alias("symbol"), F.col("c_custkey").alias("type_name"), direction.alias("direction"))
    owner = t.orders.select("o_orderkey", "o_custkey")
    accesses = t.lineitem.join(owner, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("f"), (F.col("l_linenumber") % 5).cast("string")).alias("field"), F.col("o_custkey").alias("type_name"), F.col("l_orderkey").alias("method_id"), F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") == "R", "READ").otherwise("WRITE").alias("access"))
    methods = t.orders.select(F.col("o_orderkey").alias("method_id"), F.concat(F.lit("f"), F.substring("o_orderpriority", 1, 1)).alias("name"), F.col("o_custkey").alias("type_name"), F.lit(-1).cast("long").alias("file"), F.lit(0).alias("line"))
    return Y.state_query(queries, accesses, methods, Y.type_family(type_links(t)), 8).select("query_id", "kind", "method_id", "file", "line", "rank", "omitted")


REFS = """WITH r AS (SELECT DISTINCT page_id, lower(x) AS word FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"/]+)"', 1)) AS x FROM pages)), w AS (SELECT DISTINCT lower(u) AS word, item_id FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\\s.,;:!?]+')) AS u FROM benchmark)),
    n AS (SELECT word, count(*) AS n, min(item_id) AS one FROM w GROUP BY 1)
""".replace("\\\\", "\\")


@query("c37_resolve_references", REFS + "SELECT concat(page_id, '|', r.word) AS ref_id, CASE WHEN n = 1 THEN one END AS target, CASE WHEN n IS NULL THEN 'absent' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM r LEFT JOIN n ON n.word = r.word")
def c37(t):
    word = F.explode(F.regexp_extract_all("html", F.lit(r'href="/([^"/]+)"'), F.lit(1))).alias("raw")
    refs = t.pages.select("page_id", word).select("page_id", F.lower("raw").alias("word")).distinct().select(F.concat_ws("|", F.col("page_id").cast("string"), "word").alias("ref_id"), F.array("word").alias("names"))
    targets = t.benchmark.select(F.col("item_id").alias("target"), F.explode(F.regexp_extract_all("text", F.lit(r"[^\s.,;:!?]+"), F.lit(0))).alias("raw")).select(F.lower("raw").alias("name"), "target")
    return Y.resolve_references(refs, targets)


@query("c37_view_scripts", """SELECT p_partkey AS ref_id, CASE WHEN p_size % 4 = 3 THEN NULL WHEN p_type = 'PROMO' THEN NULL ELSE concat('base/templates/v', p_partkey, CASE WHEN p_size % 4 = 0 THEN '.ftl' ELSE '.jsp' END) END AS target,
    CASE WHEN p_size % 4 = 3 THEN 'absent' WHEN p_type = 'PROMO' THEN 'ambiguous' ELSE 'resolved' END AS status FROM part""")
def c37_views(t):
    k = F.col("p_partkey").cast("string")
    literal = F.when(F.col("p_size") % 4 == 3, F.concat(F.lit("../v"), k)).otherwise(F.concat(F.lit("v"), k))
    refs = t.part.select(F.col("p_partkey").alias("ref_id"), Y.view_names(F.lit("base"), literal).alias("names"))
    path = F.concat(F.lit("base/templates/v"), k, F.when(F.col("p_size") % 4 == 0, ".ftl").otherwise(".jsp"))
    targets = t.part.select(path.alias("name"), path.alias("target"))
    twice = t.part.filter("p_type = 'PROMO'").select(F.concat(F.lit("base/templates/v"), k, F.lit(".html")).alias("name")).select("name", F.col("name").alias("target"))
    return Y.resolve_references(refs, targets.unionByName(twice))


@query("c37_page_scripts", """SELECT p_partkey AS ref_id, CASE WHEN p_size % 4 = 3 THEN NULL WHEN p_size % 4 = 1 THEN concat('base/web/a', p_partkey, '.js') WHEN p_type = 'PROMO' THEN NULL ELSE concat('base/static/js/a', p_partkey, '.js') END AS target,
    CASE WHEN p_size % 4 = 3 THEN 'absent' WHEN p_size % 4 <> 1 AND p_type = 'PROMO' THEN 'ambiguous' ELSE 'resolved' END AS status FROM part""")
def c37_scripts(t):
    k, case = F.col("p_partkey").cast("string"), F.col("p_size") % 4
    file = F.concat(F.lit("a"), k, F.lit(".js"))
    src = F.when(case == 0, F.concat(F.lit("/js/"), file)).when(case == 1, file).when(case == 2, F.concat(F.lit("${request.contextPath}/js/"), file)).otherwise(F.concat(F.lit("../"), file))
    refs = t.part.select(F.col("p_partkey").alias("ref_id"), Y.script_names(F.lit("base"), F.lit("base/web/page.html"), src).alias("names"))
    held = lambda folder, rows: rows.select(F.concat(F.lit(folder), file).alias("name")).select("name", F.col("name").alias("target"))
    targets = held("base/static/js/", t.part).unionByName(held("base/web/", t.part)).unionByName(held("base/public/js/", t.part.filter("p_type = 'PROMO'")))
    return Y.resolve_references(refs, targets)


@query("c38_web_surfaces", """WITH m AS (SELECT o_orderkey AS id, o_custkey AS ty FROM orders WHERE o_orderstatus = 'F'), pe AS (SELECT l_orderkey AS id, array_to_string(list_sort(list(DISTINCT concat('Repo', l_suppkey, '.save'))), ',') AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN
        (SELECT DISTINCT o_custkey AS ty, l_suppkey AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R') f ON f.ty = o_custkey AND f.s = l_suppkey GROUP BY 1),
    mp AS (SELECT o_custkey AS ty, array_to_string(list_sort(list(DISTINCT concat('map/', l_suppkey, '.xml'))), ',') AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 5000 WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT m.id AS method_id, concat('Form a', m.id, ',int b') AS parameters, coalesce(p, '') AS persistence, coalesce(f, '') AS mapper_files, CASE WHEN c_mktsegment = 'FURNITURE' THEN concat('view', ty, '.ftl') ELSE '' END AS views
    FROM m LEFT JOIN pe ON pe.id = m.id LEFT JOIN mp USING (ty) JOIN customer ON c_custkey = ty""")
def c38(t):
    s = lambda c: F.col(c).cast("string")
    o = t.orders
    methods = o.select(F.col("o_orderkey").alias("method_id"), F.col("o_custkey").alias("type_name"), F.when(F.col("o_orderstatus") == "F", "@PostMapping(path)").otherwise("@Override").alias("annotation"))
    params = o.select(F.col("o_orderkey").alias("method_id"), F.lit(1).alias("position"), F.lit("b").alias("name"), F.lit("int").alias("type")).unionByName(
        o.select(F.col("o_orderkey").alias("method_id"), F.lit(0).alias("position"), F.concat(F.lit("a"), s("o_orderkey")).alias("name"), F.lit("Form").alias("type")))
    calls = t.lineitem.select(F.col("l_orderkey").alias("method_id"), F.concat(F.when(F.col("l_linenumber") > 3, "this.").otherwise(""), F.lit("r"), s("l_suppkey")).alias("receiver"), F.lit("save").alias("name"), F.col("l_linenumber").alias("line"))
    fields = t.lineitem.filter("l_returnflag = 'R'").join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("type_name"), F.concat(F.lit("r"), s("l_suppkey")).alias("name"), F.concat(F.lit("Repo"), s("l_suppkey")).alias("type")).distinct()
    mappers = t.supplier.filter("s_acctbal > 5000").select(F.concat(F.lit("Repo"), s("s_suppkey")).alias("namespace"), F.concat(F.lit("map/"), s("s_suppkey"), F.lit(".xml")).alias("file"))
    views = t.customer.filter("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("type_name"), F.concat(F.lit("view"), s("c_custkey"), F.lit(".ftl")).alias("file"))
    return Y.web_surfaces(methods, params, calls, fields, mappers, views)
