"""Value transfers between ports, value paths over them, and the searches built on those."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.graph import _union, components
from pathloom.operators.skew import left_out, top_k
from pathloom.session import cut_lineage

PORTS = ("source", "from_role", "from_index", "sink", "to_role", "to_index")


def _rows(df: DataFrame, source: str, from_role, from_index, sink: str, to_role, to_index, kind: str) -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        F.col(source).cast("string").alias("source"), col(from_role).alias("from_role"), col(from_index).cast("int").alias("from_index"),
        F.col(sink).cast("string").alias("sink"), col(to_role).alias("to_role"), col(to_index).cast("int").alias("to_index"), F.lit(kind).alias("kind"))


def static_transfers(inputs: DataFrame, outputs: DataFrame, flow: DataFrame, calls: DataFrame, arguments: DataFrame, params: DataFrame, param_returns: DataFrame, returns: DataFrame) -> DataFrame:
    """Transfers proved inside a callable or across one direct call.

    ``inputs(owner, site, role, index, node)`` and ``outputs`` alike; ``flow(src, dst)`` is local reachability;
    ``calls(call, target, direct)``; ``arguments(call, index, constant)``; ``params(target, position, varargs)``;
    ``param_returns(target, position)`` where a parameter reaches a return; ``returns(target)``.
    """
    i = inputs.select("owner", F.col("site").alias("i_site"), F.col("role").alias("i_role"), F.col("index").alias("i_index"), F.col("node").alias("src"))
    o = outputs.select("owner", F.col("site").alias("o_site"), F.col("role").alias("o_role"), F.col("index").alias("o_index"), F.col("node").alias("dst"))
    inside = flow.select("src", "dst").distinct().join(i, "src").join(o, ["owner", "dst"])
    direct = calls.filter("direct").select("call", "target")
    given = arguments.filter("NOT constant").select("call", "index")
    passed = direct.join(given, "call")
    through = passed.join(param_returns.select("target", F.col("position").alias("index")).distinct(), ["target", "index"])
    bound = passed.join(params.filter("NOT varargs").select("target", F.col("position").alias("index")), ["target", "index"])
    back = direct.join(returns.select("target").distinct(), "target")
    return (
        _rows(inside, "i_site", F.col("i_role"), F.col("i_index"), "o_site", F.col("o_role"), F.col("o_index"), "static")
        .unionByName(_rows(through, "call", "ARGUMENT", F.col("index"), "call", "CALL_RESULT", -1, "static"))
        .unionByName(_rows(bound, "call", "ARGUMENT", F.col("index"), "target", "PARAMETER", F.col("index"), "static"))
        .unionByName(_rows(back, "target", "RETURN", -1, "call", "CALL_RESULT", -1, "static")).distinct())


def closure_transfers(allocations: DataFrame, arguments: DataFrame, callbacks: DataFrame, captures: DataFrame, field_outputs: DataFrame) -> DataFrame:
    """A constructor argument to the receiver of each callback of the object, and to what a callback does with the field that holds it.

    ``allocations(call, ctor, type)``, ``callbacks(type, method)``, ``captures(ctor, position, field)``,
    ``field_outputs(field, method, site, role, index)``.

    Arguments are told apart before callbacks multiply them: a callback of one type meets each argument once, so only
    callbacks of several types, those that are also an output, and outputs are told apart afterwards.
    """
    kind = "closure_object_bridge"
    given = allocations.join(arguments.filter("NOT constant").select("call", "index"), "call")
    made = given.select(F.col("call").cast("string").alias("call"), F.col("index").cast("int").alias("index"), "type").distinct()
    hooks = callbacks.filter("type IS NOT NULL").select("type", F.col("method").cast("string").alias("sink"))
    ports = field_outputs.filter("role = 'RECEIVER' AND index = -1").select(F.lit(None).cast(hooks.schema["type"].dataType).alias("type"), F.col("site").cast("string").alias("sink"))
    known = hooks.withColumn("port", F.lit(False)).unionByName(ports.withColumn("port", F.lit(True))).groupBy("sink").agg(
        F.min("type").alias("type"), F.max("type").alias("last"), F.max("port").alias("port"))
    once = (F.col("type") == F.col("last")) & ~F.col("port")
    sole = known.filter(once).select("type", "sink")
    several = known.filter(~once).select(F.col("sink").alias("__sink"))
    shared = hooks.join(several, F.col("sink").eqNullSafe(F.col("__sink")), "left_semi")
    bridges = callbacks.select("type", "method").join(
        field_outputs.select("field", "method", "site", F.col("role").alias("o_role"), F.col("index").alias("o_index")), "method").drop("method")
    held = given.join(captures.select("ctor", F.col("position").alias("index"), "field"), ["ctor", "index"]).join(bridges, ["type", "field"])
    receivers = lambda hooks: _rows(made.join(hooks, "type"), "call", "ARGUMENT", F.col("index"), "sink", "RECEIVER", -1, kind)
    return receivers(sole).unionByName(receivers(shared).unionByName(
        _rows(held, "call", "ARGUMENT", F.col("index"), "site", F.col("o_role"), F.col("o_index"), kind)).distinct())


def builder_transfers(updates: DataFrame, arguments: DataFrame, uses: DataFrame) -> DataFrame:
    """An argument of a fluent update to its result, its receiver, and the receivers of later calls on the same variable.

    ``updates(call, method, variable, line, col, has_receiver)``, ``uses(call, method, variable, line, col)``.
    """
    given = updates.join(arguments.filter("NOT constant").select("call", "index"), "call")
    u = uses.select(F.col("call").alias("use"), "method", "variable", F.col("line").alias("u_line"), F.col("col").alias("u_col"))
    later = given.filter("variable IS NOT NULL").join(u, ["method", "variable"]).filter(
        (F.col("use") != F.col("call")) & ((F.col("line") < F.col("u_line")) | ((F.col("line") == F.col("u_line")) & (F.col("col") < F.col("u_col")))))
    kind = "builder_receiver_bridge"
    return (
        _rows(given, "call", "ARGUMENT", F.col("index"), "call", "CALL_RESULT", -1, kind)
        .unionByName(_rows(given.filter("has_receiver"), "call", "ARGUMENT", F.col("index"), "call", "CALL_RECEIVER", -1, kind))
        .unionByName(_rows(later, "call", "ARGUMENT", F.col("index"), "use", "CALL_RECEIVER", -1, kind)).distinct())


def array_transfers(calls: DataFrame, arguments: DataFrame, params: DataFrame, into: DataFrame, out: DataFrame) -> DataFrame:
    """Arguments collected by a varargs parameter, and values that pass through an array.

    ``into(array, site, role, index)`` are inputs that reach an array, ``out(array, site, role, index)`` outputs it reaches.
    """
    varargs = params.filter("varargs").select("target", "position")
    packed = calls.filter("direct").join(arguments.filter("NOT constant").select("call", "index"), "call").join(varargs, "target").filter("index >= position")
    i = into.select("array", F.col("site").alias("i_site"), F.col("role").alias("i_role"), F.col("index").alias("i_index"))
    o = out.select("array", F.col("site").alias("o_site"), F.col("role").alias("o_role"), F.col("index").alias("o_index"))
    kind = "array_varargs_bridge"
    return _rows(packed, "call", "ARGUMENT", F.col("index"), "target", "PARAMETER", F.col("position"), kind).unionByName(
        _rows(i.join(o, "array"), "i_site", F.col("i_role"), F.col("i_index"), "o_site", F.col("o_role"), F.col("o_index"), kind)).distinct()


def _grow(edges: DataFrame, roots: DataFrame, depth: int, forward: bool, per_node: int | None, order: Sequence[Column]) -> list[DataFrame]:
    """Simple paths of each length from the roots, outwards or backwards; optionally the first few per end node."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    steps = edges.select(F.col(a).alias("at"), F.col(b).alias("to"), "weak")
    level = cut_lineage(roots.select(F.col("node").alias("tip")).distinct().select("tip", F.array("tip").alias("path"), F.lit(0).alias("weak")))
    levels = [level]
    for _ in range(depth):
        grown = level.join(steps.withColumnRenamed("weak", "__w"), F.col("tip") == F.col("at")).filter(~F.array_contains("path", F.col("to"))).select(
            F.col("to").alias("tip"), (F.concat("path", F.array("to")) if forward else F.concat(F.array("to"), F.col("path"))).alias("path"), (F.col("weak") + F.col("__w")).alias("weak"))
        if per_node is not None:
            grown = top_k(grown, ["tip"], list(order), per_node).drop("rank")
        level = cut_lineage(grown)
        levels.append(level)
        if level.isEmpty():
            break
    return levels


def usable_edges(edges: DataFrame, starts: DataFrame, ends: DataFrame, limit: int = 8) -> DataFrame:
    """Transfer edges a value path may take: no background fan-out, and relaxed ones only between static components.

    ``edges(src, dst, kind, fanout)``. A relaxed edge must leave a static component or a start, and enter another
    component or an end.
    """
    edges = cut_lineage(edges)
    part = components(edges.filter("kind = 'static'"))
    c = lambda side: part.select(F.col("node").alias(side), F.col("label").alias(f"{side}_part"))
    mark = lambda df, side, name: df.select(F.col("node").alias(side)).distinct().withColumn(name, F.lit(True))
    j = (
        edges.filter(F.col("fanout") <= limit).join(c("src"), "src", "left").join(c("dst"), "dst", "left")
        .join(mark(starts, "src", "__s"), "src", "left").join(mark(ends, "dst", "__e"), "dst", "left"))
    fits = (
        ~F.equal_null("src_part", "dst_part") | F.col("src_part").isNull()
    ) & (F.col("src_part").isNotNull() | F.col("__s").isNotNull()) & (F.col("dst_part").isNotNull() | F.col("__e").isNotNull())
    weak = (F.col("kind") != "static").cast("int")
    return j.filter((F.col("kind") == "static") | fits).groupBy("src", "dst").agg(F.min(weak).alias("weak"))


def value_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_edges: int = 12, per_node: int | None = None) -> DataFrame:
    """Simple paths of at most ``max_edges`` from a start to an end, grown from both sides and met in the middle.

    A path of n edges is split once, after its first ceil(n / 2): every path is found exactly one time, and neither
    side grows beyond half the limit. ``edges(src, dst, weak)``. ``per_node`` keeps the best prefixes per node, as a search bound.
    """
    half = (max_edges + 1) // 2
    edges = cut_lineage(edges)
    order = [F.col("weak"), F.col("path")]
    ahead = _grow(edges, starts, half, True, per_node, order)
    behind = _grow(edges, ends, max_edges - half, False, per_node, order)
    found = []
    for a, left in enumerate(ahead):
        for b in (a, a - 1):
            if 1 <= a and 0 <= b < len(behind) and a + b <= max_edges:
                right = behind[b].select(F.col("tip"), F.col("path").alias("tail"), F.col("weak").alias("weak_tail"))
                met = left.join(right, "tip").withColumn("rest", F.slice("tail", 2, F.greatest(F.size("tail") - 1, F.lit(0)))).filter(~F.arrays_overlap("path", "rest"))
                found.append(met.select(F.concat("path", "rest").alias("path"), (F.col("weak") + F.col("weak_tail")).alias("weak")))
    out = _union(found).withColumn("start", F.col("path")[0]).withColumn("end", F.element_at("path", -1))
    return out.select("start", "end", "path", (F.size("path") - 1).alias("length"), "weak").distinct()


def structural_meetings(prefixes: DataFrame, suffixes: DataFrame, edges: DataFrame, per_type: int | None = None) -> DataFrame:
    """Explored prefix ends beside suffix starts of one enclosing type, not already joined by an edge.

    ``prefixes(tip, owner, type)`` and ``suffixes`` alike. All suffixes of a type meet a prefix; with ``per_type`` only so many, as a search bound.
    """
    right = suffixes.select(F.col("tip").alias("right"), F.col("owner").alias("right_owner"), "type").distinct()
    if per_type is not None:
        right = top_k(right, ["type"], [F.col("right")], per_type).drop("rank")
    left = prefixes.select(F.col("tip").alias("left"), F.col("owner").alias("left_owner"), "type").distinct()
    # What a prefix may not meet, the suffixes its own edges lead to, is told to it beforehand, so that pairs are not dealt again.
    linked = edges.select(F.col("src").alias("left"), F.col("dst").alias("right")).join(right.select("right", "type").distinct(), "right")
    linked = linked.groupBy("left", "type").agg(F.collect_set("right").alias("linked"))
    met = left.join(linked, ["left", "type"], "left").join(right, "type").filter((F.col("left") != F.col("right")) & ~F.coalesce(F.array_contains("linked", F.col("right")), F.lit(False)))
    return met.select("left", "right", F.when(F.col("left_owner") == F.col("right_owner"), "intra_method_hop").otherwise("shared_class_hop").alias("kind"))


def meetings_omitted(suffixes: DataFrame, per_type: int = 20) -> DataFrame:
    """``type, omitted``: suffixes that :func:`structural_meetings` leaves out under such a bound."""
    return left_out(suffixes.select("tip", "owner", "type").distinct(), ["type"], per_type)


def backward_slices(sinks: DataFrame, callers: DataFrame, n_sinks: int = 3, n_callers: int = 3, n_parents: int = 1) -> DataFrame:
    """Short call chains into the first sinks of each case: ``sinks(case_id, rank, method)``, ``callers(caller, callee)``."""
    s = top_k(sinks, ["case_id"], [F.col("rank"), F.col("method")], n_sinks, rank="place").select("case_id", F.col("method").alias("owner"), "place")
    links = callers.select("caller", "callee").distinct()
    near = top_k(links.join(s.select(F.col("owner").alias("callee")).distinct(), "callee", "left_semi"), ["callee"], [F.col("caller")], n_callers).drop("rank")
    one = s.join(near.select(F.col("callee").alias("owner"), "caller"), "owner")
    above = top_k(links.join(near.select(F.col("caller").alias("callee")).distinct(), "callee", "left_semi"), ["callee"], [F.col("caller")], n_parents).drop("rank")
    two = one.join(above.select(F.col("callee").alias("caller"), F.col("caller").alias("parent")), "caller").filter("parent <> owner")
    short = one.select("case_id", F.array("caller", "owner").alias("methods"))
    return short.unionByName(two.select("case_id", F.array("parent", "caller", "owner").alias("methods")))


def slices_omitted(sinks: DataFrame, callers: DataFrame, n_sinks: int = 3, n_callers: int = 3) -> DataFrame:
    """``kind, key, omitted``: sinks of a case, and callers of a chosen sink, that :func:`backward_slices` leaves out."""
    text = lambda c: F.col(c).cast("string").alias("key")
    chosen = top_k(sinks, ["case_id"], [F.col("rank"), F.col("method")], n_sinks).select(F.col("method").alias("callee")).distinct()
    near = callers.select("caller", "callee").distinct().join(chosen, "callee", "left_semi")
    return left_out(sinks, ["case_id"], n_sinks).select(F.lit("sinks").alias("kind"), text("case_id"), "omitted").unionByName(
        left_out(near, ["callee"], n_callers).select(F.lit("callers").alias("kind"), text("callee"), "omitted"))


def link_steps(steps: DataFrame, transfers: DataFrame, relations: DataFrame, fields: DataFrame) -> DataFrame:
    """The first relation kind that links each step of a chain to the next; NULL when none does.

    ``steps(chain_id, pos, method, first, last)``; ``transfers(left, right, kind, l_line, r_line)``;
    ``relations(left, right, kind, l_line, r_line)``; ``fields(method, type_name, field)`` for the fields a method touches. Order: same method, value transfer, field state, dispatch or call, shared field of one type.
    """
    nxt = steps.select("chain_id", (F.col("pos") - 1).alias("pos"), F.col("method").alias("right"), F.col("first").alias("r_first"), F.col("last").alias("r_last"))
    pairs = steps.withColumnRenamed("method", "left").join(nxt, ["chain_id", "pos"]).select("chain_id", "pos", "left", "first", "last", "right", "r_first", "r_last")
    inside = F.col("l_line").between(F.col("first"), F.col("last"))
    opposite = F.col("r_line").between(F.col("r_first"), F.col("r_last"))
    key = ["chain_id", "pos"]
    moved = pairs.join(transfers, ["left", "right"]).filter(inside & opposite).groupBy(*key).agg(F.min(F.when(F.col("kind") == "static", "static_value_hop").otherwise(F.col("kind"))).alias("by_value"))
    rel = pairs.join(relations, ["left", "right"]).filter(inside & ((F.col("kind") != "FIELD_STATE") | opposite)).groupBy(*key).agg(
        F.min(F.when(F.col("kind") == "FIELD_STATE", F.struct(F.lit(0), F.lit("field_state_bridge"))).when(F.col("kind") == "VIRTUAL_DISPATCH", F.struct(F.lit(1), F.lit("cha_poly_bridge")))
              .otherwise(F.struct(F.lit(2), F.lit("call_argument_hop")))).alias("r"))
    f = fields.select("method", "type_name", "field").distinct()
    shared = pairs.select(*key, "left", "right").join(f.withColumnRenamed("method", "left"), "left").join(f.withColumnRenamed("method", "right"), ["right", "type_name", "field"]).select(*key).distinct().withColumn("__f", F.lit(True))
    j = pairs.join(moved, key, "left").join(rel, key, "left").join(shared, key, "left")
    kind = F.when(F.col("left") == F.col("right"), "intra_method_hop").otherwise(F.coalesce("by_value", F.col("r.col2"), F.when(F.col("__f"), "field_state_bridge")))
    return j.select(*key, "left", "right", kind.alias("kind"))


def fact_chains(facts: DataFrame, max_edges: int = 24, max_chains: int | None = 16) -> DataFrame:
    """Maximal chains of the facts that are not refuted, from roots to leaves: ``facts(edge_id, src, dst, status)``."""
    live = cut_lineage(facts.filter("status <> 'VERIFIER_REFUTED'").select("edge_id", "src", "dst"))
    roots = live.join(live.select(F.col("dst").alias("src")), "src", "left_anti")
    level = cut_lineage(roots.select(F.col("dst").alias("tip"), F.array("edge_id").alias("chain")))
    outs = live.select(F.col("src").alias("tip"), "edge_id", F.col("dst").alias("next"))
    done = []
    for n in range(1, max_edges + 1):
        more = outs.select("tip").distinct()
        done.append(level.join(more, "tip", "left_anti") if n < max_edges else level)
        if n == max_edges:
            break
        level = cut_lineage(level.join(outs, "tip").select(F.col("next").alias("tip"), F.concat("chain", F.array("edge_id")).alias("chain")))
        if level.isEmpty():
            break
    out = _union(done).select("chain", F.size("chain").alias("length"))
    return out if max_chains is None else out.orderBy("length", "chain").limit(max_chains)


def chains_omitted(chains: DataFrame, max_chains: int = 16) -> DataFrame:
    """One row: chains in all, and how many a limit leaves out; ``chains`` are those of :func:`fact_chains` without one."""
    n = F.count(F.lit(1))
    return chains.agg(n.alias("chains"), F.greatest(n - max_chains, F.lit(0)).alias("omitted"))
