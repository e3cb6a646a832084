"""Endpoint classification: external inputs, security effects, wrappers, boundaries, sensitive receivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators import rules as R
from pathloom.operators.skew import first_by, prefix_sum


def _rules(df: DataFrame, rows: list[tuple], schema: str, custom: DataFrame | None) -> DataFrame:
    """A rule table: fixed and small, so it is broadcast; a caller's own table is left to the optimizer."""
    return custom if custom is not None else F.broadcast(R.table(df.sparkSession, rows, schema))


def external_inputs(params: DataFrame, calls: DataFrame, returns: DataFrame, annotation_rules: DataFrame | None = None, call_rules: DataFrame | None = None) -> DataFrame:
    """Inputs by annotated parameter, by request accessor call, and by one-hop return of either.

    ``params(param_id, method_id, package, annotation, file, line)``, ``calls(call_id, method_id, type, name, file, line)``,
    ``returns(method_id, call_id, param_id, file, line)``.
    """
    annotated = _rules(params, R.annotation_rows(), "package string, annotation string, mechanism string", annotation_rules)
    accessors = _rules(calls, R.accessor_rows(), "type string, name string, mechanism string", call_rules)
    p = params.join(annotated, ["package", "annotation"])
    c = calls.join(accessors, ["type", "name"])

    def rows(df: DataFrame, entity: str, kind: str, source: str) -> DataFrame:
        return df.select("mechanism", F.col(entity).cast("string").alias("entity"), F.lit(kind).alias("evidence_kind"), "file", "line", F.lit(source).alias("source"))

    back = returns.select("method_id", "call_id", "param_id", "file", "line")
    by_call = c.select("call_id", "mechanism").join(back, "call_id")
    by_param = p.select("param_id", "mechanism", F.col("method_id").alias("owner")).join(back, "param_id").filter("owner = method_id")
    return (
        rows(p, "param_id", "ANNOTATED_PARAMETER", "STATIC").unionByName(rows(c, "call_id", "SERVLET_ACCESSOR_CALL", "STATIC"))
        .unionByName(rows(by_call, "method_id", "DIRECT_RETURN_WRAPPER", "STATIC_DERIVED"))
        .unionByName(rows(by_param, "method_id", "DIRECT_PARAMETER_RETURN_WRAPPER", "STATIC_DERIVED")).distinct())


def security_effects(calls: DataFrame, effect_rules: DataFrame | None = None) -> DataFrame:
    """Effect calls with type, rule, mechanism and critical argument.

    ``calls(call_id, method_id, type, name, accessor_type, accessor)``; the accessor is the call a receiver comes from.
    """
    schema = "type string, name string, effect_type string, rule string, mechanism string, argument_index int"
    plain = calls.join(_rules(calls, R.effect_rows(), schema, effect_rules), ["type", "name"])
    cols = ("call_id", "method_id", "effect_type", "rule", "mechanism", "argument_index")
    short = F.substring_index("accessor_type", ".", -1)
    package = F.regexp_replace("accessor_type", r"\.[^.]*$", "")
    body = calls.filter(
        F.col("accessor").isin(*R.BODY_ACCESSORS) & F.col("name").isin(*R.BODY_WRITES) & short.isin(*R.RESPONSE_TYPES) & package.isin(*R.SERVLET_PACKAGES)
    ).select("call_id", "method_id", F.lit("RENDERING").alias("effect_type"), F.lit("SERVLET_RESPONSE_BODY_ARG0").alias("rule"),
             F.concat_ws("_", F.lit("SERVLET_RESPONSE"), "accessor", "name").alias("mechanism"), F.lit(0).alias("argument_index"))
    return plain.select(*cols).unionByName(body)


def effect_wrappers(effects: DataFrame, arguments: DataFrame, params: DataFrame) -> DataFrame:
    """Methods that pass their own parameter straight into the critical argument: equi-joins on call, index and variable."""
    passed = effects.filter("argument_index >= 0").join(arguments.select("call_id", F.col("index").alias("argument_index"), "variable"), ["call_id", "argument_index"])
    own = params.select("method_id", F.col("name").alias("variable"), F.col("position").alias("parameter_index"))
    return passed.join(own, ["method_id", "variable"]).select("method_id", "call_id", "effect_type", "variable", "parameter_index")


def boundary_candidates(params: DataFrame, annotations: DataFrame, handler_rules: DataFrame | None = None) -> DataFrame:
    """Parameters at a structural boundary, best tier first: handler annotation, override or callback, request-like type alone.

    ``params(param_id, method_id, method_name, type, overrides)``, ``annotations(method_id, package, annotation)``.
    """
    table = _rules(annotations, R.handler_rows(), "package string, annotation string, reason string, evidence_kind string", handler_rules)
    handled = annotations.join(table, ["package", "annotation"]).select("method_id", "reason", "evidence_kind").distinct()
    by_annotation = params.join(handled, "method_id").withColumn("confidence", F.lit("STRUCTURE_HIGH"))
    short = F.substring_index("type", ".", -1)
    request_like = short.rlike(f"(?:{'|'.join(R.REQUEST_SUFFIXES)})$")
    callback = request_like & (F.col("overrides") | F.col("method_name").isin(*R.CALLBACK_NAMES))
    by_shape = params.filter(callback).select(
        "*", F.when(F.col("overrides"), "OVERRIDE_PARAMETER").otherwise("CALLBACK_PARAMETER").alias("reason"),
        F.when(F.col("overrides"), "OVERRIDDEN_REQUEST_LIKE_PARAMETER").otherwise("CALLBACK_REQUEST_LIKE_PARAMETER").alias("evidence_kind"),
        F.when(F.col("overrides"), "STRUCTURE_HIGH").otherwise("STRUCTURE_MEDIUM").alias("confidence"))
    rest = params.filter(request_like & ~callback).join(handled.select("method_id").distinct(), "method_id", "left_anti").select(
        "*", F.lit("REQUEST_CONTEXT_TYPE").alias("reason"), F.lit("REQUEST_LIKE_PARAMETER_TYPE").alias("evidence_kind"), F.lit("OPEN_CANDIDATE").alias("confidence"))
    cols = ("param_id", "reason", "evidence_kind", "confidence")
    return by_annotation.select(*cols).unionByName(by_shape.select(*cols)).unionByName(rest.select(*cols))


def receiver_effects(calls: DataFrame) -> DataFrame:
    """Calls on a sensitive receiver by type suffix and method, at argument 0 or else the receiver.

    ``calls(call_id, type, name, n_args)``.
    """
    short = F.substring_index("type", ".", -1)
    found = [
        calls.filter(short.rlike(f"(?:{'|'.join(suffixes)})$") & F.col("name").isin(*methods)).select(
            "call_id", F.lit(reason).alias("reason"), F.lit(category).alias("category"), F.lit(evidence).alias("evidence_kind"), F.lit(confidence).alias("confidence"), "n_args")
        for suffixes, methods, reason, category, evidence, confidence in R.RECEIVERS
    ]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    has_arg = F.col("n_args") > 0
    return every.select("call_id", "reason", "category", "evidence_kind", "confidence", F.when(has_arg, "CALL_ARGUMENT").otherwise("RECEIVER").alias("value_role"),
                        F.when(has_arg, 0).otherwise(-1).alias("argument_index"))


def name_match(df: DataFrame, name: str) -> DataFrame:
    """Whether a name reads like an input, and the categories for which it reads like an effect."""
    sinks = F.array(*[F.when(F.col(name).rlike(pattern), F.lit(category)) for category, pattern in R.SINK_TERMS.items()])
    return df.select("*", F.col(name).rlike(R.SOURCE_TERMS).alias("is_source"), F.array_compact(sinks).alias("sink_categories"))


def sensitive_slots(category: Column, name: Column, arity: Column, target: Column) -> Column:
    """Argument positions that carry the effect."""
    n = F.lower(name)
    first = (
        ((category == "CWE-78") & (n == "exec") & F.coalesce(target == "java.lang.Runtime", F.lit(False)))
        | ((category == "CWE-79") & n.isin("write", "append", "print", "println"))
        | ((category == "CWE-94") & n.isin("eval", "evaluate", "compile", "forname", "loadclass", "parseexpression")))
    count = F.when(first, 1).when((category == "CWE-22") & n.isin("copy", "move", "file", "resolve"), F.least(F.lit(2), arity)).otherwise(arity)
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def controllable_sinks(calls: DataFrame, constants: DataFrame, receiver_values: DataFrame) -> DataFrame:
    """Effect calls with a sensitive argument that is no constant; without arguments the receiver may count.

    ``calls(call_id, category, name, arity, target)``, ``constants(call_id, index)``, ``receiver_values(call_id)``.
    """
    fixed = constants.groupBy("call_id").agg(F.collect_set(F.col("index").cast("int")).alias("fixed"))
    carried = receiver_values.select("call_id").distinct().withColumn("__recv", F.lit(True))
    j = calls.join(fixed, "call_id", "left").join(carried, "call_id", "left")
    n, cat = F.lower("name"), F.col("category")
    foreign = (n == "start") & (cat == "CWE-78") & F.coalesce(F.col("target") != "java.lang.ProcessBuilder", F.lit(False))
    by_receiver = ((cat == "CWE-78") & (n == "start")) | ((cat == "CWE-22") & n.isin("delete", "open")) | F.coalesce("__recv", F.lit(False))
    open_slots = F.array_except(sensitive_slots(cat, F.col("name"), F.col("arity"), F.col("target")), F.coalesce("fixed", F.array().cast("array<int>")))
    ok = F.when(foreign, False).when(F.col("arity").isNull(), True).when(F.col("arity") == 0, by_receiver).otherwise(F.size(open_slots) > 0)
    return j.filter(ok).select(*calls.columns)


def method_signals(methods: DataFrame, calls: DataFrame, alerts: DataFrame) -> DataFrame:
    """Score per method and category from capped counts of alerts, dangerous calls, dynamic arguments and inputs.

    ``methods(method_id, binding, related)``, ``calls(method_id, category, dangerous, dynamic, is_source)``,
    ``alerts(method_id, category)``.
    """
    danger = calls.groupBy("method_id", "category").agg(
        F.count_if("dangerous").alias("matched"), F.count_if(F.col("dangerous") & F.col("dynamic")).alias("dyn"))
    sources = calls.groupBy("method_id").agg(F.count_if("is_source").alias("sources"))
    native = alerts.groupBy("method_id", "category").agg(F.count(F.lit(1)).alias("native"))
    cap = lambda c, n: F.least(F.coalesce(c, F.lit(0)), F.lit(n))
    grid = methods.withColumn("category", F.explode(F.array(*map(F.lit, R.CATEGORIES))))
    j = grid.join(danger, ["method_id", "category"], "left").join(native, ["method_id", "category"], "left").join(sources, "method_id", "left")
    score = (24 * cap("native", 2) + 8 * cap("matched", 3) + 3 * cap("dyn", 2) + 4 * cap("sources", 2)
             + 2 * F.col("binding").cast("int") + 2 * F.col("related").cast("int"))
    return j.select("method_id", "category", score.alias("score"))


def boundary_scores(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """Score per method and category from distinct effect and input call names, text terms and alerts.

    ``methods(method_id, text, alerted)``, ``calls(method_id, name)``.
    """
    names = name_match(calls.select("method_id", "name").distinct(), "name")
    api = names.select("method_id", F.explode("sink_categories").alias("category")).groupBy("method_id", "category").agg(F.count(F.lit(1)).alias("api"))
    entry = names.filter("is_source").groupBy("method_id").agg(F.count(F.lit(1)).alias("entry"))
    terms = F.explode(F.array(*[
        F.struct(F.lit(c).alias("category"), F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0)))).alias("terms")) for c, p in R.BOUNDARY_TERMS.items()
    ])).alias("x")
    grid = methods.select("method_id", "alerted", terms).select("method_id", "alerted", "x.category", "x.terms")
    cap = lambda c, n: F.least(F.coalesce(c, F.lit(0)), F.lit(n))
    j = grid.join(api, ["method_id", "category"], "left").join(entry, "method_id", "left")
    return j.select("method_id", "category", (3 * cap("api", 4) + cap("terms", 5) + cap("entry", 2) + 5 * F.col("alerted").cast("int")).alias("score"))


def mechanisms(surfaces: DataFrame, methods: DataFrame, calls: DataFrame, imports: DataFrame, batch: int = 3) -> DataFrame:
    """Groups for review: web surfaces of a file in batches, files that traverse and change a document tree, uses of versioned classes.

    ``surfaces(file, line, method_id)``, ``methods(method_id, file, line)``, ``calls(method_id, name, receiver)``,
    ``imports(file, class_name, watched)``.
    """
    placed = prefix_sum(surfaces, ["file"], "line", F.lit(1), "pos")
    web = placed.withColumn("n", F.floor((F.col("pos") - 1) / batch)).select(F.lit("WEB_SURFACE").alias("kind"), "file", F.col("n").cast("string").alias("part"), "method_id")
    owned = calls.join(methods.select("method_id", "file"), "method_id")
    walks, edits = F.col("name").isin(*TRAVERSE), F.col("name").isin(*MUTATE)
    dom_files = imports.filter("class_name LIKE 'org.w3c.dom%'").select("file").distinct()
    touched = owned.join(dom_files, "file", "left_semi").filter(walks | edits)
    both = touched.groupBy("file").agg(F.bool_or(walks).alias("w"), F.bool_or(edits).alias("e")).filter("w AND e").select("file")
    dom = touched.join(both, "file", "left_semi").select("file", "method_id").distinct().select(F.lit("DOM_TRANSFORM").alias("kind"), "file", F.col("method_id").cast("string").alias("part"), "method_id")
    watched = imports.filter("watched").select("file", F.substring_index("class_name", ".", -1).alias("receiver")).distinct()
    enc = owned.join(watched, ["file", "receiver"], "left_semi").select("file", "method_id").distinct().select(
        F.lit("ENCODING_USE").alias("kind"), "file", F.col("method_id").cast("string").alias("part"), "method_id")
    return web.unionByName(dom).unionByName(enc)


# Document-tree calls that read and that change.
TRAVERSE = ("getFirstChild", "getLastChild", "getNextSibling", "getPreviousSibling", "getChildNodes", "getElementsByTagName")
MUTATE = ("removeChild", "replaceChild", "appendChild", "insertBefore", "setNodeValue", "setTextContent")


def entity_facts(facts: DataFrame, params: DataFrame, annotations: DataFrame, supertypes: DataFrame, spans: DataFrame) -> DataFrame:
    """Facts of the entities that overlap a target span, with parameters in order and sorted annotations and supertypes.

    ``facts(entity_id, file, start, end, kind, name, type_id)``, ``params(entity_id, position, type)``, ``spans(span_id, file, s_start, s_end)``.
    """
    from pathloom.operators.intervals import overlapping_spans

    hits = overlapping_spans(facts, spans, ["file"], ("start", "end"), ("s_start", "s_end")).select("span_id", "entity_id", "kind", "name", "type_id")
    wanted = hits.select("entity_id").distinct()
    listed = params.join(wanted, "entity_id", "left_semi").groupBy("entity_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "type"))), lambda p: p["type"]), ",").alias("parameters"))
    notes = annotations.join(wanted, "entity_id", "left_semi").groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("annotation")), "|").alias("annotations"))
    parents = supertypes.groupBy("type_id").agg(F.array_join(F.array_sort(F.collect_set("supertype")), "|").alias("supertypes"))
    out = hits.join(listed, "entity_id", "left").join(notes, "entity_id", "left").join(parents, "type_id", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("span_id", "entity_id", "kind", "name", text("parameters"), text("annotations"), text("supertypes"))


def first_signal(scores: DataFrame) -> DataFrame:
    """Best category per method, ties to the earlier category."""
    order = F.array_position(F.array(*map(F.lit, R.CATEGORIES)), F.col("category"))
    ranked = scores.select("method_id", (-F.col("score")).alias("__neg"), order.alias("__cat"), "category", "score")
    return first_by(ranked, ["method_id"], ["__neg", "__cat"]).drop("__neg", "__cat")
