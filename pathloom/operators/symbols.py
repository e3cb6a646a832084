"""Symbols and types: strict entity mapping, inherited symbol resolution, type families, scoped state, resource references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.scalars import compact_type, erase_type
from pathloom.operators.graph import components, reach
from pathloom.operators.intervals import overlapping_spans
from pathloom.operators.skew import top_k
from pathloom.session import cut_lineage, stored


def map_entities(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities mapped to facts by file, span overlap and kind, then tightened key by key where a key keeps something.

    ``entities(entity_id, file, start, end, kind, qualified_name, signature, enclosing_type, enclosing_callable)``,
    ``facts(fact_id, file, f_start, f_end, f_kind, f_qualified_name, f_signature, f_enclosing_type, f_enclosing_callable)``.
    """
    hits = overlapping_spans(entities, facts, ["file"], ("start", "end"), ("f_start", "f_end"))
    kind, other = F.col("kind"), F.col("f_kind")
    fits = (
        F.when(kind.isin("FIELD_READ", "FIELD_WRITE"), other.isin("FIELD_ACCESS") | (other == kind))
        .when(kind == "CALL_ARGUMENT", other.isin("CALL_ARGUMENT", "EXPR")).otherwise(other == kind))
    hits = hits.filter(fits).select("entity_id", "fact_id", *[
        F.coalesce(F.col(c) == F.col(f"f_{c}"), F.lit(False)).alias(c) for c in ("qualified_name", "signature", "enclosing_type", "enclosing_callable")])
    # A key tightens only if some fact still in the running matches it: fold the flags of one entity's facts in turn.
    keys = ("qualified_name", "signature", "enclosing_type", "enclosing_callable")
    rest, proofs = hits, F.lit(3)
    for c in keys:
        any_ = rest.groupBy("entity_id").agg(F.bool_or(c).alias(f"__any_{c}"))
        rest = rest.join(any_, "entity_id").filter(F.col(c) | ~F.col(f"__any_{c}"))
        proofs = proofs + F.col(f"__any_{c}").cast("int")
    mapped = rest.withColumn("proofs", proofs).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.min("fact_id").alias("one"), F.max("proofs").alias("proofs"))
    j = entities.select("entity_id").join(mapped, "entity_id", "left")
    n = F.coalesce("n", F.lit(0))
    return j.select(
        "entity_id", n.alias("candidate_count"), F.when(n == 0, "NOT_MAPPED").when(n > 1, "MAPPED_AMBIGUOUS").otherwise("MAPPED_UNIQUE").alias("status"),
        F.when(n == 1, F.col("one")).alias("fact_id"), F.when(n == 0, "NONE").when(n > 1, "AMBIGUOUS").when(F.col("proofs") >= 4, "HIGH").otherwise("MEDIUM").alias("confidence"))


def resolve_symbols(queries: DataFrame, methods: DataFrame, parents: DataFrame) -> DataFrame:
    """Methods a textual symbol may name: ``[Type.]name[(signature)]``, with inherited declarations.

    ``queries(query_id, symbol)``, ``methods(method_id, type_name, name, signature, private)``,
    ``parents(type_name, parent)``. A type matches by name or dotted suffix; a signature matches exactly or, when no
    hit does, with generics and packages erased; an inherited method is hidden by a direct one of equal signature.
    """
    text = F.translate(compact_type(F.col("symbol")), "#$", "..")
    head = F.substring_index(text, "(", 1)
    has_type = F.contains(head, F.lit("."))
    q = queries.select(
        "query_id", F.substring_index(head, ".", -1).alias("name"), F.when(has_type, F.regexp_replace(head, r"\.[^.]*$", "")).alias("wanted_type"),
        F.when(text.contains("("), F.regexp_replace(F.regexp_replace(text, r"^[^(]*\(", ""), r"\)+$", "")).alias("wanted_signature"))
    known = methods.select("type_name").distinct().unionByName(parents.select("type_name")).distinct()
    dotted = F.translate("type_name", "$", ".")
    # Every dotted suffix of a type is a key, so the suffix match is an equi-join.
    parts = F.split(dotted, r"\.")
    suffixes = known.select("type_name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts) - n + 1), "."))).alias("suffix"))
    own = q.filter("wanted_type IS NOT NULL").join(suffixes.select("type_name", F.col("suffix").alias("wanted_type")), "wanted_type").select("query_id", "type_name")
    erased = F.translate(F.regexp_replace("parent", "<.*>", ""), "$", ".")
    up = parents.select(F.col("type_name").alias("src"), erased.alias("suffix")).join(suffixes.withColumnRenamed("type_name", "dst"), "suffix").select("src", "dst")
    typed = own.select("type_name").distinct()
    closure = reach(up, typed.select(F.col("type_name").alias("seed"), F.col("type_name").alias("node")))
    scope = own.join(closure.withColumnRenamed("seed", "type_name"), "type_name").groupBy("query_id", "node").agg(F.min("depth").alias("depth"))
    scoped = q.join(scope, "query_id").join(methods.withColumnRenamed("type_name", "node"), ["node", "name"]).filter((F.col("depth") == 0) | ~F.col("private"))
    free = q.filter("wanted_type IS NULL").join(methods, "name").select("query_id", "name", "wanted_type", "wanted_signature", F.col("type_name").alias("node"), F.lit(0).alias("depth"), "method_id", "signature", "private")
    hits = scoped.select("query_id", "name", "wanted_type", "wanted_signature", "node", "depth", "method_id", "signature", "private").unionByName(free)
    inner = F.regexp_replace(F.regexp_replace(compact_type(F.col("signature")), r"^[^(]*\(", ""), r"\)+$", "")
    hits = hits.withColumn("exact", F.col("wanted_signature").isNull() | (inner == F.col("wanted_signature"))).withColumn(
        "loose", F.col("wanted_signature").isNull() | (erase_type(inner) == erase_type(F.col("wanted_signature"))))
    some = hits.groupBy("query_id").agg(F.bool_or("exact").alias("__some"))
    kept = hits.join(some, "query_id").filter(F.when(F.col("__some"), F.col("exact")).otherwise(F.col("loose")))
    direct = kept.filter("depth = 0 AND wanted_type IS NOT NULL").select("query_id", "signature").distinct()
    inherited = kept.filter("depth > 0").join(direct, ["query_id", "signature"], "left_anti")
    return kept.filter("depth = 0").select("query_id", "method_id").unionByName(inherited.select("query_id", "method_id")).distinct()


def type_family(relations: DataFrame) -> DataFrame:
    """Types tied by parent, child, enclosing or nested relations, as ``node, label``: the ties go both ways, so a family is a component."""
    return components(relations)


def visible_types(types: DataFrame, parents: DataFrame, enclosing: DataFrame) -> DataFrame:
    """Types whose fields a type sees: itself, its ancestors by distance, then those of its enclosing types outwards.

    ``types(type_name)``, ``parents(type_name, parent)``, ``enclosing(type_name, outer)``; of one type's two ways the nearer counts.
    """
    seeds = types.select(F.col("type_name").alias("seed"), F.col("type_name").alias("node"))
    outward = reach(enclosing.select(F.col("type_name").alias("src"), F.col("outer").alias("dst")), seeds).select("seed", F.col("node").alias("shell"), F.col("depth").alias("shells"))
    every = seeds.select("node").unionByName(outward.select(F.col("shell").alias("node"))).distinct()
    upward = reach(parents.select(F.col("type_name").alias("src"), F.col("parent").alias("dst")), every.select(F.col("node").alias("seed"), "node")).select(F.col("seed").alias("shell"), "node", F.col("depth").alias("ups"))
    return outward.join(upward, "shell").groupBy("seed", "node").agg(F.min(F.struct("shells", "ups")).alias("at")).select("seed", "node", "at.shells", "at.ups")


def state_query(queries: DataFrame, accesses: DataFrame, methods: DataFrame, families: DataFrame, limit: int = 48) -> DataFrame:
    """Field accesses by direction and same-named methods in a type's family, field state first, with the number left out.

    ``queries(query_id, symbol, type_name, direction)``, ``accesses(field, type_name, method_id, file, line, access)``,
    ``methods(method_id, name, type_name, file, line)``, ``families(node, label)``.
    """
    of = families.select(F.col("node").alias("type_name"), "label")
    q = cut_lineage(queries.join(of, "type_name").select("query_id", "symbol", "direction", "label"))
    # The answer depends on symbol, family and direction alone: it is found once for each such class, whose rows a
    # salted top-k and partial counts spread, and a query takes over at most ``limit`` rows.
    by = ["symbol", "label", "direction"]
    classes = q.select(*by).distinct()
    a = accesses.join(of, "type_name").select(F.col("field").alias("symbol"), "label", "method_id", "file", "line", "access")
    wanted = F.when(F.col("direction") == "forward", F.col("access") == "READ").when(F.col("direction") == "backward", F.col("access") == "WRITE").otherwise(F.lit(True))
    states = a.join(classes, ["symbol", "label"]).filter(wanted).select(*by, F.lit("FIELD_STATE").alias("kind"), "method_id", "file", "line")
    m = methods.join(of, "type_name").select(F.col("name").alias("symbol"), "label", "method_id", "file", "line")
    calls = m.join(classes, ["symbol", "label"]).select(*by, F.lit("SCOPED_DISPATCH").alias("kind"), "method_id", "file", "line")
    hits = stored(states.unionByName(calls).distinct())
    totals = hits.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    top = top_k(hits, by, [F.col("kind"), F.col("file"), F.col("line"), F.col("method_id")], limit).join(totals, by)
    rows = q.join(top, by).drop(*by)
    return rows.withColumn("omitted", F.greatest(F.col("total") - limit, F.lit(0)))


def resolve_references(references: DataFrame, targets: DataFrame) -> DataFrame:
    """References with how many targets answer to any of their names; resolved only by exactly one.

    ``references(ref_id, names array<string>)``, ``targets(name, target)``.
    """
    wanted = references.select("ref_id", F.explode(F.array_distinct("names")).alias("name"))
    hits = wanted.join(targets.select("name", "target").distinct(), "name").select("ref_id", "target").distinct().groupBy("ref_id").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("one"))
    n = F.coalesce("n", F.lit(0))
    return references.select("ref_id").join(hits, "ref_id", "left").select(
        "ref_id", F.when(n == 1, F.col("one")).alias("target"), F.when(n == 0, "absent").when(n == 1, "resolved").otherwise("ambiguous").alias("status"))


def view_names(base: Column, literal: Column) -> Column:
    """Template files a view name may mean; none for an unsafe name."""
    safe = literal.rlike(r"^[\w.-]+(?:/[\w.-]+)*$") & ~F.array_contains(F.split(literal, "/"), "..")
    return F.when(safe, F.transform(F.array(*[F.lit(e) for e in ("", ".ftl", ".html", ".jsp")]), lambda e: F.concat(base, F.lit("/templates/"), literal, e))).otherwise(F.array().cast("array<string>"))


def script_names(base: Column, page: Column, src: Column) -> Column:
    """Files a script source may mean: below the static roots when absolute, else beside the page."""
    clean = F.regexp_replace(src, r"^\$\{(?:request|pageContext\.request)\.contextPath\}", "")
    safe = clean.rlike(r"^/?[\w.-]+(?:/[\w.-]+)*$") & ~F.array_contains(F.split(clean, "/"), "..")
    rooted = F.transform(F.array(*[F.lit(f) for f in ("/static", "/public", "/META-INF/resources", "")]), lambda f: F.concat(base, f, clean))
    beside = F.array(F.concat(F.regexp_replace(page, "[^/]*$", ""), clean))
    return F.when(safe, F.when(clean.startswith("/"), rooted).otherwise(beside)).otherwise(F.array().cast("array<string>"))


def web_surfaces(methods: DataFrame, params: DataFrame, calls: DataFrame, fields: DataFrame, mappers: DataFrame, views: DataFrame) -> DataFrame:
    """Route methods with their parameters, the persistence calls on declared fields, mapper files and class views.

    ``methods(method_id, type_name, annotation)``, ``params(method_id, position, name, type)``,
    ``calls(method_id, receiver, name, line)``, ``fields(type_name, name, type)``, ``mappers(namespace, file)``, ``views(type_name, file)``.
    """
    route = r"@(?:[\w.]+\.)?(?:Request|Get|Post|Put|Delete|Patch)Mapping\b"
    routes = methods.filter(F.col("annotation").rlike(route)).select("method_id", "type_name")
    join_all = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    own = params.join(routes, "method_id", "left_semi").groupBy("method_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.concat_ws(" ", "type", "name").alias("p")))), lambda x: x["p"]), ",").alias("parameters"))
    receiver = F.regexp_replace("receiver", r"^this\.", "")
    stored = calls.join(routes, "method_id").withColumn("field", receiver).join(fields.select("type_name", F.col("name").alias("field"), F.col("type").alias("field_type")), ["type_name", "field"]).groupBy("method_id").agg(
        join_all(F.concat_ws(".", "field_type", "name")).alias("persistence"))
    per_type = fields.join(mappers.select(F.col("namespace").alias("type"), "file"), "type").groupBy("type_name").agg(join_all("file").alias("mapper_files"))
    shown = views.groupBy("type_name").agg(join_all("file").alias("views"))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return routes.join(own, "method_id", "left").join(stored, "method_id", "left").join(per_type, "type_name", "left").join(shown, "type_name", "left").select(
        "method_id", text("parameters"), text("persistence"), text("mapper_files"), text("views"))
