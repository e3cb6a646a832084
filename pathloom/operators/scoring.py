"""Scoring against labels: label selection, hits, path and campaign metrics, run comparison, hop analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.scalars import rate
from pathloom.operators.intervals import overlapping_spans, points_in_spans, spans_within
from pathloom.session import stored


def alert_mapping(points: DataFrame) -> DataFrame:
    """Totals over mapped alert locations: ``points(alert_id, mapping, ...)``."""
    unique = F.col("mapping") == "unique"
    per_alert = points.groupBy("alert_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(unique).alias("u"))
    return per_alert.agg(
        F.count(F.lit(1)).alias("alerts"), F.sum("n").alias("locations"), F.sum("u").alias("uniquely_mapped"),
        rate(F.sum("u"), F.sum("n")).alias("mapping_rate"), F.count_if(F.col("u") > 0).alias("alerts_with_unique_method"))


def select_labels(projects: DataFrame, fixes: DataFrame) -> DataFrame:
    """Label rows per project: by exact slug; without any, by advisory id, repository and a listed fix commit.

    ``projects(project_slug, cve_id, repo, fix_commits)``, ``fixes(fix_id, project_slug, cve_id, repo, commit)``.
    """
    exact = projects.select("project_slug").join(fixes, "project_slug").withColumn("selection", F.lit("exact_slug"))
    rest = projects.join(exact.select("project_slug").distinct(), "project_slug", "left_anti")
    listed = rest.withColumn("commit", F.explode(F.array_distinct(F.split("fix_commits", ";")))).filter("commit <> ''").select(
        "project_slug", "cve_id", F.lower("repo").alias("repo_key"), "commit")
    other = fixes.withColumn("repo_key", F.lower("repo")).select("fix_id", "cve_id", "repo_key", "commit")
    fallback = listed.join(other, ["cve_id", "repo_key", "commit"]).withColumn("selection", F.lit("cve_repository_fix"))
    return exact.select("project_slug", "fix_id", "selection").unionByName(fallback.select("project_slug", "fix_id", "selection"))


def path_hits(steps: DataFrame, targets: DataFrame) -> DataFrame:
    """Paths with the number of distinct target methods any step lies in: ``steps(project_id, path_id, owner)``."""
    paths = steps.select("project_id", "path_id").distinct()
    hits = steps.filter("owner IS NOT NULL").select("project_id", "path_id", "owner").distinct().join(
        targets.select("project_id", F.col("method_id").alias("owner")).distinct(), ["project_id", "owner"], "left_semi")
    found = hits.groupBy("project_id", "path_id").agg(F.count(F.lit(1)).alias("matched"))
    return paths.join(found, ["project_id", "path_id"], "left").withColumn("matched", F.coalesce("matched", F.lit(0)))


def location_hits(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Affected lines whose owner is a target method; a diagnostic beside the path metric, not part of it."""
    return points.filter("owner IS NOT NULL").join(
        targets.select("project_id", F.col("method_id").alias("owner")).distinct(), ["project_id", "owner"], "left_semi")


def path_metrics(hits: DataFrame) -> DataFrame:
    """Per project: recall flag, path precision, F1."""
    n, tp = F.count(F.lit(1)), F.count_if(F.col("matched") > 0)
    base = hits.groupBy("project_id").agg(n.alias("paths"), tp.alias("tp_paths"))
    recall = (F.col("tp_paths") > 0).cast("int")
    precision = F.coalesce(F.try_divide(F.col("tp_paths").cast("double"), F.col("paths")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0))
    return base.select("*", recall.alias("recall"), F.round(precision, 6).alias("precision"), F.round(f1, 6).alias("f1"))


def campaign(samples: DataFrame) -> DataFrame:
    """Detected count, mean F1 and mean false discovery rate over scorable samples, and completeness.

    ``samples(sample, status, scorable, recall, precision, f1, paths)``; every expected sample has a row.
    """
    valid = (F.col("status") == "complete") & F.col("scorable")
    return samples.agg(
        F.count(F.lit(1)).alias("expected"), F.count_if(F.col("status") == "complete").alias("completed"),
        F.count_if(valid).alias("scorable"), F.coalesce(F.sum(F.when(valid, F.col("recall"))), F.lit(0)).alias("detected"),
        F.round(F.avg(F.when(valid, F.col("recall"))), 6).alias("detection_rate"), F.round(F.avg(F.when(valid, F.col("f1"))), 6).alias("avg_f1"),
        F.round(F.avg(F.when(valid & (F.col("paths") > 0), 1 - F.col("precision"))), 6).alias("avg_fdr_with_paths"),
        F.count_if(F.col("status") != "complete").alias("failed_or_unrun"))


def compare_runs(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples of two runs side by side with their change; and paired totals and means."""
    l = left.select("sample", F.col("recall").alias("l_recall"), F.col("precision").alias("l_precision"), F.col("f1").alias("l_f1"))
    r = right.select("sample", F.col("recall").alias("r_recall"), F.col("precision").alias("r_precision"), F.col("f1").alias("r_f1"))
    both = l.join(r, "sample", "full")
    change = (
        F.when(F.col("r_recall").isNull(), "left_only").when(F.col("l_recall").isNull(), "right_only")
        .when(F.col("l_recall") < F.col("r_recall"), "improvement").when(F.col("l_recall") > F.col("r_recall"), "regression").otherwise("same"))
    rows = both.withColumn("change", change)
    paired = rows.filter(~F.col("change").isin("left_only", "right_only"))
    mean = lambda c: F.round(F.avg(c), 6).alias(c + "_mean")
    up, down = F.count_if(F.col("change") == "improvement"), F.count_if(F.col("change") == "regression")
    totals = paired.agg(F.count(F.lit(1)).alias("paired"), up.alias("improvements"), down.alias("regressions"), (up - down).alias("net_change"),
                        *[mean(c) for c in ("l_recall", "l_precision", "l_f1", "r_recall", "r_precision", "r_f1")])
    return rows.select("sample", "change"), totals


def method_pairs(nodes: DataFrame) -> DataFrame:
    """Owner sequence of each path with equal neighbours collapsed, as adjacent pairs: ``nodes(path_id, pos, owner)``."""
    order = W.partitionBy("path_id").orderBy("pos")
    changed = nodes.withColumn("__prev", F.lag("owner").over(order)).withColumn("__first", F.row_number().over(order) == 1)
    kept = changed.filter(F.col("__first") | ~F.equal_null("owner", "__prev"))
    return kept.select(
        "path_id", F.col("owner").alias("from_method"), F.lead("owner").over(order).alias("to_method"),
        (F.row_number().over(order) - 1).alias("hop"), F.lead("pos").over(order).alias("__next"),
    ).filter("__next IS NOT NULL").drop("__next")


def covered(ranges: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Ranges with whether one evidence window holds them whole: ``ranges(key, file, first, last)``, ``windows(file, start, end)``."""
    inside = spans_within(ranges, windows, ["file"], ("first", "last"), ("start", "end")).select(key, "file", "first", "last").distinct().withColumn("__c", F.lit(True))
    return ranges.join(inside, [key, "file", "first", "last"], "left").withColumn("covered", F.coalesce("__c", F.lit(False))).drop("__c")


def attribute_hops(hops: DataFrame, pairs: DataFrame, reviews: DataFrame, selected: DataFrame, exports: DataFrame, omitted: DataFrame) -> DataFrame:
    """Where each chain hop stands: verified, spliced, statically missing, not recalled or not spliced; and why.

    ``hops(from_method, to_method)``; ``pairs(path_id, from_method, to_method)`` of kept paths and ``omitted`` of dropped
    ones; ``reviews(path_id, verdict)``; ``selected(path_id)``; ``exports(from_method, to_method, recalled, mapped)``.
    """
    on = ["from_method", "to_method"]
    paths = pairs.select("path_id", *on).distinct()
    verdicts = reviews.groupBy("path_id").agg(F.bool_or(F.col("verdict") == "SUPPORTED").alias("__sup"), F.lit(True).alias("__rev"))
    chosen = selected.select("path_id").distinct().withColumn("__sel", F.lit(True))
    on_path = paths.join(verdicts, "path_id", "left").join(chosen, "path_id", "left").groupBy(*on).agg(
        F.count(F.lit(1)).alias("n_paths"), F.bool_or(F.coalesce("__sup", F.lit(False))).alias("sup"),
        F.bool_or(F.coalesce("__rev", F.lit(False))).alias("rev"), F.bool_or(F.coalesce("__sel", F.lit(False))).alias("sel"))
    seen = F.col("recalled")
    static = exports.groupBy(*on).agg(
        F.count(F.lit(1)).alias("static_edges"), F.count_if(seen).alias("recalled_edges"),
        F.count_if(seen & F.col("mapped").isNotNull()).alias("valued"), F.bool_or(seen & F.coalesce("mapped", F.lit(False))).alias("any_mapped"))
    cut = omitted.select(*on).distinct().withColumn("cut", F.lit(True))
    j = hops.select(*on).distinct().join(on_path, on, "left").join(static, on, "left").join(cut, on, "left")
    matched = F.col("n_paths").isNotNull()
    spliced = F.when(F.col("sup"), "VERIFIED").otherwise("SPLICED_UNVERIFIED")
    status = (
        F.when(matched, spliced).when(F.col("static_edges").isNull(), "STATIC_MISSING")
        .when(F.col("recalled_edges") == 0, "EXPORTED_NOT_RECALLED").otherwise("RECALLED_NOT_SPLICED"))
    reason = (
        F.when(matched & ~F.col("rev"), F.when(F.col("sel"), "REVIEW_NOT_RECORDED").otherwise("NOT_SELECTED"))
        .when(~matched & (F.col("recalled_edges") > 0),
              F.when(F.col("cut"), "PROMPT_RANKING_TRUNCATED").when((F.col("valued") > 0) & ~F.col("any_mapped"), "AST_MAPPING_FAILED")
              .when(F.col("valued") == 0, "NO_RECALLED_VALUE_BRIDGE").otherwise("SELECTION_STAGE_UNOBSERVED")))
    return j.select(*on, status.alias("status"), reason.alias("reason"), F.coalesce("static_edges", F.lit(0)).alias("static_edges"),
                    F.coalesce("recalled_edges", F.lit(0)).alias("recalled_edges"), F.coalesce("n_paths", F.lit(0)).alias("n_paths"))


def patch_methods(fixes: DataFrame, methods: DataFrame, windows: DataFrame) -> DataFrame:
    """Fixes resolved to exactly one method by file, name and last type part, with a recalled flag; else a status.

    ``fixes(file, class_name, method)``, ``methods(method_id, file, name, type_name, start, end)``, ``windows(file, w_start, w_end)``.
    """
    options = methods.withColumn("class_name", F.substring_index("type_name", ".", -1)).withColumnRenamed("name", "method")
    hits = fixes.select("file", "class_name", "method").distinct().join(options, ["file", "class_name", "method"], "left")
    grouped = hits.groupBy("file", "class_name", "method").agg(F.count("method_id").alias("n"), F.min(F.struct("method_id", "start", "end")).alias("m"))
    single = grouped.filter("n = 1").select("file", "m.*")
    read = overlapping_spans(single, windows, ["file"], ("start", "end"), ("w_start", "w_end")).select("method_id").distinct().withColumn("__read", F.lit(True))
    return grouped.withColumn("method_id", F.when(F.col("n") == 1, F.col("m.method_id"))).join(read, "method_id", "left").select(
        "file", "class_name", "method", "method_id",
        F.when(F.col("n") == 1, F.coalesce("__read", F.lit(False))).alias("recalled"),
        F.when(F.col("n") == 1, "RESOLVED").when(F.col("n") > 1, "AMBIGUOUS_METHOD").otherwise("METHOD_NOT_RESOLVED").alias("status"))


def max_connected(chains: DataFrame, paths: DataFrame) -> DataFrame:
    """Longest run of consecutive equal owners between a chain and any path, in hops: gaps and islands on the diagonal.

    ``chains(chain_id, pos, owner)``, ``paths(path_id, pos, owner)``.
    """
    c = chains.select("chain_id", F.col("pos").alias("ci"), "owner")
    p = paths.select("path_id", F.col("pos").alias("pi"), "owner")
    met = c.join(p, "owner").withColumn("diag", F.col("ci") - F.col("pi"))
    run = W.partitionBy("chain_id", "path_id", "diag").orderBy("ci")
    islands = met.withColumn("isle", F.col("ci") - F.row_number().over(run)).groupBy("chain_id", "path_id", "diag", "isle").agg((F.count(F.lit(1)) - 1).alias("hops"))
    best = islands.groupBy("chain_id").agg(F.max("hops").alias("max_connected_hops"))
    return chains.select("chain_id").distinct().join(best, "chain_id", "left").withColumn("max_connected_hops", F.coalesce("max_connected_hops", F.lit(0)))


def open_obligations(required: DataFrame, windows: DataFrame, chunk: int = 40) -> DataFrame:
    """Required line ranges cut into chunks, less the chunks some evidence window holds whole.

    ``required(owner, file, first, last)``, ``windows(file, start, end)``.
    """
    starts = F.explode(F.sequence(F.col("first"), F.col("last"), F.lit(chunk)))
    pieces = required.select("owner", "file", starts.alias("c_first"), "last").withColumn("c_last", F.least(F.col("c_first") + chunk - 1, "last")).drop("last").distinct()
    done = spans_within(pieces, windows, ["file"], ("c_first", "c_last"), ("start", "end")).select("owner", "file", "c_first", "c_last")
    return pieces.join(done.distinct(), ["owner", "file", "c_first", "c_last"], "left_anti")


def missing_components(fragments: DataFrame, required: tuple[str, ...] = ("EXTERNAL_INPUT", "TRANSFER", "SECURITY_EFFECT")) -> DataFrame:
    """Per case the path parts no fragment supplies; anything that is not an endpoint is a transfer."""
    part = F.when(F.col("proposal_type").isin("EXTERNAL_INPUT", "SECURITY_EFFECT"), F.col("proposal_type")).otherwise("TRANSFER")
    have = fragments.groupBy("case_id").agg(F.collect_set(part).alias("have"))
    return have.select("case_id", F.array_except(F.array(*map(F.lit, required)), F.col("have")).alias("missing"))


def recall_at(rows: DataFrame, targets: DataFrame, cuts: tuple[int, ...] = (10, 30)) -> tuple[DataFrame, DataFrame]:
    """Best rank per target, and per case how many targets the first k rows cover: ``rows(case_id, rank, owner)``."""
    t = targets.select("case_id", F.col("method_id").alias("owner")).distinct()
    ranks = t.join(rows.select("case_id", "owner", "rank"), ["case_id", "owner"], "left").groupBy("case_id", "owner").agg(F.min("rank").alias("best_rank"))
    totals = ranks.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("targets"), F.count("best_rank").alias("recalled_all"),
        *[F.count_if(F.col("best_rank") <= k).alias(f"recalled_{k}") for k in cuts])
    return ranks, totals


def recovery_summary(results: DataFrame) -> DataFrame:
    """Totals of a recovery experiment and the decision its thresholds give.

    ``results(case_id, project_id, recovered, causal, flow_type, wall_seconds)``.
    """
    rec = F.col("recovered")
    base = results.agg(
        F.count(F.lit(1)).alias("selected_cases"), F.countDistinct("project_id").alias("selected_projects"), F.count_if(rec).alias("recovered_cases"),
        F.countDistinct(F.when(rec, F.col("project_id"))).alias("recovered_projects"), F.countDistinct(F.when(rec, F.col("flow_type"))).alias("categories"),
        F.count_if(rec & F.col("causal")).alias("causal_cases"), F.round(F.avg("wall_seconds"), 6).alias("avg_wall_seconds"))
    n = F.col("recovered_cases")
    causal = (n > 0) & (F.col("causal_cases") == n)
    go = (n >= 3) & (F.col("recovered_projects") >= 2) & (F.col("categories") >= 2) & causal
    return base.select("*", rate(n, F.col("selected_cases")).alias("recovery_rate"), causal.alias("causal_for_all"),
                       ((n >= 5) & (F.col("recovered_projects") >= 3)).alias("preferred_threshold_met"),
                       F.when(go, "PROCEED_M7").otherwise("REVISE_WORK1_MECHANISM").alias("decision"))


def path_matches(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Candidate paths that meet an annotation: by mapped entity, else by file suffix and span overlap.

    ``nodes(case_id, path_id, entity_id, file, start, end)``, ``annotations(case_id, entity_id, file, start, end, method)``.
    """
    a = annotations.select("case_id", F.col("entity_id").alias("a_entity"), F.col("file").alias("a_file"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.col("method").alias("a_method"))
    by_id = nodes.join(a, (nodes["case_id"] == a["case_id"]) & (nodes["entity_id"] == a["a_entity"])).select(nodes["case_id"], "path_id", F.lit("METHOD").alias("level"))
    name = lambda c: F.substring_index(c, "/", -1)
    n = nodes.withColumn("__name", name("file"))
    by_place = n.join(a.withColumn("__name", name("a_file")), ["case_id", "__name"]).filter(
        (F.coalesce("a_start", F.lit(0)) == 0) | ((F.col("start") <= F.col("a_end")) & (F.col("a_start") <= F.col("end"))))
    placed = by_place.select("case_id", "path_id", F.when((F.coalesce("a_method", F.lit("")) != "") | (F.coalesce("a_start", F.lit(0)) != 0), "METHOD").otherwise("FILE").alias("level"))
    return by_id.unionByName(placed).groupBy("case_id", "path_id").agg(F.max("level").alias("level"))


def choose_target(hints: DataFrame, callables: DataFrame, calls: DataFrame) -> DataFrame:
    """Per hint the best callable with parameters and an argument-bearing call, and its first such call.

    Score: equal name 100, equal file or base name 50, hint line inside 30, parameters up to 9. Hints that say the same are one
    class. A class belongs to the groups of its project, its name, its base name and both, as callables do. Whatever scores
    best has most parameters either among a group's callables that hold the line, or in the whole group; so each distinct
    line of a group keeps one that holds it and the two richest that start nearest to it, and neither hints nor lines of a
    frequent name ever meet every callable of that name.
    ``hints(case_id, project, name, file, line)``, ``callables(project, entity_id, name, file, start, end, params)``,
    ``calls(entity_id, call_id, line, args)``.
    """
    first_call = calls.filter("args > 0").groupBy("entity_id").agg(F.min(F.struct(F.col("line"), F.col("call_id"))).alias("call"))
    usable = callables.filter("params > 0").join(first_call, "entity_id")
    base = lambda c: F.substring_index(F.col(c), "/", -1)
    said = ["project", "h_name", "h_base", "h_line"]
    h = hints.select("case_id", "project", F.col("name").alias("h_name"), base("file").alias("h_base"), F.coalesce("line", F.lit(0)).alias("h_line"))
    k = stored(h.select(*said).distinct().withColumn("class", F.monotonically_increasing_id()))
    attributes = ["entity_id", "name", "base", "start", "end", "params", "call"]
    c = stored(usable.withColumn("base", base("file")).select("project", *attributes))
    few = F.least("params", F.lit(9))
    group = ["project", "by", "g_name", "g_base"]

    def grouped(df: DataFrame, name: str, base_: str) -> DataFrame:
        """A row per group; a missing name matches nothing, so it opens no group."""
        kinds = F.array(*[F.struct(F.lit(i).alias("by"), (F.col(name) if n else F.lit("")).alias("g_name"), (F.col(base_) if b else F.lit("")).alias("g_base")) for i, (n, b) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1)))])
        return df.select("*", F.explode(kinds).alias("g")).select("*", "g.*").drop("g").filter("g_name IS NOT NULL AND g_base IS NOT NULL")

    asked = grouped(k, "h_name", "h_base")
    lines = asked.select(*group, "h_line").distinct()
    members = grouped(c, "name", "base")
    # Of callables that hold a line, more parameters win, then the nearest start.
    held = points_in_spans(lines.filter("h_line > 0"), members, group, "h_line").groupBy(*group, "h_line").agg(
        F.max(F.struct(few.alias("few"), "start", "entity_id", "call", "name", "base", "end", "params")).alias("x"))
    held = held.select(*group, "h_line", F.struct(*[F.col("x")[a].alias(a) for a in attributes]).alias("x"))
    most = members.groupBy(*group).agg(F.max(few).alias("__most"))
    richest = members.join(most, group).filter(few == F.col("__most")).groupBy(*group, "start").agg(
        F.max(F.struct("entity_id", "call", "name", "base", "start", "end", "params")).alias("x"))
    richest = richest.select(*group, "start", F.struct(*[F.col("x")[a].alias(a) for a in attributes]).alias("x"))
    # A line of nought has no nearest start: the first one of the group counts.
    place = F.when(F.col("h_line") > 0, F.col("h_line")).otherwise(F.lit(-(1 << 31))).cast("long")
    points = richest.select(*group, F.col("start").cast("long").alias("at"), "x", F.lit(None).cast(dict(k.dtypes)["h_line"]).alias("h_line"), F.lit(0).alias("asks")).unionByName(
        lines.select(*group, place.alias("at"), F.lit(None).cast(dict(richest.dtypes)["x"]).alias("x"), "h_line", F.lit(1).alias("asks")))
    order = W.partitionBy(*group).orderBy("at", "asks")
    near = points.select(*group, "h_line", "asks", F.array(
        F.last("x", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.first("x", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))).alias("two"))
    near = near.filter("asks = 1").select(*group, "h_line", F.explode("two").alias("x")).filter("x IS NOT NULL")
    scored = asked.join(held.unionByName(near), [*group, "h_line"]).select(*said, "class", *[F.col("x")[a].alias(a) for a in attributes]).withColumn(
        "score",
        F.when(F.col("h_name") == F.col("name"), 100).otherwise(0) + F.when(F.col("h_base") == F.col("base"), 50).otherwise(0)
        + F.when((F.col("h_line") > 0) & F.col("h_line").between(F.col("start"), F.col("end")), 30).otherwise(0) + few)
    away = F.when(F.col("h_line") > 0, -F.abs(F.col("start") - F.col("h_line"))).otherwise(0)
    best = F.max(F.struct("score", away.alias("away"), (-F.col("start")).alias("early"), "entity_id", "call")).alias("best")
    told = scored.groupBy("class").agg(best).join(k, "class").select(*[F.col(x).alias(f"k_{x}") for x in said], "best")
    same = [F.col(x).eqNullSafe(F.col(f"k_{x}")) for x in said]
    return h.distinct().join(told, same[0] & same[1] & same[2] & same[3]).groupBy("case_id").agg(F.max("best").alias("best")).select(
        "case_id", "best.entity_id", "best.score", F.col("best.call.call_id").alias("call_id"))
