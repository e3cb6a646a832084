"""Request journals: settlement, budgets, chains of hashes, lanes, latency and tool reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.scalars import rate
from pathloom.operators.skew import first_by, prefix_scan, prefix_sum, top_k
from pathloom.session import cut_lineage


def settle(starts: DataFrame, responses: DataFrame, outcomes: DataFrame, key: str = "request_key") -> DataFrame:
    """One row per started request: its settled tokens, or its open reserve, and how it ended."""
    answered = responses.groupBy(key).agg(
        F.max("total_tokens").alias("total_tokens"), (F.count(F.lit(1)) > 1).alias("duplicate_response"), F.lit(True).alias("__r"))
    ended = outcomes.groupBy(key).agg(F.min("outcome").alias("outcome"), (F.min("outcome") != F.max("outcome")).alias("conflict"))
    begun = first_by(starts, [key], ["seq"])
    repeated = starts.groupBy(key).agg((F.count(F.lit(1)) > 1).alias("duplicate_start"))
    rows = begun.join(repeated, key).join(answered, key, "left").join(ended, key, "left")
    settled = F.coalesce(F.col("total_tokens") >= 0, F.lit(False))
    replied = F.coalesce("__r", F.lit(False))
    return rows.select(
        *begun.columns, "outcome",
        F.when(settled, F.col("total_tokens")).otherwise(0).alias("reported_tokens"),
        F.when(~settled, F.col("reserved_tokens")).otherwise(0).alias("open_reserve"),
        settled.alias("settled"), (~settled & F.col("outcome").isNull()).alias("active"),
        (~replied & F.col("outcome").isNotNull()).alias("quarantined"),
        (~replied & F.coalesce(F.col("outcome") == "FAILED_HTTP", F.lit(False))).alias("failed_http"),
        "duplicate_start", F.coalesce("duplicate_response", F.lit(False)).alias("duplicate_response"),
        F.coalesce("conflict", F.lit(False)).alias("conflict"),
    )


# How a request can fail for good.
OUTCOMES = ("FAILED_HTTP", "UNKNOWN_QUARANTINED")


def faults(starts: DataFrame, responses: DataFrame, outcomes: DataFrame, key: str = "request_key") -> DataFrame:
    """``key, fault`` for every request whose journal cannot be settled without guessing."""
    repeated = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, F.lit(name).alias("fault"))
    several = outcomes.groupBy(key).agg(F.min("outcome").alias("a"), F.max("outcome").alias("b"), F.bool_and(F.col("outcome").isin(*OUTCOMES)).alias("known"))
    return (
        repeated(starts, "DUPLICATE_START").unionByName(repeated(responses, "DUPLICATE_RESPONSE"))
        .unionByName(several.filter("a <> b").select(key, F.lit("CONFLICTING_OUTCOMES").alias("fault")))
        .unionByName(several.filter(~F.coalesce("known", F.lit(False))).select(key, F.lit("INVALID_OUTCOME").alias("fault")))
        .unionByName(several.join(starts, key, "left_anti").select(key, F.lit("OUTCOME_WITHOUT_START").alias("fault")))
    )


def accounting(settled: DataFrame, by: Sequence[str], historical: DataFrame | None = None, key: str = "request_key") -> DataFrame:
    """Totals of settled requests; ``historical(key, by...)`` are requests set aside in earlier runs, counted once each."""
    totals = settled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("physical_requests"), F.sum("reported_tokens").alias("reported_tokens"),
        F.sum("open_reserve").alias("unsettled_reserved_tokens"), F.count_if(~F.col("settled")).alias("unsettled_requests"),
        F.count_if("active").alias("active_unsettled_requests"), F.count_if("quarantined").alias("quarantined_requests"),
        F.count_if("failed_http").alias("failed_http_requests"),
        F.count_if(F.col("quarantined") & ~F.col("failed_http")).alias("unknown_quarantined_requests"),
    )
    name = "historical_quarantined_requests"
    if historical is None:
        return totals.withColumn(name, F.lit(0).cast("long"))
    aside = historical.select(*by, key).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    keyed = list(by) or ["__all"]
    one = (lambda df: df) if by else (lambda df: df.withColumn("__all", F.lit(0)))
    joined = one(totals).join(one(aside), keyed, "full")
    return joined.fillna(0, [c for c in joined.columns if c not in by]).drop("__all")


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], parts: int = 100, most: int = 100_000) -> DataFrame:
    """Exact nearest-rank percentiles per key, without ordering a whole key in one task.

    Equal values are counted first. While the bracket of a wanted rank holds more than ``most`` distinct values, a quantile
    sketch cuts it into ``parts`` pieces of about as many values, whatever their spread; exact counts tell the piece that
    holds the rank. Only the values of the last bracket are ordered.
    """
    keys = list(keys)
    by = [*keys, "name"]
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__m"))
    sizes = counted.groupBy(*keys).agg(F.sum("__m").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    ranks = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.col("__n") * F.lit(frac)), F.lit(1)).alias("rank")) for name, frac in fractions.items()])).alias("__r")
    wanted = sizes.select(*keys, "__low", "__high", ranks).select(*keys, "__r.name", "__r.rank", "__low", "__high", F.lit(0).cast("long").alias("__below"))
    bracket = lambda w: counted.join(w, keys).filter(F.col("__v").between(F.col("__low"), F.col("__high")))
    held = bracket(wanted)
    while not held.groupBy(*by).count().filter(F.col("count") > most).isEmpty():
        cuts = F.percentile_approx("__v", [i / parts for i in range(1, parts)], 10 * parts).alias("__cuts")
        piece = F.size(F.filter("__cuts", lambda c: c < F.col("__v")))
        placed = held.join(held.groupBy(*by).agg(cuts), by).groupBy(*by, "rank", "__below", piece.alias("__p")).agg(
            F.sum("__m").alias("__s"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        upto = placed.withColumn("__upto", F.col("__below") + F.sum("__s").over(W.partitionBy(*by).orderBy("__p"))).withColumn("__before", F.col("__upto") - F.col("__s"))
        wanted = cut_lineage(upto.filter((F.col("__before") < F.col("rank")) & (F.col("rank") <= F.col("__upto"))).select(*by, "rank", "__low", "__high", F.col("__before").alias("__below")))
        held = bracket(wanted)
    within = held.withColumn("__upto", F.col("__below") + F.sum("__m").over(W.partitionBy(*by).orderBy("__v")))
    best = within.filter(F.col("__upto") >= F.col("rank")).groupBy(*by).agg(F.min("__v").alias("__v"))
    return best.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.round("__v", 6))).alias(name) for name in fractions])


def latency(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    keys = list(keys)
    basic = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg(value), 6).alias("avg"), F.round(F.max(value), 6).alias("max"))
    return basic.join(nearest_rank(df, keys, value, {"p50": 0.5, "p95": 0.95}), keys)


def tool_report(calls: DataFrame) -> DataFrame:
    """Per tool and over all (tool ``*``): status counts, success and truncation rates, latency. The totals add up the tools'."""
    by_tool = calls.groupBy("tool").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(F.col("status") == "EMPTY").alias("empty"),
        F.count_if(F.col("status") == "ERROR").alias("error"), F.count_if("truncated").alias("cut"))
    sums = ("n", "ok", "empty", "error", "cut")
    total = by_tool.groupBy(F.lit("*").alias("tool")).agg(*[F.sum(c).alias(c) for c in sums])
    base = by_tool.unionByName(total).select(
        "tool", "ok", "empty", "error", F.round((F.col("ok") + F.col("empty")) / F.col("n"), 6).alias("success_rate"), F.round(F.col("cut") / F.col("n"), 6).alias("truncation_rate"))
    times = calls.select("tool", "seconds")
    return base.join(latency(times, ["tool"], "seconds").unionByName(latency(times.withColumn("tool", F.lit("*")), ["tool"], "seconds")), "tool")


def failure_reasons(calls: DataFrame) -> DataFrame:
    return calls.filter("status = 'ERROR'").groupBy(F.coalesce("reason", F.lit("UNKNOWN")).alias("reason")).agg(F.count(F.lit(1)).alias("count"))


def rollup(statuses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """SUCCESS when every row is, PARTIAL when some are, else FAILED."""
    good, n = F.count_if(F.col("status") == "SUCCESS"), F.count(F.lit(1))
    word = F.when((n > 0) & (good == n), "SUCCESS").when(good > 0, "PARTIAL").otherwise("FAILED")
    return statuses.groupBy(*by).agg(n.alias("total"), good.alias("successes"), word.alias("status"))


def run_report(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums over the successful projects; and the failures as rows."""
    good = F.col("status") == "SUCCESS"
    summary = rows.agg(
        F.count_if(good).alias("projects_success"), F.count_if(~good).alias("projects_failed"),
        F.coalesce(F.sum(F.when(good, F.col("alert_count"))), F.lit(0)).alias("baseline_alerts"),
        F.coalesce(F.sum(F.when(good, F.col("path_count"))), F.lit(0)).alias("baseline_paths"))
    return summary, rows.filter(~good)


def merge_report(detector: DataFrame, coverage: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: detector and coverage totals with the candidate expansion factor, NULL without baseline paths."""
    paths = baseline.agg(F.coalesce(F.sum(F.when(F.col("status") == "SUCCESS", F.col("path_count"))), F.lit(0)).alias("baseline_paths"))
    # Totals are one row each, also if a caller's table has more; they meet on one key.
    row = lambda df: df.agg(*[F.max(c).alias(c) for c in df.columns]).withColumn("__one", F.lit(1))
    joined = row(detector).join(row(coverage), "__one").join(row(paths), "__one").drop("__one")
    return joined.withColumn("expansion_factor", rate(F.col("candidate_paths"), F.nullif(F.col("baseline_paths"), F.lit(0))))


def verify_chain(events: DataFrame, chain: Sequence[str], seq: str, body: Column, previous: str, digest: str) -> DataFrame:
    """Faults in a hash chain: wrong body hash, broken link, or a hole in the sequence. Links are an equi-join on seq - 1."""
    chain = list(chain)
    prior = events.select(*chain, (F.col(seq) + 1).alias(seq), F.col(digest).alias("__prior"))
    starts = events.groupBy(*chain).agg(F.min(seq).alias("__first")) if chain else events.agg(F.min(seq).alias("__first"))
    joined = events.join(prior, [*chain, seq], "left").join(F.broadcast(starts) if not chain else starts, chain or None)
    first = F.col(seq) == F.col("__first")
    hash_ok = F.sha2(body, 256) == F.col(digest)
    link_ok = F.when(first, F.col(previous) == "").otherwise(F.coalesce(F.col(previous) == F.col("__prior"), F.lit(False)))
    dense = first | F.col("__prior").isNotNull()
    return joined.select(*chain, seq, hash_ok.alias("hash_ok"), link_ok.alias("link_ok"), dense.alias("dense")).filter(
        ~(F.col("hash_ok") & F.col("link_ok") & F.col("dense")))


def prefix_reuse(new: DataFrame, old: DataFrame, runs: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """Longest exact shared prefix of each (new run, old run) pair: the first position that differs ends it."""
    n = new.select(F.col(key).alias("new_run"), F.col(position).alias("__p"), F.col(value).alias("__new"))
    o = old.select(F.col(key).alias("old_run"), F.col(position).alias("__p"), F.col(value).alias("__old"))
    wanted = runs.select("new_run", "old_run").distinct()
    pairs = wanted.join(n, "new_run").join(o, ["old_run", "__p"], "left")
    differs = F.min(F.when(F.col("__old").isNull() | (F.col("__old") != F.col("__new")), F.col("__p")))
    return pairs.groupBy("new_run", "old_run").agg(F.coalesce(differs, F.max("__p") + 1).cast("long").alias("prefix"))


def admit_budget(requests: DataFrame, keys: Sequence[str], seq: str, reserve: str, limit: int, max_requests: int) -> DataFrame:
    """Admit in order while the reserve sum stays within ``limit`` and the count within ``max_requests``.

    Reserves are not negative, so both running values only grow: the first refusal refuses the rest.
    """
    running = prefix_scan(requests, keys, [seq], {"used": F.col(reserve), "position": F.lit(1)})
    return running.withColumn("admitted", (F.col("used") <= limit) & (F.col("position") <= max_requests))


def lane_order(tasks: DataFrame, lanes: Sequence[str], seq: str) -> DataFrame:
    """Round robin over lanes: ``turn`` is a task's place in its lane; (turn, lane) is the dispatch order."""
    return prefix_sum(tasks, lanes, seq, F.lit(1), "turn")


def fit_budget(records: DataFrame, keys: Sequence[str], priority: str, size: Column, limit: int) -> DataFrame:
    """Keep whole records in priority order while their summed size fits; the rest are listed as dropped.

    Records of one priority follow their other columns from left to right.
    """
    return prefix_sum(records, keys, priority, size, "bytes_so_far").withColumn("kept", F.col("bytes_so_far") <= limit)


def pack(rows: DataFrame, project: str, seq: str, entry: str, size: str, start: int, limit: int) -> DataFrame:
    """Number each ``entry`` by first appearance in its project, and include details in order up to a size.

    Entries that first appear at one place are numbered by their value; rows of one place follow their other columns. Both
    the numbers and the sums are scans in slices, so one project may hold most rows.
    """
    firsts = rows.groupBy(project, entry).agg(F.min(seq).alias("__first"))
    index = prefix_scan(firsts, [project], ["__first"], {"entry_index": F.lit(1)}).select(project, entry, (F.col("entry_index") - 1).cast("int").alias("entry_index"))
    summed = prefix_sum(rows, [project], seq, size, "__sum")
    return summed.join(index, [project, entry]).withColumn("detailed", F.col("__sum") + start <= limit).drop("__sum")


def reserve_plan(pending: DataFrame, cached: DataFrame, run: str, seq: str, reserve: str, batch: int = 4) -> DataFrame:
    """Pending rows in batches of ``batch`` per run; a batch already cached holds no reserve."""
    placed = prefix_sum(pending, [run], seq, F.lit(1), "__pos").withColumn("batch", F.floor((F.col("__pos") - 1) / batch))
    batches = placed.groupBy(run, "batch").agg(F.count(F.lit(1)).alias("candidates"), F.sum(reserve).alias("estimate"))
    known = cached.select(run, "batch").distinct().withColumn("__c", F.lit(True))
    held = F.coalesce("__c", F.lit(False))
    return batches.join(known, [run, "batch"], "left").select(
        run, "batch", "candidates", held.alias("cached"), F.when(held, 0).otherwise(1).alias("held_requests"),
        F.when(held, 0).otherwise(F.col("estimate")).alias("held_tokens"))


def provenance(subs: DataFrame) -> DataFrame:
    """Per candidate: contributing roles (a bounded vocabulary) and counts of distinct exact paths and submissions."""
    paths = subs.select("candidate_id", "path").distinct().groupBy("candidate_id").agg(F.count(F.lit(1)).alias("exact_paths"))
    sends = subs.select("candidate_id", "submission").distinct().groupBy("candidate_id").agg(F.count(F.lit(1)).alias("submissions"))
    roles = subs.groupBy("candidate_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return roles.join(paths, "candidate_id").join(sends, "candidate_id")


def ledger_state(facts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Latest verdict per segment: the fact's own status unless a later review confirms or refutes it."""
    status = F.when(F.col("verdict") == "SUPPORTED", "VERIFIER_CONFIRMED").when(F.col("verdict") == "REJECTED", "VERIFIER_REFUTED")
    last = reviews.withColumn("__s", status).filter("__s IS NOT NULL").groupBy("segment").agg(F.max_by("__s", "seq").alias("__last"))
    own = first_by(facts, ["segment"], ["seq"])
    joined = own.join(last, "segment", "left")
    final = F.coalesce("__last", F.when(F.col("relation") == "static_value_hop", "STATIC_MAY_FLOW").otherwise("SOURCE_GROUNDED_PENDING_REVIEW"))
    return joined.select("segment", "relation", final.alias("status"))


def lookup_history(keys: DataFrame, records: DataFrame, on: Sequence[str]) -> DataFrame:
    """Earliest record with the same full identity; a legacy key with more than one body is never reused."""
    clear = records.select("key", "body_hash").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("key")
    best = first_by(records.join(clear, "key", "left_semi"), list(on), ["created", "payload"])
    return keys.select(*on).distinct().join(best, list(on)).select(*on, "created", "payload")


def score_cases(metrics: DataFrame) -> DataFrame:
    """F2 and the outcome class per case from precision, recall and prediction count."""
    p, r = F.col("precision"), F.col("recall")
    weight = 4 * p + r
    return metrics.select(
        "*", F.when(p.isNotNull() & r.isNotNull(), F.when(weight > 0, F.round(5 * p * r / weight, 6)).otherwise(0.0)).alias("f2"),
        F.when(r > 0, "DETECTED").when(F.col("predictions") > 0, "VERIFIED_PATH_LABEL_MISS").otherwise("NO_VERIFIED_CANDIDATE").alias("classification"))


# Reference rates in US dollars per prompt and completion token.
PROMPT_RATE, COMPLETION_RATE = 0.000002, 0.000010


def usage_cost(prompt: Column, completion: Column) -> Column:
    return F.round(F.coalesce(prompt, F.lit(0)) * PROMPT_RATE + F.coalesce(completion, F.lit(0)) * COMPLETION_RATE, 8)


def audit_cases(cases: DataFrame, requests: DataFrame, candidates: DataFrame, methods: DataFrame, hits: DataFrame) -> DataFrame:
    """Per case: request totals, candidate counts, and the earliest stage that failed."""
    reqs = requests.groupBy("case_id").agg(
        F.count_if(F.col("event") == "request_started").alias("requests"),
        F.coalesce(F.sum(F.when(F.col("event") == "response", F.col("charged_tokens"))), F.lit(0)).alias("tokens"),
        (F.count_if(F.col("event") == "request_started") - F.count_if(F.col("event") == "response")).alias("unsettled"))
    cands = candidates.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("retained").alias("retained"), F.count_if("verified").alias("strict_verified"))
    read = methods.groupBy("case_id").agg(F.bool_and("recalled").alias("__read"))
    hit = hits.groupBy("case_id").agg(F.bool_or("any_hit").alias("__any"), F.bool_or("retained_hit").alias("__kept"))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rows = cases.join(reqs, "case_id", "left").join(cands, "case_id", "left").join(read, "case_id", "left").join(hit, "case_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        *cases.columns, *[zero(c) for c in ("requests", "tokens", "unsettled", "candidates", "retained", "strict_verified")],
        F.when(no("__read"), "RETRIEVAL").when(no("__any"), "CANDIDATE_CONSTRUCTION").when(no("__kept"), "STRICT_VERIFICATION_FILTER")
        .otherwise("DETECTED").alias("earliest_failure"))


def case_status(steps: DataFrame, facts: DataFrame, cases: DataFrame) -> DataFrame:
    """Verdict per case from ordered steps and the latest guard and sanitizer effects.

    ``steps(case_id, pos, kind)``, ``facts(case_id, seq, type, effect, checked)``, ``cases(case_id, seed_kind)``.
    """
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("pos")))
    spine = steps.groupBy("case_id").agg(
        first("SOURCE").alias("src"), first("SINK").alias("snk"),
        F.bool_or(F.col("kind") == "SANITIZER").alias("need_s"), F.bool_or(F.col("kind") == "GUARD").alias("need_g"))
    effect = F.replace(F.lower(F.trim("effect")), F.lit("-"), F.lit("_"))
    known = facts.withColumn("type", F.lower("type")).withColumn("effect", effect).filter(
        F.col("type").isin("sanitizer_result", "guard_condition")
        & F.col("effect").isin("blocks", "bypassed", "not_dominating", "not_applicable", "unknown"))
    strict = F.when((F.col("effect") == "blocks") & ~F.coalesce("checked", F.lit(False)), "unknown").otherwise(F.col("effect"))
    last = lambda kind: F.max_by(F.when(F.col("type") == kind, strict), F.when(F.col("type") == kind, F.col("seq")))
    latest = known.groupBy("case_id").agg(last("sanitizer_result").alias("eff_s"), last("guard_condition").alias("eff_g"))
    j = cases.join(spine, "case_id", "left").join(latest, "case_id", "left")
    false = F.lit(False)
    need_s = F.coalesce("need_s", false) | (F.col("seed_kind") == "SANITIZER") | F.col("eff_s").isNotNull()
    need_g = F.coalesce("need_g", false) | (F.col("seed_kind") == "CONTROL_POINT") | F.col("eff_g").isNotNull()
    ok = lambda e: F.coalesce(F.col(e).isin("bypassed", "not_dominating", "not_applicable"), false)
    blocking = (F.col("eff_s") == "blocks") | (F.col("eff_g") == "blocks")
    closed = (~need_s | ok("eff_s")) & (~need_g | ok("eff_g"))
    ordered = F.coalesce(F.col("src") < F.col("snk"), false)
    return j.select(
        "case_id", F.when(F.coalesce(blocking, false), "DEAD_END").when(ordered & closed, "CONFIRMED").otherwise("EXPLORING").alias("status"),
        F.coalesce("eff_s", F.lit("")).alias("sanitizer_effect"), F.coalesce("eff_g", F.lit("")).alias("guard_effect"))
