"""URL filtering by association rules: FP-growth mines token combinations from labelled urls, an inverted index matches them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import ascii_lower, store

#: Fixed values: (host, path, verdict) of the rules that decide by themselves.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule as ``struct(rule, verdict)`` whose host is the url's or a parent of it and whose path begins the url's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: scheme, host labels by depth from the right, path pieces, and names of query keys."""
    labels = F.transform(F.filter(F.reverse(F.split(host, r"\.")), lambda x: x != ""), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    pieces = F.transform(F.filter(F.split(ascii_lower(path), r"[/._-]"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), ascii_lower(F.substring_index(x, "=", 1))))
    scheme = F.array(F.concat(F.lit("s:"), ascii_lower(F.substring_index(url, "://", 1))))
    tokens = F.array_distinct(F.concat(scheme, labels, pieces, keys))
    return F.when(host != "", tokens).otherwise(F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """``rule_id, verdict, tokens, n_tokens, confidence, support`` from ``labelled(tokens, verdict)``.

    A rule says: a url with all ``tokens`` has ``verdict``. Rules below either bound are pruned, and so are rules that
    a rule with fewer of their tokens, the same verdict and no less confidence makes idle.
    """
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent")[0].startswith("verdict:"))
    found = found.where(~F.exists("antecedent", lambda x: x.startswith("verdict:")))
    found = store(found.select(
        F.sort_array("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 9, 1000).alias("verdict"),
        F.size("antecedent").alias("n_tokens"), "confidence", "support",
    ))
    # Every part of a rule's tokens that is a rule itself stands under the part's rarest token, so a rule looks there only.
    rarity = found.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    short = _by_rarest(found, rarity, "tokens", "verdict", "confidence").select(
        "token", F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("as_sure"))
    idle = (
        found.select("tokens", "verdict", "n_tokens", "confidence", F.explode("tokens").alias("token")).join(short, ["token", "verdict"])
        .where((F.size("part") < F.col("n_tokens")) & (F.col("as_sure") >= F.col("confidence")))
        .where(F.size(F.array_except("part", "tokens")) == 0).select("tokens", "verdict").distinct()
    )
    kept = found.join(idle, ["tokens", "verdict"], "left_anti")
    return kept.withColumn("rule_id", F.concat_ws(" ", F.concat_ws(" ", "tokens"), F.lit("=>"), "verdict"))


def _by_rarest(rules: DataFrame, rarity: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``rules(tokens, verdict, ...)`` with the ``token`` that ``rarity(token, n)`` counts least often, the smaller of equals."""
    each = rules.select(*dict.fromkeys(["tokens", "verdict", *columns]), F.explode("tokens").alias("token")).join(rarity, "token")
    least = each.groupBy("tokens", "verdict").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    return least.join(rules.select(*dict.fromkeys(["tokens", "verdict", *columns])), ["tokens", "verdict"])


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, rule_id, verdict, confidence, support, n_tokens`` for every rule all of whose tokens are in ``urls(url, tokens)``.

    The inverted index holds each rule under the one of its tokens that fewest urls have; only urls with that token meet the
    rule and compare the other tokens, so a token that all urls share costs nothing but for rules that have no other.
    """
    rarity = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = _by_rarest(rules, rarity, "rule_id", "confidence", "support", "n_tokens").withColumnRenamed("tokens", "needed")
    met = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return met.where(F.size(F.array_except("needed", "tokens")) == 0).select("url", "rule_id", "verdict", "confidence", "support", "n_tokens")


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
    min_support: float = 0.01, min_confidence: float = 0.8,
) -> DataFrame:
    """Per row of ``pages``: ``page_id, host, path, rule, verdict, mined_rule, confidence``.

    ``rule`` is the longest of ``rules`` that fits; its verdict stands. Urls with a rule are the labels FP-growth learns
    from, one basket per page. For the others the matching mined rule of greatest confidence decides, then of greatest
    support, of more tokens, of smaller text; without any, ``default``.

    Defined cases: a null url or one without ``://`` has an empty host and path, no tokens and the default verdict; equal
    urls get equal verdicts and repeated rows their own; null ids stay; without labelled pages nothing is mined.
    """
    url = F.col("url")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    base = base.select("page_id", "url", url_host(url).alias("host"), url_path(url).alias("path"))
    base = base.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    tokens = url_tokens(url, F.col("host"), F.col("path")).alias("tokens")
    labelled = base.where("fit IS NOT NULL").select(tokens, F.col("fit.verdict").alias("verdict"))
    mined = store(mine_rules(labelled, min_support, min_confidence))
    urls = base.where("fit IS NULL AND url IS NOT NULL").select("url", tokens).distinct()
    best = matched_rules(urls, mined).groupBy("url").agg(
        F.max(F.struct("confidence", "support", "n_tokens")).alias("top"),
        F.max_by(F.struct("verdict", "rule_id"), F.struct("confidence", "support", "n_tokens", "rule_id")).alias("chosen"),
    )
    joined = base.join(best, (F.col("fit").isNull()) & (base["url"] == best["url"]), "left")
    return joined.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "chosen.verdict", F.lit(default)).alias("verdict"),
        F.col("chosen.rule_id").alias("mined_rule"), F.col("top.confidence").alias("confidence"),
    )
