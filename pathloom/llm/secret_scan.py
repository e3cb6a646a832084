"""Secret scan with corpus-wide ownership frequency.

Every candidate value found is hashed; the hashes are counted by distinct repositories and owners over the whole corpus.
A value that several owners hold is a copied example; one that a single owner holds looks live, and its places are
added to the spans. All steps are DataFrame functions; only documents with candidates are shuffled, without their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import store
from pathloom.llm.spans import matches, starts
from pathloom.operators.skew import pin

#: Fixed patterns. assign: group 2 holds the value, of at least 6 characters, and a shorter one uses its match up.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: For these two a run that is long enough and the long enough matches of any run are the same.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates beyond the base kinds: long unbroken runs with both letters and digits.
OPAQUE = r"[A-Za-z0-9+/_-]{32,}"

SPAN = "struct<start:int,kind_no:int,kind:string,end:int>"
CANDIDATE = "struct<start:int,end:int,hash:string>"
HELD = "struct<start:int,end:int,repositories:bigint,owners:bigint>"


def _span(kind_no: int, kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"), end.alias("end"))


def _candidate(start: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), F.sha2(value, 256).alias("hash"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_candidates(docs: DataFrame) -> DataFrame:
    """``base`` spans and ``candidates`` (place and hash of each value) of ``docs(text, ...)``; ``text`` goes."""
    kept = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")

    # Letters that a pattern cannot do without are looked for first, as that costs far less.
    needs = {ASSIGN: text.contains("=") | text.contains(":"), ACCESS: text.contains("AKIA"), HEX: F.lit(True), OPAQUE: F.rlike(text, F.lit("[0-9]"))}

    def where(pattern: str, value: Column) -> Column:
        return F.when(needs[pattern] & F.rlike(text, F.lit(pattern)), value).otherwise(none)

    kinds = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "opaque": OPAQUE}
    raw = {f"m_{k}": where(p, matches(text, p)) for k, p in kinds.items()} | {f"s_{k}": where(p, F.split(text, p, -1)) for k, p in kinds.items()}
    found = pin(docs, v_assign=where(ASSIGN, matches(text, ASSIGN, 2)), **raw).drop("text")
    places = {f"at_{k}": F.when(F.size(f"m_{k}") > 0, starts(F.col(f"m_{k}"), F.col(f"s_{k}"))).otherwise(F.array().cast("array<int>")) for k in kinds}
    found = pin(found, **places).select(*kept, *[f"{a}_{k}" for k in kinds for a in ("m", "at")], "v_assign")
    zipped = lambda k: F.arrays_zip(F.col(f"at_{k}").alias("at"), F.col(f"m_{k}").alias("m"), *([F.col("v_assign").alias("v")] if k == "assign" else []))
    assign = F.filter(zipped("assign"), lambda x: F.length(x["v"]) >= ASSIGN_LEAST)
    opaque = F.filter(zipped("opaque"), lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))
    end = lambda x: x["at"] + F.length(x["m"])
    base = F.concat(
        F.transform(assign, lambda x: _span(0, "assign", x["at"], end(x))),
        F.transform(zipped("access"), lambda x: _span(1, "access", x["at"], end(x))),
        F.transform(zipped("hex"), lambda x: _span(2, "hex", x["at"], end(x))),
    )
    whole = lambda x: _candidate(x["at"], x["m"])
    candidates = F.array_distinct(F.concat(
        F.transform(assign, lambda x: _candidate(end(x) - F.length(x["v"]), x["v"])),
        F.transform(zipped("access"), whole), F.transform(zipped("hex"), whole), F.transform(opaque, whole),
    ))
    return pin(found, base=base.cast(f"array<{SPAN}>"), candidates=candidates.cast(f"array<{CANDIDATE}>")).select(*kept, "base", "candidates")


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, repositories, owners``: distinct holders of each value in ``candidates(hash, repository, owner)``."""
    held = candidates.select("hash", "repository", "owner").distinct()
    by_repository = held.select("hash", "repository").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    by_owner = held.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    return by_repository.join(by_owner, "hash")


def secret_scan(
    docs: DataFrame, repository: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text", most_owners: int = 1,
    most_repositories: int = 2,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base, spans, n_live, n_copied, held``.

    ``base``: spans of the three fixed kinds, start and end in code points, end exclusive, leftmost and non-overlapping
    within a kind. Candidates are the base values and long mixed runs; one held by at most ``most_owners`` owners
    in at most ``most_repositories`` repositories is live, and its place joins ``spans`` as kind ``live``; others are copied.
    ``held`` lists the candidates as ``start, end, repositories, owners``, the distinct holders of the value in the whole
    corpus. ``repository`` and ``owner`` are columns over ``docs``.

    Defined cases: a null text is empty and has no spans; null repositories and owners count as one nameless holder;
    null ids stay; repeated rows each get their result and count as one holder; no rows give no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.col(text_col).cast("string").alias("text"),
    )
    scanned = store(find_candidates(rows).withColumn("row_no", F.monotonically_increasing_id()))
    each = scanned.where(F.size("candidates") > 0).select("row_no", "repository", "owner", F.inline("candidates"))
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    judged = each.join(ownership(each), "hash").withColumn("live", live).groupBy("row_no").agg(
        F.collect_set(F.when(F.col("live"), _span(3, "live", F.col("start"), F.col("end")))).alias("added"),
        F.sum(F.col("live").cast("long")).alias("n_live"), F.sum((~F.col("live")).cast("long")).alias("n_copied"),
        F.sort_array(F.collect_set(F.struct("start", "end", "repositories", "owners"))).alias("held"),
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.join(judged, "row_no", "left").select(
        "doc_id", count("assign"), count("access"), count("hex"), spans_text(F.col("base")).alias("base"),
        spans_text(F.concat("base", F.coalesce(F.col("added").cast(f"array<{SPAN}>"), F.array().cast(f"array<{SPAN}>")))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce(F.col("held").cast(f"array<{HELD}>"), F.array().cast(f"array<{HELD}>")).alias("held"),
    )
