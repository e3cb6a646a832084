"""Text jobs over file tables: lines, search, bounded reads, masking, lexical entities, resource references."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.scalars import let, snippet, stable_id
from pathloom.operators.entities import mask
from pathloom.operators.intervals import innermost, points_in_spans
from pathloom.operators.skew import first_by, pin, top_k
from pathloom.session import cut_lineage

# Fixed value: the characters that end a line.
LINE_END = "[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029](?:(?<=\r)\n)?"
# One class of small letters, which a text is searched for quickly; without them and two more only the plain end counts.
RARE_END = "[\r\u000b\u000c\u001c\u001d\u001e\u0085]"


def line_array(text: Column) -> Column:
    """Lines of a text without their ends; a final line end opens no further line."""
    rare = text.rlike(RARE_END) | text.contains("\u2028") | text.contains("\u2029")
    return let(F.when(rare, F.split(text, LINE_END)).otherwise(F.split(text, "\n")), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row per line: ``path, line, text`` and the kept columns."""
    return files.select("path", *keep, F.posexplode(line_array(F.col("text"))).alias("pos", "text")).select(
        "path", *keep, (F.col("pos") + 1).alias("line"), "text")


def _starts(text: Column, needle: str) -> Column:
    """1-based starts of the non-overlapping occurrences of ``needle``, left to right."""
    size = len(needle)
    parts = F.split(text, re.escape(needle) if needle.isascii() else f"\\Q{needle}\\E", -1)
    summed = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, p: F.struct((acc["at"] + F.length(p) + size).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(p) + 1)).alias("out")))["out"]
    return let(summed, lambda a: F.slice(a, 1, F.size(a) - 1))


def search_code(files: DataFrame, needle: str, entities: DataFrame | None = None, glob: str | None = None,
                case_sensitive: bool = False, max_hits: int | None = None) -> DataFrame:
    """Every occurrence of a literal: ``path, line, column, snippet`` and the innermost entity holding its line."""
    scope = files if glob is None else files.filter(F.col("path").rlike(glob_regex(glob)))
    wanted = needle if case_sensitive else needle.lower()
    rows = lines(scope)
    compared = F.col("text") if case_sensitive else F.lower("text")
    found = rows.filter(compared.contains(wanted))
    hits = found.select("path", "line", F.explode(_starts(compared, wanted)).alias("column"), snippet(F.col("text")).alias("snippet"))
    if entities is not None:
        spans = entities.withColumnRenamed("file", "path")
        inside = points_in_spans(hits.select("path", "line").distinct(), spans, ["path"])
        nearest = inside.withColumn("span", F.col("end") - F.col("start"))
        best = first_by(nearest.select("path", "line", "span", "entity_id"), ["path", "line"], ["span", "entity_id"]).drop("span")
        hits = hits.join(best, ["path", "line"], "left")
    return hits if max_hits is None else hits.orderBy("path", "line", "column").limit(max_hits)


def glob_regex(glob: str) -> str:
    """Shell pattern as a regular expression; ``*`` also crosses folders, as in the file-name match rules."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def search_symbols(entities: DataFrame, needle: str, kind: str | None = None, prefer_declarations: bool = False, max_hits: int = 50) -> DataFrame:
    """Entities whose names or signature hold the text; optionally declarations, exact names and main code first."""
    q = needle.lower()
    text = F.lower(F.concat_ws("\n", "simple_name", "qualified_name", "signature"))
    hits = entities.filter(text.contains(q))
    if kind is not None:
        hits = hits.filter(F.col("kind") == kind)
    first = [~F.col("kind").isin("METHOD", "CONSTRUCTOR", "TYPE"), F.lower("simple_name") != q, F.concat(F.lit("/"), "file").contains("/test/")] if prefer_declarations else []
    return hits.orderBy(*first, *canonical_keys()).limit(max_hits)


def canonical_keys() -> list[Column]:
    return [F.col(c) for c in ("file", "start", "end", "kind", "qualified_name")] + [F.coalesce("signature", F.lit("")), F.col("entity_id")]


def canonical_order(entities: DataFrame) -> DataFrame:
    return entities.orderBy(*canonical_keys())


def canonical_positions(entities: DataFrame) -> DataFrame:
    """Every entity with its place ``pos`` in the canonical order: places within a sorted range, plus the ranges before."""
    keys = canonical_keys()
    ranged = entities.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id())
    held = cut_lineage(ranged.withColumn("__in", F.row_number().over(W.partitionBy("__range").orderBy(*keys))))
    sizes = held.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__range", (F.sum("n").over(W.orderBy("__range")) - F.col("n")).alias("__before"))
    return held.join(before, "__range").withColumn("pos", F.col("__before") + F.col("__in")).drop("__range", "__in", "__before")


def index_summary(entities: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Counts by entity kind, confidence and diagnostic severity, as one long table."""
    group = lambda df, col: df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count")).select(F.lit(col).alias("dimension"), "value", "count")
    return group(entities, "kind").unionByName(group(entities, "confidence")).unionByName(group(diagnostics, "severity"))


def read_ranges(files: DataFrame, requests: DataFrame, max_lines: int = 200, max_bytes: int = 65536) -> DataFrame:
    """Bounded line ranges: the text and size, or the named refusal: ``requests(request_id, path, start, end)``."""
    joined = requests.join(files.select("path", "text", F.lit(True).alias("__have")), "path", "left")
    first, last = F.col("start"), F.col("end")
    early = (
        F.when((first < 1) | (last < first), "INVALID_RANGE").when(last - first + 1 > max_lines, "LINE_LIMIT_EXCEEDED")
        .when(F.col("__have").isNull(), "FILE_UNAVAILABLE"))
    work = joined.withColumn("__early", early)
    all_lines = F.when(F.col("__early").isNull(), line_array(F.coalesce("text", F.lit(""))))
    work = work.select("request_id", "path", "start", "end", "__early", F.explode(F.array(F.struct(all_lines.alias("lines")))).alias("s"))
    total = F.size("s.lines")
    chosen = F.when(F.col("__early").isNull() & (first <= total), F.slice("s.lines", F.greatest(first, F.lit(1)), F.greatest(F.least(last, total) - first + 1, F.lit(0))))
    work = work.select("request_id", "path", "start", "end", "__early", total.alias("total"), F.explode(F.array(F.struct(chosen.alias("c")))).alias("k"))
    size = F.aggregate("k.c", F.lit(0), lambda n, x: n + F.octet_length(x) + 1)
    error = F.coalesce("__early", F.when(F.col("k.c").isNull(), "RANGE_OUT_OF_BOUNDS").when(size > max_bytes, "BYTE_LIMIT_EXCEEDED"))
    ok = error.isNull()
    return work.select(
        "request_id", "path", error.alias("error"), F.when(ok, F.array_join("k.c", "\n")).alias("text"), F.when(ok, size).alias("byte_count"),
        F.when(ok, F.least("end", "total")).alias("end_line"), F.when(ok, F.col("end") > F.col("total")).alias("truncated"))


# Fixed value: advisory ids and 40-digit hex ids.
IDS = r"(?i)CVE-[0-9]{4}-[0-9]{4,}|(?<![0-9A-Za-z_])[0-9a-f]{40}(?![0-9A-Za-z_])"


def _covered(text: Column, pattern: str) -> Column:
    """Every match as so many X as it has bytes."""
    hidden = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.repeat(F.lit("X"), F.octet_length(m)))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("code"), hidden.alias("gap"))
    return F.array_join(F.flatten(F.transform(pairs, lambda x: F.array(x["code"], F.coalesce(x["gap"], F.lit(""))))), "")


def _cover_with(pattern: str):
    return lambda text: _covered(text, pattern)


def redact(text: Column, tokens: Sequence[str] = ()) -> Column:
    """Advisory ids, 40-digit hex ids and given tokens replaced by X, byte for byte."""
    ordered = sorted({t for t in tokens if len(t.encode()) >= 3}, key=lambda t: len(t.encode()), reverse=True)
    for pattern in (IDS, *[f"(?i){re.escape(t)}" for t in ordered]):
        text = let(text, _cover_with(pattern))
    return text


def source_safe(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)CVE-\d{4}-\d+", "[identifier removed]")


def redact_report(findings: DataFrame, tokens: Sequence[str] = ()) -> DataFrame:
    """Descriptions, categories and step notes redacted; files, lines and keys kept; raw metadata dropped.

    Step notes are redacted as flat rows, then folded back in their order.
    """
    notes = findings.select("fingerprint", F.posexplode("flow").alias("pos", "n")).select(
        "fingerprint", "pos", "n.file_path", "n.line_number", redact(F.coalesce("n.description", F.lit("")), tokens).alias("description"))
    folded = notes.groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("pos", "file_path", "line_number", "description"))).alias("s"))
    flow = F.transform("s", lambda x: F.struct(x["file_path"].alias("file_path"), x["line_number"].alias("line_number"), x["description"].alias("description")))
    heads = findings.select("fingerprint", redact(F.coalesce("description", F.lit("")), tokens).alias("description"), redact(F.coalesce("category", F.lit("")), tokens).alias("category"))
    return heads.join(folded, "fingerprint", "left").select("fingerprint", "description", "category", flow.alias("flow"))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def script_references(pages: DataFrame, html: str = "html") -> DataFrame:
    """Script tags of a page: line span, number of ``src`` values and the value when there is exactly one."""
    tag = r"(?is)<script\b[^>]*>"
    parts = F.split(html, r"(?i)(?=<script\b)")
    rows = pages.select("page_id", F.posexplode(parts).alias("n", "part"), html).withColumn("tag", F.regexp_extract("part", rf"^({tag})", 1)).filter("tag <> ''")
    before = F.aggregate(F.slice(parts, 1, F.col("n")), F.lit(0), lambda acc, p: acc + _count(p, "\n"))
    sources = F.regexp_extract_all("tag", F.lit(r"""(?i)\ssrc\s*=\s*["']?([^"'\s>]*)"""), F.lit(1))
    return rows.withColumn("first", before + 1).withColumn("s", sources).select(
        "page_id", "n", "first", (F.col("first") + _count(F.col("tag"), "\n")).alias("last"), F.size("s").alias("n_src"), F.when(F.size("s") == 1, F.col("s")[0]).alias("src"))


# Markup of an XML text: comments, character data, instructions, declarations, and tags.
MARKUP = (
    r"(?s)<(?:!--.*?-->|!\[CDATA\[.*?\]\]>|\?.*?\?>|![A-Z][^\[>]*(?:\[.*?\]\s*)?>"
    r"|/?[A-Za-z_:][\w:.-]*(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*\s*/?>)")


def _attribute(name: str) -> Column:
    """Value of an attribute in a tag's own text ``attrs``, NULL without it."""
    quoted = rf"(?:^|\s){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    value = F.concat(F.regexp_extract("attrs", quoted, 1), F.regexp_extract("attrs", quoted, 2))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return F.when(F.col("attrs").rlike(quoted), value)


def mapper_entries(files: DataFrame) -> DataFrame:
    """Top-level declarations of mapper XML with their line spans, one row per reference (NULL without one).

    Texts are cut into markup in the JVM; depths, lines and entry numbers are running sums over a file's tags. Files
    whose tags do not nest, or that declare entities, give nothing. Texts are dealt by path once, and all that follows
    stays within a file; the path's hash goes before it in every order, since paths mostly begin alike.
    """
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(MARKUP), F.lit(0)).alias("tag"), F.split("text", MARKUP, -1).alias("gap"))
    file = ["hash", "path"]
    dealt = files.select(F.xxhash64("path").alias("hash"), "path", "text").repartition(*file)
    cut = dealt.select(*file, F.posexplode(zipped).alias("pos", "t")).select(*file, "pos", "t.tag", "t.gap")
    whole = W.partitionBy(*file)
    order = whole.orderBy("pos")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    tags = cut.select(
        *file, "pos", "tag", F.regexp_extract("tag", r"^</?([A-Za-z_:][\w:.-]*)", 1).alias("name"), F.col("tag").startswith("</").alias("closing"), F.col("tag").endswith("/>").alias("empty"),
        (F.col("gap").contains("<") | F.coalesce(F.col("tag").contains("<!ENTITY"), F.lit(False))).alias("bad"), _count(F.col("gap"), "\n").alias("above"), _count(F.col("tag"), "\n").alias("own"))
    real = F.coalesce(F.col("name") != "", F.lit(False))
    net = F.when(~real | F.col("empty"), 0).when(F.col("closing"), -1).otherwise(1)
    tags = tags.withColumn("net", net).select(
        *file, "pos", "tag", "name", "closing", "empty", "bad", "net", F.sum("net").over(so_far).alias("after"),
        (F.sum(F.col("above") + F.coalesce("own", F.lit(0))).over(so_far) - F.coalesce("own", F.lit(0)) + 1).cast("int").alias("line"))
    tags = tags.withColumn("level", F.when(F.col("closing"), F.col("after")).otherwise(F.col("after") - F.col("net")))
    opens = real & ~F.col("closing") & (F.col("level") == 1)
    tags = tags.withColumn("entry", F.sum(opens.cast("int")).over(so_far))
    partner = F.lag("name").over(W.partitionBy(*file, "level", real & ~F.col("empty")).orderBy("pos"))
    tags = tags.withColumn("torn", F.col("bad") | (F.col("after") < 0) | (real & F.col("closing") & ~F.col("name").eqNullSafe(partner)))
    root = real & ~F.col("closing") & (F.col("level") == 0)
    attrs = tags.withColumnRenamed("tag", "attrs")
    sound = attrs.withColumn("said", F.when(root & (F.col("name") == "mapper"), _attribute("namespace"))).select(
        "*", F.bool_or("torn").over(whole).alias("any_torn"), F.max_by("after", "pos").over(whole).alias("left"), F.sum(root.cast("int")).over(whole).alias("roots"), F.max("said").over(whole).alias("namespace"))
    sound = sound.filter((F.col("left") == 0) & (F.col("roots") == 1) & ~F.col("any_torn"))
    inside = sound.filter((F.col("entry") > 0) & real & (F.col("level") >= 1))
    maps = F.filter(F.transform(F.split(_attribute("resultMap"), ","), lambda v: F.trim(v)), lambda v: v != "")
    included = F.when((F.col("level") > 1) & (F.col("name") == "include") & ~F.col("closing"), F.filter(F.array(_attribute("refid")), lambda v: v != ""))
    refs = F.transform(F.when(opens, maps).otherwise(included), lambda v: F.struct(v.alias("ref"), F.col("line").alias("ref_line")))
    entries = inside.groupBy(*file, "entry").agg(
        F.max("namespace").alias("namespace"), F.max(F.when(opens, F.struct(F.col("name").alias("tag"), _attribute("id").alias("id"), F.col("line").alias("first")))).alias("head"),
        F.max(F.when(F.col("level") == 1, F.col("line"))).alias("last"), F.flatten(F.collect_list(refs)).alias("refs"))
    return entries.select("path", "namespace", "head.*", "last", F.explode_outer("refs").alias("r")).select("path", "namespace", "tag", "id", "first", "last", "r.ref", "r.ref_line")


# What a documented output contract says, in a doc block and in its return tag.
OUTPUT_CONTEXT = r"(?is)embed(?:ded|ding|dable).{0,100}(?:HTML|script|JavaScript)|(?:HTML|script|JavaScript).{0,100}embed(?:ded|ding|dable)|(?:safe|safely)\s+(?:to|for)\s+(?:embed|render)"
DOCUMENTED_RESULT = r"(?i)@return[^\n]*(?:embed|safe|escap|saniti[sz])"


def doc_contracts(methods: DataFrame, context: str = OUTPUT_CONTEXT, result: str = DOCUMENTED_RESULT) -> DataFrame:
    """Public methods with returns whose own doc, or whose type's doc when theirs documents the result, states an
    output contract; with the five-line window around the first statement.

    ``methods(entity_id, public, has_return, doc, doc_start, type_doc, type_doc_start)``.
    """
    own = F.coalesce(F.regexp_instr("doc", F.lit(context)), F.lit(0))
    outer = F.when(F.col("doc").rlike(result), F.coalesce(F.regexp_instr("type_doc", F.lit(context)), F.lit(0))).otherwise(0)
    rows = methods.filter("public AND has_return AND doc IS NOT NULL").withColumn("own", own).withColumn("outer", outer).filter("own > 0 OR outer > 0")
    mine = F.col("own") > 0
    text = F.when(mine, F.col("doc")).otherwise(F.col("type_doc"))
    head = F.expr("substring(doc_text, 1, at - 1)")
    rows = rows.withColumn("doc_text", text).withColumn("at", F.when(mine, F.col("own")).otherwise(F.col("outer"))).withColumn(
        "base", F.when(mine, F.col("doc_start")).otherwise(F.col("type_doc_start")))
    offset = _count(head, "\n")
    total = F.size(line_array(F.col("doc_text")))
    return rows.select(
        "entity_id", F.when(mine, "method").otherwise("enclosing_type").alias("scope"), (F.col("base") + F.greatest(offset - 2, F.lit(0))).alias("start_line"),
        (F.col("base") + F.least(total - 1, offset + 2)).alias("end_line"))


def evidence_windows(files: DataFrame, ranges: DataFrame, max_lines: int = 120, max_bytes: int = 9000, overhead: int = 12) -> DataFrame:
    """Each requested range cut at the line and byte bounds; with what stays unknown before and after the cut.

    ``ranges(range_id, path, first, last)``. Only the first ``max_lines`` lines of a range are ever summed.
    """
    totals = lines(files).groupBy("path").agg(F.count(F.lit(1)).alias("total"))
    asked = ranges.join(totals, "path").withColumn("until", F.least("last", "total")).filter("first >= 1 AND first <= until")
    wanted = asked.withColumn("line", F.explode(F.sequence(F.col("first"), F.least("until", F.col("first") + max_lines - 1))))
    sized = wanted.join(lines(files).select("path", "line", (F.octet_length("text") + overhead).alias("size")), ["path", "line"])
    grown = sized.withColumn("sum", F.sum("size").over(W.partitionBy("range_id").orderBy("line")))
    ends = grown.filter(F.col("sum") <= max_bytes).groupBy("range_id").agg(F.max("line").alias("end"), F.max("sum").alias("bytes"))
    return asked.join(ends, "range_id").select(
        "range_id", "path", F.col("first").alias("start_line"), F.col("end").alias("end_line"), "bytes", (F.col("end") < F.col("until")).alias("truncated"),
        (F.col("first") - 1).alias("unknown_before"), (F.col("total") - F.col("end")).alias("unknown_after"))


def extract_span(files: DataFrame, selections: DataFrame) -> DataFrame:
    """Exact text from a start anchor to an end anchor, each unique in its line; else the reason there is none.

    ``selections(sel_id, path, first, last, left, right)``.
    """
    j = selections.join(files.select("path", F.col("text").alias("body")), "path").select(
        "sel_id", "first", "last", "left", "right", F.explode(F.array(F.struct(F.slice(line_array(F.col("body")), F.col("first"), F.col("last") - F.col("first") + 1).alias("c")))).alias("s"))
    count = lambda text, needle: ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")
    top, bottom = F.try_element_at("s.c", F.lit(1)), F.try_element_at("s.c", F.lit(-1))
    complete = F.size("s.c") == F.col("last") - F.col("first") + 1
    unique = (count(top, F.col("left")) == 1) & (count(bottom, F.col("right")) == 1)
    a = F.instr(top, F.col("left"))
    b = F.instr(bottom, F.col("right")) + F.length("right")
    reversed_ = (F.col("first") == F.col("last")) & (a >= b)
    ok = complete & unique & ~reversed_
    one = top.substr(a, b - a)
    middle = F.slice("s.c", 2, F.greatest(F.size("s.c") - 2, F.lit(0)))
    many = F.array_join(F.concat(F.array(top.substr(a, F.length(top))), middle, F.array(bottom.substr(F.lit(1), b - 1))), "\n")
    return j.select(
        "sel_id", F.when(ok, F.when(F.col("first") == F.col("last"), one).otherwise(many)).alias("expression"),
        F.when(~complete, "RANGE_NOT_DELIVERED").when(~unique, "ANCHOR_NOT_UNIQUE").when(reversed_, "ANCHORS_REVERSED").alias("problem"))


def term_counts(methods: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """Matches and distinct matched terms per method and category."""
    per = F.explode(F.array(*[
        F.struct(F.lit(name).alias("category"), F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)).alias("terms")) for name, pattern in patterns.items()
    ])).alias("x")
    return methods.select("method_id", per).select("method_id", "x.category", F.size("x.terms").alias("hits"), F.size(F.array_distinct("x.terms")).alias("distinct_terms"))


def symbol_hits(files: DataFrame, name: str, offset: int = 0, page: int | None = 20) -> DataFrame:
    """Uses of a name before a parenthesis in masked code, declarations first, one page per file."""
    code = lines(files.select("path", mask(F.col("text")).alias("text"))).filter(F.col("text").contains(name))
    code = pin(code, parts=F.split("text", rf"(?<![\w$])(?={re.escape(name)}\s*\()", -1))
    spots = code.select("path", "line", F.posexplode("parts").alias("n", "part"), "parts").filter(F.col("part").rlike(rf"^{re.escape(name)}\s*\("))
    spots = pin(spots, before=F.trim(F.regexp_replace(F.array_join(F.slice("parts", 1, F.col("n")), ""), r"(?s)^.*[;{}]", "")))
    before = F.col("before")
    decl = (before != "") & ~before.rlike(r"[=.()]") & ~F.concat(before, F.lit(" ")).rlike("return |throw |new |if |while |case ")
    # Ranks and totals come from one pass, so that texts are masked and cut once. The path's hash sorts faster than paths that begin alike.
    of_file = W.partitionBy("hash", "path")
    ranked = spots.select(F.xxhash64("path").alias("hash"), "path", "line", "n", decl.alias("declaration")).select(
        "*", F.row_number().over(of_file.orderBy(F.col("declaration").desc(), "line", "n")).alias("rank"), F.count(F.lit(1)).over(of_file).alias("total"))
    if page is not None:
        ranked = ranked.filter((F.col("rank") > offset) & (F.col("rank") <= offset + page))
    end = F.lit(offset) + F.lit(page or 0)
    following = F.when((F.lit(page is not None)) & (end < F.col("total")), end).otherwise(-1)
    return ranked.select("path", "line", "declaration", "rank", "total", following.alias("next_offset"))


def admit_steps(steps: DataFrame, windows: DataFrame, source: DataFrame, max_candidates: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidate drafts whose every step cites a read line holding its expression; and the reason for the rest.

    ``steps(draft_id, seq, category, pos, evidence_id, method_id, line, expression, role)``,
    ``windows(evidence_id, method_id, file, start, end)``, ``source(file, line, text)``. A draft needs 2 to 12 steps,
    SOURCE first and SINK last, no step twice. Drafts with one end point pair and category count once; a cap per
    category is applied last, in draft order.
    """
    proof = windows.select("evidence_id", F.col("method_id").alias("w_method"), "file", "start", "end")
    cited = steps.join(proof, "evidence_id", "left").join(source.select("file", "line", F.col("text").alias("raw")), ["file", "line"], "left")
    good = (
        (F.col("method_id") == F.col("w_method")) & F.col("line").between(F.col("start"), F.col("end"))
        & F.col("role").isin("SOURCE", "PROPAGATION", "GUARD", "SINK") & (F.trim("expression") != "") & (F.length("expression") <= 500))
    held = F.coalesce(F.instr("raw", F.col("expression")) > 0, F.lit(False))
    spot = F.struct("file", "line", "expression")
    ends = F.struct("file", "method_id", "line")
    drafts = cited.groupBy("draft_id", "seq", "category").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("role", "pos").alias("first_role"), F.max_by("role", "pos").alias("last_role"),
        F.bool_and(F.coalesce(good, F.lit(False))).alias("proved"), F.bool_and(held).alias("exact"), (F.count_distinct(spot) < F.count(F.lit(1))).alias("repeated"),
        F.min_by(ends, "pos").alias("a"), F.max_by(ends, "pos").alias("b"))
    problem = (
        F.when(~F.col("n").between(2, 12), "STEP_COUNT").when((F.col("first_role") != "SOURCE") | (F.col("last_role") != "SINK"), "STEP_ORDER")
        .when(~F.col("proved"), "STEP_NOT_CITED").when(~F.col("exact"), "EXPRESSION_NOT_IN_LINE").when(F.col("repeated"), "DUPLICATE_STEP"))
    judged = drafts.withColumn("problem", problem)
    ident = stable_id("bcand", {"category": F.col("category"), "a": F.col("a"), "b": F.col("b")})
    unique = first_by(judged.filter("problem IS NULL").withColumn("candidate_id", ident).select("candidate_id", "seq", "draft_id", "category", "n"), ["candidate_id"], ["seq"])
    if max_candidates is not None:
        unique = top_k(unique, ["category"], [F.col("seq")], max_candidates).drop("rank")
    return unique, judged.filter("problem IS NOT NULL").select("draft_id", "problem")


def collapse_tasks(tasks: DataFrame) -> DataFrame:
    """Hypotheses with one position key: file, lines, whitespace-free expression, scope and relation.

    Contributing roles are a bounded vocabulary; members are counted, not listed.
    """
    key = stable_id("task", {
        "scope": F.col("scope_id"), "file": F.col("file"), "line": F.col("line"), "end_line": F.coalesce("end_line", "line"),
        "expression": F.regexp_replace("expression", r"\s+", ""), "relation": F.col("relation")})
    return tasks.withColumn("task_key", key).groupBy("task_key").agg(
        F.count(F.lit(1)).alias("hypotheses"), F.array_sort(F.collect_set("role")).alias("roles"), F.min("task_id").alias("first_task"))


def edge_windows(sites: DataFrame, owners: DataFrame, reach: int = 40) -> DataFrame:
    """Sites of an owner merged while their group spans under ``reach`` lines, then padded inside the owner.

    ``sites(owner, first, last, rank)``, ``owners(owner, start, end)``. Equal sites are folded first, so an owner's rows
    are bounded by its lines; the merge then reads them as a sorted stream and holds one open group.
    """
    distinct = sites.groupBy("owner", "first", "last").agg(F.min("rank").alias("rank")).join(owners, "owner")
    names = ["owner", "rank", "start", "end"]

    def padded(owner, low: int, high: int, first: int, last: int, rank: int) -> tuple:
        begin = max(low, first - 15, last - 39)
        return owner, rank, begin, min(high, begin + 39, max(last, first + 24))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_group = None
        for batch in batches:
            rows = []
            for owner, first, last, rank, low, high in batch[["owner", "first", "last", "rank", "start", "end"]].itertuples(index=False):
                g = open_group
                if g is not None and g[0] == owner and max(last, g[4]) - g[3] < reach:
                    open_group = (owner, low, high, g[3], max(g[4], last), min(g[5], rank))
                    continue
                if g is not None:
                    rows.append(padded(*g))
                open_group = (owner, low, high, first, last, rank)
            yield pd.DataFrame(rows, columns=names)
        if open_group is not None:
            yield pd.DataFrame([padded(*open_group)], columns=names)

    owner_type = dict(sites.dtypes)["owner"]
    ordered = distinct.repartition("owner").sortWithinPartitions("owner", "first", "last", "rank")
    return ordered.mapInPandas(merge, f"owner {owner_type}, rank long, start long, end long")


def stratified(entities: DataFrame, plan: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """First entities per kind in canonical order, as many as planned; and the shortage per kind."""
    most = max(plan.values())
    spark = entities.sparkSession
    wanted = spark.createDataFrame(list(plan.items()), "kind string, requested int")
    chosen = top_k(entities.join(F.broadcast(wanted), "kind"), ["kind"], [F.col("file"), F.col("start"), F.col("end"), F.col("entity_id")], most)
    chosen = chosen.filter(F.col("rank") <= F.col("requested"))
    have = chosen.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    short = wanted.join(have, "kind", "left").select("kind", (F.col("requested") - F.coalesce("n", F.lit(0))).alias("missing")).filter("missing > 0")
    return chosen, short


def retrieve_cards(queries: DataFrame, cards: DataFrame, k: int = 2) -> DataFrame:
    """Top cards per query by shared terms: own category before general, then name.

    ``queries(query_id, category, text)``, ``cards(card, category, terms)`` with category NULL for general cards. The
    join key is the category, general cards are joined once per query; how the cards travel is left to their size.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))
    q = queries.select("query_id", "category", words.alias("words"))
    c = cards.select("card", F.coalesce("category", F.lit("*")).alias("key"), F.split(F.lower("terms"), r"\s+").alias("have"))
    both = q.withColumn("key", F.explode(F.array(F.col("category"), F.lit("*")))).join(c, "key")
    scored = both.select("query_id", "card", F.size(F.array_intersect("words", "have")).alias("overlap"), (F.col("key") == "*").alias("general"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("overlap").desc(), "general", "card"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "card", "overlap", "rank")


def assignment_chains(assigns: DataFrame, params: DataFrame) -> DataFrame:
    """In source order, link each assignment to the latest tracked origin its right side uses.

    ``assigns(method, pos, line, target, uses array<string>)``, ``params(method, name, line)``. A parameter is tracked from
    the start; an assignment that uses no tracked name stops the tracking of its target. Assignments are read as a
    stream sorted by method and position; the state is the tracked names of one method.
    """
    both = assigns.select("method", "pos", "line", "target", "uses").unionByName(
        params.select("method", F.lit(-1).cast("long").alias("pos"), "line", F.col("name").alias("target"), F.lit(None).cast("array<string>").alias("uses")))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tracked = None, {}
        for batch in batches:
            rows = []
            for method, pos, line, target, uses in batch[["method", "pos", "line", "target", "uses"]].itertuples(index=False):
                if method != current:
                    current, tracked = method, {}
                if uses is None:
                    tracked[target] = line
                    continue
                origins = [(tracked[n], n) for n in set(uses) if n in tracked and tracked[n] <= line]
                if not origins:
                    tracked.pop(target, None)
                    continue
                at, name = max(origins)
                rows.append((method, pos, target, name, at))
                tracked[target] = line
            yield pd.DataFrame(rows, columns=["method", "pos", "target", "origin", "origin_line"])

    method_type = dict(assigns.dtypes)["method"]
    ordered = both.repartition("method").sortWithinPartitions("method", "pos", "line", "target")
    return ordered.mapInPandas(link, f"method {method_type}, pos long, target string, origin string, origin_line long")


def production_only(files: DataFrame, test: Column) -> DataFrame:
    """Files that are no test code; all files of a project whose every file is test code."""
    marked = files.withColumn("__test", test)
    any_main = marked.filter("NOT __test").select("project").distinct().withColumn("__main", F.lit(True))
    return marked.join(any_main, "project", "left").filter(~F.col("__test") | F.col("__main").isNull()).drop("__test", "__main")
