"""Text jobs: documents are files, orders become small source files and mapper files, pages are views."""

from pyspark.sql import functions as F

from pathloom.bindings import oracle
from pathloom.functions import scalars as S
from pathloom.operators import entities as E
from pathloom.operators import text as X
from pathloom.registry import query

LINES = r"""WITH ls AS (SELECT concat(source, '/', doc_id, '.txt') AS path, doc_id, lang, u.l AS text, row_number() OVER (PARTITION BY doc_id ORDER BY u.o) AS line, count(*) OVER (PARTITION BY doc_id) AS total
    FROM (SELECT *, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS a FROM documents),
        LATERAL (SELECT unnest(a) AS l, generate_subscripts(a, 1) AS o) u WHERE NOT (u.o = len(a) AND u.l = ''))
"""


@query("j01_search_code", LINES + """, h AS (SELECT path, line, string_split(lower(text), 'the ') AS p FROM ls WHERE contains(lower(text), 'the '))
    SELECT path, line, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * 4 + 1 AS BIGINT) AS column FROM h, LATERAL (SELECT unnest(generate_series(1, len(p) - 1)) AS i)""")
def j01(t):
    return X.search_code(t.files, "The ").select("path", "line", F.col("column").cast("long").alias("column"))


@query("j01_search_owned", LINES + """, h AS (SELECT path, line, len(string_split(text, 'and')) - 1 AS n FROM ls WHERE contains(text, 'and') AND path LIKE 'src1%')
    SELECT path, CASE WHEN line <= 2 THEN concat('head-', path) WHEN line <= 40 THEN concat('body-', path) END AS entity_id, CAST(sum(n) AS BIGINT) AS hits FROM h GROUP BY 1, 2""")
def j01_owned(t):
    span = lambda name, end: t.files.select(F.concat(F.lit(name), "path").alias("entity_id"), F.col("path").alias("file"), F.lit(1).alias("start"), F.lit(end).alias("end"))
    hits = X.search_code(t.files, "and", span("head-", 2).unionByName(span("body-", 40)), glob="src1*", case_sensitive=True)
    return hits.groupBy("path", "entity_id").agg(F.count(F.lit(1)).alias("hits"))


def entities(t):
    kind = F.when(F.col("p_type") == "PROMO", "CALL").when(F.col("p_type") == "SMALL", "TYPE").otherwise("METHOD")
    return t.part.select(
        F.col("p_partkey").alias("entity_id"), kind.alias("kind"), F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit(".java")).alias("file"), F.col("p_size").alias("start"),
        (F.col("p_size") + 2).alias("end"), F.col("p_name").alias("simple_name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.lit(None).cast("string").alias("signature"),
        F.when(F.col("p_size") > 40, "LOW").otherwise("HIGH").alias("confidence"))


ENT = """WITH e AS (SELECT p_partkey AS entity_id, CASE p_type WHEN 'PROMO' THEN 'CALL' WHEN 'SMALL' THEN 'TYPE' ELSE 'METHOD' END AS kind, concat(p_brand, '/', p_size, '.java') AS file, p_size AS start,
    p_name AS simple_name, concat(p_brand, '.', p_name) AS qualified_name, CASE WHEN p_size > 40 THEN 'LOW' ELSE 'HIGH' END AS confidence FROM part)
"""


@query("j02_search_symbols", ENT + """SELECT entity_id, kind, file, start FROM e WHERE contains(lower(concat_ws(chr(10), simple_name, qualified_name)), 'bolt')
    ORDER BY kind NOT IN ('METHOD', 'CONSTRUCTOR', 'TYPE'), lower(simple_name) <> 'bolt', file, start, kind, qualified_name, entity_id LIMIT 50""")
def j02(t):
    return X.search_symbols(entities(t), "Bolt", prefer_declarations=True).select("entity_id", "kind", "file", "start")


@query("f01_canonical_order", ENT + "SELECT row_number() OVER (ORDER BY file, start, kind, qualified_name, entity_id) AS pos, entity_id FROM e")
def f01(t):
    return X.canonical_positions(entities(t)).select("pos", "entity_id")


@query("d30_index_summary", ENT + """SELECT 'kind' AS dimension, kind AS value, count(*) AS count FROM e GROUP BY 2 UNION ALL SELECT 'confidence', confidence, count(*) FROM e GROUP BY 2
    UNION ALL SELECT 'severity', CASE WHEN n_chars < 200 THEN 'ERROR' WHEN n_chars < 500 THEN 'WARNING' ELSE 'INFO' END, count(*) FROM documents GROUP BY 2""")
def d30(t):
    diagnostics = t.documents.select(F.when(F.col("n_chars") < 200, "ERROR").when(F.col("n_chars") < 500, "WARNING").otherwise("INFO").alias("severity"))
    return X.index_summary(entities(t), diagnostics)


@query("e11_stratified", ENT + """, p AS (SELECT * FROM (VALUES ('METHOD', 40), ('CALL', 25), ('TYPE', 30)) v(kind, n)) SELECT entity_id, kind, rank FROM (SELECT e.*, n, row_number() OVER (PARTITION BY kind ORDER BY file, start, entity_id) AS rank FROM e JOIN p USING (kind)) WHERE rank <= n""")
def e11(t):
    return X.stratified(entities(t), {"METHOD": 40, "CALL": 25, "TYPE": 30})[0].select("entity_id", "kind", "rank")


@query("e11_shortage", ENT + """, p AS (SELECT * FROM (VALUES ('METHOD', 1000000000), ('FIELD', 5)) v(kind, n)) SELECT kind, n - count(e.entity_id) AS missing FROM p LEFT JOIN e USING (kind) GROUP BY kind, n""")
def e11_shortage(t):
    return X.stratified(entities(t), {"METHOD": 1000000000, "FIELD": 5})[1].withColumn("missing", F.col("missing").cast("long"))


REQ = """, r AS (SELECT doc_id AS request_id, CASE WHEN quality = 0 THEN concat('none/', doc_id) ELSE (SELECT any_value(concat(source, '/', d.doc_id, '.txt')) FROM documents d WHERE d.doc_id = l.doc_id) END AS path, doc_id % 5 AS s, doc_id % 5 + doc_id % 23 AS e FROM labels l),
    x AS (SELECT request_id, r.path, s, e, any_value(total) AS total, string_agg(text, chr(10) ORDER BY line) FILTER (line BETWEEN s AND e) AS t, sum(strlen(text) + 1) FILTER (line BETWEEN s AND e) AS b FROM r LEFT JOIN ls ON ls.path = r.path GROUP BY 1, 2, 3, 4),
    y AS (SELECT *, CASE WHEN s < 1 THEN 'INVALID_RANGE' WHEN e - s + 1 > 20 THEN 'LINE_LIMIT_EXCEEDED' WHEN total IS NULL THEN 'FILE_UNAVAILABLE' WHEN s > total THEN 'RANGE_OUT_OF_BOUNDS' WHEN b > 4000 THEN 'BYTE_LIMIT_EXCEEDED' END AS error FROM x)
"""


@query("j03_read_ranges", LINES + REQ + """SELECT request_id, path, error, CASE WHEN error IS NULL THEN t END AS text, CASE WHEN error IS NULL THEN CAST(b AS BIGINT) END AS byte_count,
    CASE WHEN error IS NULL THEN least(e, total) END AS end_line, CASE WHEN error IS NULL THEN e > total END AS truncated FROM y""")
def j03(t):
    joined = t.labels.join(t.files.select("doc_id", "path"), "doc_id")
    start = F.col("doc_id") % 5
    requests = joined.select(F.col("doc_id").alias("request_id"), F.when(F.col("quality") == 0, F.concat(F.lit("none/"), F.col("doc_id").cast("string"))).otherwise(F.col("path")).alias("path"),
                             start.cast("int").alias("start"), (start + F.col("doc_id") % 23).cast("int").alias("end"))
    return X.read_ranges(t.files, requests, 20, 4000)


NON_CODE = r"""//[^\n]*|/\*(?:[^*]|\*+[^*/])*(?:\*+/|\**\z)|"{3}(?s:.*?)(?:"{3}|\z)|"(?:[^"\\]|\\(?s:.)|\\\z)*"?|'(?:[^'\\]|\\(?s:.)|\\\z)*'?"""


@query("j04_mask_code", f"""WITH d AS (SELECT concat(source, '/', doc_id, '.txt') AS path, regexp_split_to_array(text, '{NON_CODE.replace("'", "''")}') AS s, regexp_extract_all(text, '{NON_CODE.replace("'", "''")}') AS m FROM documents)
    SELECT path, array_to_string([s[i] || coalesce(CASE WHEN m[i][1] = '/' THEN regexp_replace(m[i], '[^\n]', ' ', 'g') ELSE '0' || regexp_replace(m[i][2:], '[^\n]', ' ', 'g') END, '') for i in range(1, len(s) + 1)], '') AS masked FROM d""")
def j04(t):
    return t.files.select("path", E.mask(F.col("text")).alias("masked"))


DEEP = "".join(f"f{i}(" for i in range(20)) + "1" + ")" * 20


def java_files(t):
    """One small class per order: a field, a method per line whose head and calls span lines, with literals and a brace in a comment, and calls nested 20 deep."""
    s = lambda c: F.col(c).cast("string")
    body = lambda x: F.concat(
        F.lit("  public int m"), x["l_linenumber"].cast("string"), F.lit("_"), x["l_partkey"].cast("string"), F.lit("_"), x["l_suppkey"].cast("string"),
        F.lit("(final String a,\n      Map<String, Long> b) { // open {\n    return call"), x["l_partkey"].cast("string"), F.lit('(a,\n      other(b, "x) { y"));\n  }'))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("m"))
    text = F.concat(F.lit("package com.acme;\n@Service(names = (1)) public class O"), s("l_orderkey"), F.lit(" {\n  private List<String> names = null;\n"),
                    F.array_join(F.transform("m", body), "\n"), F.lit(f"\n  int deep() {{ return {DEEP}; }}\n}}\n"))
    return rows.select(F.concat(F.lit("src/O"), s("l_orderkey"), F.lit(".java")).alias("path"), text.alias("text"))


JAVA = """WITH m AS (SELECT concat('src/O', l_orderkey, '.java') AS file, concat('com.acme.O', l_orderkey) AS own, l_orderkey, concat('m', l_linenumber, '_', l_partkey, '_', l_suppkey) AS name, l_partkey,
        concat('com.acme.O', l_orderkey, '.m', l_linenumber, '_', l_partkey, '_', l_suppkey, '(String,Map<String,Long>)') AS fn,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    o AS (SELECT DISTINCT file, own, l_orderkey, n FROM m)
"""


@query("j05_extract_entities", JAVA + """SELECT * FROM (
    SELECT file, 'PACKAGE' AS kind, 1 AS start, 1 AS "end", 'com.acme' AS qualified_name, NULL AS enclosing_type, 'package com.acme' AS signature, NULL AS detail FROM o
    UNION ALL SELECT file, 'TYPE', 2, 5 * n + 5, own, NULL, concat('class O', l_orderkey), 'CLASS' FROM o
    UNION ALL SELECT file, 'ANNOTATION', 2, 2, concat(own, '@Service'), own, '@Service', NULL FROM o
    UNION ALL SELECT file, 'FIELD', 3, 3, concat(own, '.names'), own, 'names:List<String>', NULL FROM o
    UNION ALL SELECT file, 'METHOD', 5 * i - 1, 5 * i + 3, concat(own, '.', name), own, concat(name, '(String,Map<String,Long>)'), 'public' FROM m
    UNION ALL SELECT file, 'PARAMETER', 5 * i - 1, 5 * i - 1, concat(fn, '#a'), own, '0:String', NULL FROM m
    UNION ALL SELECT file, 'PARAMETER', 5 * i, 5 * i, concat(fn, '#b'), own, '1:Map<String,Long>', NULL FROM m
    UNION ALL SELECT file, 'CALL', 5 * i + 1, 5 * i + 2, concat(fn, '::call', l_partkey), own, concat('call', l_partkey, '/2'), 'METHOD_CALL' FROM m
    UNION ALL SELECT file, 'CALL', 5 * i + 2, 5 * i + 2, concat(fn, '::other'), own, 'other/2', 'METHOD_CALL' FROM m
    UNION ALL SELECT file, 'METHOD', 5 * n + 4, 5 * n + 4, concat(own, '.deep'), own, 'deep()', '' FROM o
    UNION ALL SELECT file, 'CALL', 5 * n + 4, 5 * n + 4, concat(own, '.deep()::f', k), own, concat('f', k, '/1'), 'METHOD_CALL' FROM o, (SELECT unnest(range(20)) AS k))""")
def j05(t):
    return E.extract_entities(java_files(t))[0].select("file", "kind", "start", "end", "qualified_name", "enclosing_type", "signature", "detail")


@query("j12_symbol_hits", JAVA + """SELECT file AS path, 5 * i + 2 AS line, false AS declaration, i AS rank, n AS total, CASE WHEN 5 < n THEN 5 ELSE -1 END AS next_offset FROM m WHERE i <= 5""")
def j12(t):
    return X.symbol_hits(java_files(t), "other", page=5)


@query("j06_script_refs", r"""WITH p AS (SELECT page_id, html, regexp_extract_all(html, '(?is)<script\b[^>]*>') AS tags FROM pages)
    SELECT page_id, CAST(len(tags) AS BIGINT) AS tags, CAST(list_sum(list_transform(tags, lambda x: CASE WHEN regexp_matches(x, '(?i)\ssrc\s*=') THEN 1 ELSE 0 END)) AS BIGINT) AS sourced FROM p WHERE len(tags) > 0""")
def j06(t):
    refs = X.script_references(t.pages)
    return refs.groupBy("page_id").agg(F.count(F.lit(1)).alias("tags"), F.sum("n_src").alias("sourced"))


def mapper_files(t):
    s = lambda c: F.col(c).cast("string")
    entry = lambda x: F.concat(
        F.lit('<select id="s'), x["l_partkey"].cast("string"), F.lit('" resultMap="r'), x["l_suppkey"].cast("string"), F.lit('">\nselect 1\n<include refid="c'), x["l_linenumber"].cast("string"), F.lit('"/></select>'))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("m"))
    text = F.concat(F.lit('<mapper namespace="com.O'), s("l_orderkey"), F.lit('">\n'), F.array_join(F.transform("m", entry), "\n"), F.lit("\n</mapper>"))
    return rows.select(F.concat(F.lit("mapper/O"), s("l_orderkey"), F.lit(".xml")).alias("path"), text.alias("text"))


MAPPER = """WITH m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem)
"""


@query("j07_mapper_entries", MAPPER + """SELECT concat('mapper/O', l_orderkey, '.xml') AS path, concat('com.O', l_orderkey) AS namespace, 'select' AS tag, concat('s', l_partkey) AS id, 3 * i - 1 AS first, 3 * i + 1 AS last,
    unnest([concat('r', l_suppkey), concat('c', l_linenumber)]) AS ref, unnest([3 * i - 1, 3 * i + 1]) AS ref_line FROM m""")
def j07(t):
    return X.mapper_entries(mapper_files(t))


CONTEXT = "(?is)and.{0,30}the| des "


RESULT = r"(?i)en"


@query("j08_doc_contracts", LINES + r""", d AS (SELECT documents.*, total FROM documents JOIN (SELECT DISTINCT doc_id, total FROM ls) z ON z.doc_id = documents.doc_id),
    c AS (SELECT m.doc_id, m.text AS own, m.total AS own_total, t.text AS outer_text, t.total AS outer_total FROM d m LEFT JOIN d t ON t.doc_id = m.doc_id - m.doc_id % 5 WHERE m.lang <> 'fr'),
    s AS (SELECT doc_id, 'method' AS scope, 10 AS base, own AS doc, own_total AS total FROM c WHERE regexp_matches(own, '(?is)and.{0,30}the| des ')
        UNION ALL SELECT doc_id, 'enclosing_type', 500, outer_text, outer_total FROM c WHERE NOT regexp_matches(own, '(?is)and.{0,30}the| des ') AND regexp_matches(own, '(?i)en')
            AND regexp_matches(outer_text, '(?is)and.{0,30}the| des ')),
    m AS (SELECT *, regexp_extract(doc, '(?is)^(.*?)(?:and.{0,30}the| des )', 1) AS pre FROM s)
    SELECT doc_id AS entity_id, scope, base + greatest(length(pre) - length(replace(pre, chr(10), '')) - 2, 0) AS start_line, base + least(total - 1, length(pre) - length(replace(pre, chr(10), '')) + 2) AS end_line FROM m""")
def j08(t):
    """The type of a method is the document its id leads to, so both branches speak."""
    types = t.documents.select(F.col("doc_id").alias("type_id"), F.col("text").alias("type_doc"), F.lit(500).alias("type_doc_start"))
    methods = t.documents.select(F.col("doc_id").alias("entity_id"), (F.col("lang") != "fr").alias("public"), F.lit(True).alias("has_return"), F.col("text").alias("doc"), F.lit(10).alias("doc_start"),
                                 (F.col("doc_id") - F.col("doc_id") % 5).alias("type_id")).join(types, "type_id", "left").drop("type_id")
    return X.doc_contracts(methods, CONTEXT, RESULT)


@query("j09_evidence_windows", LINES + """, r AS (SELECT doc_id AS range_id, 1 + doc_id % 4 AS f FROM labels), g AS (SELECT range_id, path, f, line, total, sum(strlen(text) + 12) OVER (PARTITION BY range_id ORDER BY line) AS s FROM r JOIN ls ON ls.doc_id = range_id AND line >= f AND line < f + 6)
    SELECT range_id, path, f AS start_line, max(line) AS end_line, CAST(max(s) AS BIGINT) AS bytes, max(line) < any_value(total) AS truncated, f - 1 AS unknown_before, any_value(total) - max(line) AS unknown_after FROM g WHERE s <= 2500 GROUP BY 1, 2, 3""")
def j09(t):
    ranges = t.labels.join(t.files.select("doc_id", "path"), "doc_id").select(F.col("doc_id").alias("range_id"), "path", (1 + F.col("doc_id") % 4).alias("first"), F.lit(1000000000).cast("long").alias("last"))
    return X.evidence_windows(t.files, ranges, 6, 2500)


@query("j10_extract_span", LINES + """, w AS (SELECT a.path AS sel_id, a.text AS t1, b.text AS t2, string_split(a.text, ' ')[1] AS l, string_split(b.text, ' ')[len(string_split(b.text, ' '))] AS r
        FROM ls a JOIN ls b ON b.path = a.path AND b.line = 2 WHERE a.line = 1), z AS (SELECT *, len(string_split(t1, l)) - 1 AS c1, len(string_split(t2, r)) - 1 AS c2 FROM w WHERE l <> '' AND r <> '')
    SELECT sel_id, CASE WHEN c1 = 1 AND c2 = 1 THEN concat(substr(t1, position(l IN t1)), chr(10), substr(t2, 1, position(r IN t2) + length(r) - 1)) END AS expression, CASE WHEN c1 <> 1 OR c2 <> 1 THEN 'ANCHOR_NOT_UNIQUE' END AS problem FROM z""")
def j10(t):
    two = t.files.select("path", X.line_array(F.col("text")).alias("a")).filter("size(a) >= 2")
    selections = two.select(F.col("path").alias("sel_id"), "path", F.lit(1).alias("first"), F.lit(2).alias("last"), F.split(F.col("a")[0], " ")[0].alias("left"),
                            F.element_at(F.split(F.col("a")[1], " "), -1).alias("right")).filter("left <> '' AND right <> ''")
    return X.extract_span(t.files, selections)


TERMS = {"CWE-22": "the|and", "CWE-79": "\\w+tion"}


@query("j11_term_counts", r"""SELECT doc_id AS method_id, c AS category, CAST(len(x) AS BIGINT) AS hits, CAST(len(list_distinct(x)) AS BIGINT) AS distinct_terms FROM (
    SELECT doc_id, 'CWE-22' AS c, regexp_extract_all(lower(text), 'the|and') AS x FROM documents UNION ALL SELECT doc_id, 'CWE-79', regexp_extract_all(lower(text), '[a-z0-9_]+tion') FROM documents)""")
def j11(t):
    return X.term_counts(t.documents.withColumnRenamed("doc_id", "method_id"), {"CWE-22": "the|and", "CWE-79": "[a-z0-9_]+tion"})


@query("p11_production_only", """WITH f AS (SELECT doc_id, lang, source IN ('src1', 'src2') OR doc_id % 10 = 7 OR lang = 'de' AS test FROM documents), m AS (SELECT DISTINCT lang FROM f WHERE NOT test)
    SELECT doc_id, lang AS project FROM f WHERE NOT test OR lang NOT IN (FROM m)""")
def p11(t):
    folder = F.when(F.col("source") == "src1", "a/test/b").when(F.col("source") == "src2", "a/mockery/b").when(F.col("lang") == "de", "x/TestFixtures").otherwise("main")
    name = F.when(F.col("doc_id") % 10 == 7, "OrderTests.java").otherwise("Order.java")
    rows = t.documents.select("doc_id", F.col("lang").alias("project"), F.concat_ws("/", folder, name).alias("path"))
    return X.production_only(rows, S.is_test_path(F.col("path"))).select("doc_id", "project")


@query("p23_redact", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b[0-9a-f]{40}\b', repeat('X', 40), 'g'), '(?i)tion', 'XXXX', 'g'), '(?i)the', 'XXX', 'g') AS masked FROM documents""")
def p23(t):
    return t.documents.select("doc_id", X.redact(F.col("text"), ["the", "tion"]).alias("masked"))


@query("p24_source_safe", """SELECT doc_id, concat('id [identifier removed] ', text) AS text FROM documents""")
def p24(t):
    return t.documents.select("doc_id", X.source_safe(F.concat(F.lit("id cve-2020-"), (1000 + F.col("doc_id")).cast("string"), F.lit(" "), "text")).alias("text"))


@query("p25_redact_report", """SELECT CAST(l_orderkey AS VARCHAR) AS fingerprint, 'seen XXXXXXXXXXXXXX here' AS description, string_agg(concat('P', l_partkey, '#', l_linenumber, '#XXXXXXXXXXXXXX'), '>' ORDER BY l_linenumber, l_partkey, l_suppkey) AS flow FROM lineitem GROUP BY 1""")
def p25(t):
    node = F.struct(F.col("l_linenumber").alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"), F.struct(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("file_path"), F.col("l_linenumber").alias("line_number"), F.lit("CVE-2020-12345").alias("description")).alias("n"))
    rows = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("fingerprint")).agg(F.array_sort(F.collect_list(node)).alias("s"))
    findings = rows.select("fingerprint", F.lit("seen CVE-2021-44444 here").alias("description"), F.lit("x").alias("category"), F.transform("s", lambda x: x["n"]).alias("flow"))
    step = lambda n: F.concat_ws("#", n["file_path"], n["line_number"].cast("string"), n["description"])
    return X.redact_report(findings).select("fingerprint", "description", F.array_join(F.transform("flow", step), ">").alias("flow"))


def _drafts(t):
    """A draft per order: its lines are steps; the cited window is the method's first five lines, the text names the part."""
    low = t.sites.groupBy("method").agg(F.min(F.struct("line", "part", "supp")).alias("lo"), F.max(F.struct("line", "part", "supp")).alias("hi"))
    s = t.sites.join(low, "method")
    here = F.struct("line", "part", "supp")
    role = F.when(here == F.col("lo"), "SOURCE").when(here == F.col("hi"), "SINK").when(F.col("flag") == "A", "GUARD").otherwise("PROPAGATION")
    text = F.concat(F.lit("P"), F.col("part").cast("string"), F.when((F.col("flag") == "N") & (F.col("line") == 3), "?").otherwise(""))
    return s.select(F.col("method").alias("draft_id"), F.col("method").alias("seq"), (F.col("method") % 3).cast("string").alias("category"), here.alias("pos"), F.col("method").alias("evidence_id"),
                    F.col("method").alias("method_id"), F.col("line"), text.alias("expression"), role.alias("role"))


ADMIT = """WITH g AS (SELECT method, count(*) AS n, bool_or(flag = 'N' AND line = 3) AS bad, max(line) AS hi, count(DISTINCT (line, part, CASE WHEN flag = 'N' AND line = 3 THEN 1 ELSE 0 END)) AS d FROM sites GROUP BY 1),
    p AS (SELECT method, CASE WHEN n NOT BETWEEN 2 AND 12 THEN 'STEP_COUNT' WHEN hi > 6 THEN 'STEP_NOT_CITED' WHEN bad THEN 'EXPRESSION_NOT_IN_LINE' WHEN d < n THEN 'DUPLICATE_STEP' END AS problem FROM g)
"""


def _admitted(t):
    windows = t.methods.select(F.col("method").alias("evidence_id"), F.col("method").alias("method_id"), F.col("method").cast("string").alias("file"), F.lit(1).alias("start"), F.lit(6).alias("end"))
    parts = t.sites.groupBy(F.col("method").cast("string").alias("file"), "line").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("P"), F.col("part").cast("string")))), ";").alias("text"))
    return X.admit_steps(_drafts(t), windows, parts)


@query("p19_admit_candidates", oracle(ADMIT + "SELECT method AS draft_id FROM p WHERE problem IS NULL", "sites"))
def p19(t):
    return _admitted(t)[0].select("draft_id")


@query("p19_refused_drafts", oracle(ADMIT + "SELECT method AS draft_id, problem FROM p WHERE problem IS NOT NULL", "sites"))
def p19_refused(t):
    return _admitted(t)[1]


@query("d39_collapse_tasks", """WITH k AS (SELECT l_suppkey, l_linenumber, l_partkey, min(l_orderkey) AS first_task, count(*) AS hypotheses, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS roles FROM lineitem GROUP BY 1, 2, 3)
    SELECT first_task, hypotheses, roles FROM k""")
def d39(t):
    s = lambda c: F.col(c).cast("string")
    gap = F.when(F.col("l_quantity") > 25, "  ").otherwise("")
    rows = t.lineitem.select(F.col("l_orderkey").alias("task_id"), s("l_suppkey").alias("scope_id"), F.concat(F.lit("f"), s("l_linenumber")).alias("file"), F.col("l_linenumber").alias("line"), F.lit(None).cast("int").alias("end_line"),
                             F.concat(F.lit("use("), gap, s("l_partkey"), gap, F.lit(")")).alias("expression"), F.lit("SOURCE_PROVENANCE").alias("relation"), F.col("l_returnflag").alias("role"))
    return X.collapse_tasks(rows).select("first_task", "hypotheses", F.array_join("roles", ",").alias("roles"))


@query("f07_retrieve_cards", r"""WITH c(card, key, terms) AS (VALUES ('escape-use', 'en', 'the and of is tion'), ('path-use', 'fr', 'des les que un'), ('loop-use', 'de', 'der die das und'),
        ('guard-use', '*', 'the des der el'), ('caller-use', '*', 'library public callback')),
    q AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS words FROM documents),
    s AS (SELECT doc_id AS query_id, card, CAST(len(list_intersect(words, string_split(terms, ' '))) AS INT) AS overlap, key = '*' AS general FROM q JOIN c ON key = lang OR key = '*')
    SELECT query_id, card, overlap, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, general, card) AS r FROM s) WHERE r <= 2""")
def f07(t):
    cards = t.spark.createDataFrame([
        ("escape-use", "en", "the and of is tion"), ("path-use", "fr", "des les que un"), ("loop-use", "de", "der die das und"), ("guard-use", None, "the des der el"), ("caller-use", None, "library public callback")],
        "card string, category string, terms string")
    queries = t.documents.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("category"), "text")
    return X.retrieve_cards(queries, cards)


@query("e06_edge_windows", """WITH RECURSIVE d AS (SELECT owner, first, last, min(rank) AS rank FROM (
            SELECT l_suppkey AS owner, l_partkey + l_linenumber AS first, l_partkey + 2 * l_linenumber AS last, l_orderkey AS rank FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) GROUP BY 1, 2, 3),
    o AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY first, last, rank) AS n FROM d),
    w AS (SELECT owner, n, n AS g, first AS low, last AS high, rank FROM o WHERE n = 1
        UNION ALL SELECT o.owner, o.n, CASE WHEN greatest(o.last, high) - low < 40 THEN g ELSE o.n END, CASE WHEN greatest(o.last, high) - low < 40 THEN low ELSE o.first END,
            CASE WHEN greatest(o.last, high) - low < 40 THEN greatest(high, o.last) ELSE o.last END, CASE WHEN greatest(o.last, high) - low < 40 THEN least(w.rank, o.rank) ELSE o.rank END
        FROM w JOIN o ON o.owner = w.owner AND o.n = w.n + 1),
    z AS (SELECT owner, g, arg_max(low, n) AS low, arg_max(high, n) AS high, arg_max(rank, n) AS rank FROM w GROUP BY 1, 2), b AS (SELECT *, greatest(1, low - 15, high - 39) AS begin FROM z)
    SELECT owner, rank, begin AS start, least(1000000000, begin + 39, greatest(high, low + 24)) AS "end" FROM b""")
def e06(t):
    sites = t.lineitem.select(F.col("l_suppkey").alias("owner"), (F.col("l_partkey") + F.col("l_linenumber")).alias("first"), (F.col("l_partkey") + 2 * F.col("l_linenumber")).alias("last"), F.col("l_orderkey").alias("rank"))
    owners = t.supplier.select(F.col("s_suppkey").alias("owner"), F.lit(1).alias("start"), F.lit(1000000000).alias("end"))
    return X.edge_windows(sites, owners)


@query("i15_assignment_chains", """WITH RECURSIVE l AS (SELECT l_orderkey AS method, (CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 10000 + l_suppkey AS pos, CAST(l_linenumber AS BIGINT) AS line, l_returnflag AS target,
        [l_linestatus, CASE WHEN l_quantity > 25 THEN 'R' ELSE 'A' END] AS uses FROM lineitem),
    o AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY pos, line, target) AS n FROM l),
    st AS (SELECT o_orderkey AS method, 0 AS n, [{'k': CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END, 'v': CAST(0 AS BIGINT)}] AS tracked, CAST(NULL AS BIGINT) AS pos,
            CAST(NULL AS VARCHAR) AS target, CAST(NULL AS STRUCT(v BIGINT, k VARCHAR)) AS origin FROM orders
        UNION ALL SELECT method, n, list_concat([e for e in tracked if e.k <> target], CASE WHEN best IS NULL THEN [] ELSE [{'k': target, 'v': line}] END), pos, target, best FROM (
            SELECT o.method, o.n, o.pos, o.line, o.target, tracked, list_sort([{'v': e.v, 'k': e.k} for e in tracked if list_contains(o.uses, e.k) AND e.v <= o.line], 'DESC')[1] AS best
            FROM st JOIN o ON o.method = st.method AND o.n = st.n + 1))
    SELECT method, pos, target, origin.k AS origin, origin.v AS origin_line FROM st WHERE origin IS NOT NULL""")
def i15(t):
    assigns = t.lineitem.select(F.col("l_orderkey").alias("method"), ((F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("pos"), F.col("l_linenumber").cast("long").alias("line"),
                                F.col("l_returnflag").alias("target"), F.array("l_linestatus", F.when(F.col("l_quantity") > 25, "R").otherwise("A")).alias("uses"))
    params = t.orders.select(F.col("o_orderkey").alias("method"), F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus")).alias("name"), F.lit(0).cast("long").alias("line"))
    return X.assignment_chains(assigns, params)
