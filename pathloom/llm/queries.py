"""The registered queries of the corpus operators: thin digests of each operator's results, with DuckDB twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.alignment import align_tokenizers
from pathloom.llm.bpe import encode_and_decode
from pathloom.llm.conversation_trie import ordered_turns, prefix_trie, rebuilt
from pathloom.llm.decontaminate import benchmark_matches
from pathloom.llm.jaccard_join import jaccard_components
from pathloom.llm.language_id import held_out, identify, train
from pathloom.llm.license_scan import COPYRIGHT, EQUIVALENT, KNOWN, scan_licenses
from pathloom.llm.pii import pseudonymise
from pathloom.llm.secret_scan import ACCESS, ASSIGN, HEX, OPAQUE, secret_scan
from pathloom.llm.simhash import simhash_components
from pathloom.llm.substring_dedup import substring_dedup
from pathloom.llm.topk import top_k_search
from pathloom.llm.url_filter import judge_urls

#: Stands for a secret that a deployment supplies; it decides the pseudonyms.
PII_KEY = "pathloom-test-key"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    "op1_substring_dedup",
    """
    WITH words AS (
        SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
    ), starts AS (
        SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS seq FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)
    ), firsts AS (SELECT seq, min(doc_id) AS least FROM starts GROUP BY seq),
    gone AS (
        SELECT DISTINCT doc_id, i + k AS pos
        FROM (SELECT s.doc_id, s.i, unnest(range(0, 13)) AS k FROM starts s JOIN firsts f ON s.seq = f.seq AND f.least < s.doc_id)
    ), placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words),
    kept AS (
        SELECT p.doc_id, count(*) AS n_kept, string_agg(p.word, ' ' ORDER BY p.pos) AS kept
        FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id
    )
    SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed,
        sha256(coalesce(k.kept, '')) AS kept_sha256
    FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
    """,
)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def _places(kind: str, number: int, pattern: str, value: str) -> str:
    """DuckDB text: each match of a kind with its start, from the lengths of the pieces between matches and of the matches."""
    pattern = pattern.replace("'", "''")
    return f"""
        SELECT doc_id, source, lang, '{kind}' AS kind, {number} AS kind_no, m[i] AS m, v[i] AS v,
            coalesce(list_sum([length(x) for x in s[1 : i]]), 0) + coalesce(list_sum([length(x) for x in m[1 : i - 1]]), 0) AS st
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc_id, source, lang, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {value}) AS v,
                regexp_split_to_array(t, '{pattern}') AS s
            FROM d WHERE regexp_matches(t, '{pattern}')))"""


_SECRETS_SQL = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS source, concat_ws('/', source, lang) AS lang FROM documents),
    found AS (
        SELECT *, CAST(st AS BIGINT) AS a, CAST(st + length(m) AS BIGINT) AS b FROM (
            {_places("assign", 0, ASSIGN, "2")} UNION ALL {_places("access", 1, ACCESS, "0")}
            UNION ALL {_places("hex", 2, HEX, "0")} UNION ALL {_places("opaque", 3, OPAQUE, "0")})
        WHERE kind IN ('access', 'hex') OR (kind = 'assign' AND length(v) >= 6) OR (kind = 'opaque' AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]'))
    ), held AS (SELECT DISTINCT doc_id, source, lang, b - length(v) AS a, b, v FROM found),
    owned AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT lang) AS repositories FROM held GROUP BY v),
    told AS (SELECT *, owners <= 1 AND repositories <= 2 AS live FROM held JOIN owned USING (v)),
    judged AS (
        SELECT doc_id, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied,
            string_agg(a || ':' || b || ':' || repositories || ':' || owners, ',' ORDER BY a, b) AS holders
        FROM told GROUP BY doc_id
    ), spans AS (
        SELECT doc_id, kind, kind_no, a, b FROM found WHERE kind <> 'opaque'
        UNION ALL SELECT DISTINCT doc_id, 'live', 3, a, b FROM told WHERE live
    ), joined AS (
        SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, kind_no) FILTER (kind <> 'live'), '') AS base,
            string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, kind_no, b) AS spans
        FROM spans GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
        coalesce(holders, '') AS holders
    FROM d LEFT JOIN joined USING (doc_id) LEFT JOIN judged USING (doc_id)
"""


@_query("op2_secret_scan", _SECRETS_SQL)
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner is a document's source, its repository the source with the language. ``holders``: start:end:repositories:owners."""
    found = secret_scan(_table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang"), F.col("source"))
    holders = F.array_join(F.transform("held", lambda h: F.concat_ws(":", h["start"], h["end"], h["repositories"], h["owners"])), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_copied", holders.alias("holders"))


@_query(
    "op3_jaccard_join",
    """
    WITH RECURSIVE words AS (
        SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w
        FROM documents
    ), shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
    ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
    ), links AS (
        SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)
    ), reached AS (
        SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
    ), least AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least ON x = d.doc_id
    """,
)
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


@_query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    told = identify(docs, train(docs.where(~held_out())), carry=["doc_id"])
    return told.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


@_query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), "pii")


def _canonical_sql(column: str) -> str:
    """DuckDB text of the license scan's canonical form."""
    out = f"trim(regexp_replace(regexp_replace(lower({column}), '{COPYRIGHT}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for word, standard in EQUIVALENT:
        out = f"regexp_replace({out}, '\\b{word}\\b', '{standard}', 'g')"
    return out


_KNOWN_SQL = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
_LICENSES_SQL = f"""
    WITH known AS (SELECT {_canonical_sql("t")} AS unit, min(license) AS license FROM (VALUES {_KNOWN_SQL}) k(license, t) GROUP BY 1),
    units AS (
        SELECT doc_id, true AS whole, text AS u FROM documents
        UNION ALL SELECT doc_id, false, unnest(string_split(text, chr(10))) FROM documents
    ), found AS (SELECT doc_id, whole, license FROM (SELECT doc_id, whole, {_canonical_sql("u")} AS unit FROM units) JOIN known USING (unit)),
    held AS (
        SELECT doc_id, min(license) FILTER (whole) AS text_license, string_agg(DISTINCT license, ',' ORDER BY license) FILTER (NOT whole) AS line_licenses,
            count(*) FILTER (NOT whole) AS n_license_lines
        FROM found GROUP BY doc_id
    )
    SELECT doc_id, text_license, coalesce(line_licenses, '') AS line_licenses, coalesce(n_license_lines, 0) AS n_license_lines
    FROM documents LEFT JOIN held USING (doc_id)
"""


@_query("op6_license_scan", _LICENSES_SQL)
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


@_query(
    "op7_decontaminate",
    """
    WITH dw AS (
        SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+'), []) AS w
        FROM documents
    ), bw AS (
        SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+'), []) AS w
        FROM benchmark
    ), bs AS (SELECT item_id, w, least(13, len(w)) AS size FROM bw WHERE len(w) > 0),
    items AS (
        SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS seq
        FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM bs)
    ), starts AS (
        SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS seq
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, (SELECT DISTINCT size FROM items) z)
    ), met AS (SELECT doc_id, i, size, item_id FROM starts JOIN items USING (size, seq)),
    hit AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM met)) GROUP BY doc_id
    ), held AS (
        SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
        FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id
    )
    SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
    FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
    """,
)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


@_query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_and_decode(_table(spark, sf_dir, "documents"), TOKENIZER, carry=["doc_id"])
    return done.select("row.doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op9_url_filter")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


@_query(
    "op10_topk",
    """
    WITH v AS (
        SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
    SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
    """,
)
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_search(_table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


@_query("op11_simhash")
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


_TRIE_SQL = """
    WITH t AS (
        SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
            ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS w
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ), h AS (
        SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])),
                lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT)) % 9 AS h
        FROM t
    ), r AS (
        SELECT h.conv_id, list_concat(coalesce(b.w, [])[1 : h.h], h.w[h.h + 1 :]) AS w FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5
    ), member AS (SELECT conv_id, d, w[1 : d] AS p, len(w) AS n FROM (SELECT *, unnest(range(0, len(w) + 1)) AS d FROM r)),
    node AS (
        SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS ends
        FROM member GROUP BY p, d
    ), children AS (SELECT p[1 : d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
    sized AS (SELECT node.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(strlen(node.p[d].text), 0) AS own FROM node LEFT JOIN children USING (p)),
    below AS (
        SELECT a AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved
        FROM (SELECT n_children, own, p[1 : k] AS a FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM sized)) GROUP BY a
    )
    SELECT s.conv_id, CAST(s.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
        sha256(coalesce(s.ends, '')) AS ends_sha256
    FROM sized s JOIN below USING (p) LEFT JOIN node u ON s.d > 0 AND u.d = s.d - 1 AND u.p = s.p[1 : s.d - 1]
"""


@_query("op12_prefix_trie", _TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(ordered_turns(_table(spark, sf_dir, "conversations"))))


@_query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256))
    done = align_tokenizers(_table(spark, sf_dir, "documents"), TOKENIZER, PIECES, carry=["doc_id"], groups=digest)
    return done.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
