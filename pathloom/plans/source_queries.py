"""Readers and writers: tables are written to the shared scratch folder in each format and read back."""

from pyspark.sql import functions as F

from pathloom.bindings import oracle
from pathloom.registry import query
from pathloom.sources import files as FS
from pathloom.sources import sinks as K
from pathloom.sources import text as X


@query("a01_read_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def a01(t):
    path = K.scratch(t.spark, "jsonl")
    t.conversations.write.json(path)
    return X.read_jsonl(t.spark, path, t.conversations.schema).select("conv_id", "turn", "role", "text")


def _mixed_lines(t):
    """Journal lines with some broken and some that are JSON but no object."""
    good = F.to_json(F.struct("conv_id", "turn", "role"))
    return t.conversations.select(F.when(F.col("role") == "system", "{broken").when(F.col("turn") == 3, "[1, 2]").otherwise(good).alias("value"))


def _load(t):
    path = K.scratch(t.spark, "mixed")
    _mixed_lines(t).write.text(path)
    return X.load_jsonl(t.spark, path, t.conversations.select("conv_id", "turn", "role").schema)


@query("a02_load_jsonl_rows", "SELECT conv_id, turn, role FROM conversations WHERE role <> 'system' AND turn <> 3")
def a02(t):
    return _load(t)[0]


@query("a02_load_jsonl_issues", """SELECT CASE WHEN role = 'system' THEN 'invalid JSON' ELSE 'record is not an object' END AS error, count(*) AS lines
    FROM conversations WHERE role = 'system' OR turn = 3 GROUP BY 1""")
def a02_issues(t):
    return _load(t)[1].groupBy("error").agg(F.countDistinct("file", "line").alias("lines"))


@query("a03_read_csv", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand FROM part")
def a03(t):
    path = K.scratch(t.spark, "csv")
    t.part.select("p_partkey", "p_name", "p_brand").write.option("header", True).csv(path)
    return X.read_csv(t.spark, path, ["p_partkey", "p_brand"])


@query("a04_decode_csv", oracle("SELECT caller, callee, line, kind FROM calls", "calls"))
def a04(t):
    path = K.scratch(t.spark, "rows")
    t.calls.select("caller", "callee", "line", "kind").write.csv(path)
    return X.decode_csv(t.spark, path, ["caller", "callee", "line", "kind"], {"caller": "bigint", "callee": "bigint", "line": "bigint"})


@query("a05_read_relations", oracle("""SELECT kind, concat('M', caller) AS l_file, line AS l_line, line + 1 AS l_col, concat('M', callee) AS r_file, 1 AS r_line, 1 AS r_col, '' AS detail FROM calls""", "calls"))
def a05(t):
    path = K.scratch(t.spark, "relations")
    m = lambda c: F.concat(F.lit("M"), F.col(c).cast("string"))
    t.calls.select("kind", m("caller").alias("l_file"), F.col("line").alias("l_line"), (F.col("line") + 1).alias("l_col"), m("callee").alias("r_file"),
                   F.lit(1).alias("r_line"), F.lit(1).alias("r_col")).write.option("header", True).csv(path)
    return X.read_relations(t.spark, path)


@query("a05_read_transfers", oracle("SELECT concat('M', caller) AS from_file, 'ARGUMENT' AS from_role, concat('M', callee) AS to_file, 'static' AS kind, concat('M', caller) AS end_file, '' AS grp, CAST(line AS VARCHAR) AS from_index FROM calls", "calls"))
def a05_transfers(t):
    path = K.scratch(t.spark, "transfers")
    one = F.lit(1)
    caller, callee = F.concat(F.lit("M"), F.col("caller").cast("string")), F.concat(F.lit("M"), F.col("callee").cast("string"))
    values = [caller, one, one, one, one, F.lit("ARGUMENT"), F.col("line"), callee, one, one, one, one, F.lit("PARAMETER"), F.col("line"), caller, one, one]
    t.calls.select(*[v.alias(c) for v, c in zip(values, X.TRANSFER_COLUMNS)]).write.option("header", True).csv(path)
    return X.read_transfers(t.spark, path).select("from_file", "from_role", "to_file", "kind", "end_file", "grp", "from_index")


def content(t):
    """Documents as binary files; texts of one language are cut inside a multi-byte letter to be invalid."""
    raw = F.encode("text", "UTF-8")
    bad = F.concat(raw, F.lit(b"\xc3"))
    folder = F.when(F.col("source") == "src3", "build/src3").otherwise(F.col("source"))
    return t.documents.select(
        F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("n_chars") % 2 == 0, ".java").otherwise(".txt")).alias("path"),
        F.when(F.col("lang") == "fr", bad).otherwise(raw).alias("content"), F.octet_length("text").cast("long").alias("length"), "source", "doc_id")


PATHS = """WITH f AS (SELECT concat(CASE WHEN source = 'src3' THEN 'build/src3' ELSE source END, '/', doc_id, CASE WHEN n_chars % 2 = 0 THEN '.java' ELSE '.txt' END) AS path, * FROM documents)
"""


@query("a11_scan_sources", PATHS + "SELECT path, text FROM f WHERE path LIKE '%.java' AND source <> 'src3' AND lang <> 'fr'")
def a11(t):
    return FS.scan_sources(content(t), ".java")[0]


@query("a11_scan_diagnostics", PATHS + "SELECT path, 'ERROR' AS severity, 'SOURCE_NOT_UTF8' AS code FROM f WHERE path LIKE '%.java' AND source <> 'src3' AND lang = 'fr'")
def a11_diagnostics(t):
    return FS.scan_sources(content(t), ".java")[1]


@query("a12_inventory", PATHS + """SELECT split_part(path, '/', 1) AS directory, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, bool_or(path LIKE '%.java') AS has_java,
    bool_or(path LIKE '%/17.%') AS has_marker FROM f GROUP BY 1""")
def a12(t):
    return FS.inventory(content(t), {"has_java": r"\.java$", "has_marker": r"/17\."})


@query("a13_write_jsonl", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, true AS ordered FROM orders")
def a13(t):
    path = K.scratch(t.spark, "sorted")
    K.write_jsonl(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), path, ["o_orderkey"])
    back = X.numbered_lines(t.spark, path).select("file", "line", F.get_json_object("value", "$.o_orderkey").cast("long").alias("k"))
    nxt = back.select("file", (F.col("line") - 1).alias("line"), F.col("k").alias("next"))
    return back.join(nxt, ["file", "line"], "left").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("k").alias("keys"), F.bool_and(F.coalesce(F.col("k") < F.col("next"), F.lit(True))).alias("ordered"))


@query("a14_manifest", PATHS + "SELECT path, CASE WHEN lang = 'fr' THEN sha256(encode(text) || '\\xC3'::BLOB) ELSE sha256(text) END AS sha256 FROM f")
def a14(t):
    return FS.manifest(content(t))


@query("a14_verify_manifest", PATHS + """SELECT path, 'HASH_MISMATCH' AS problem FROM f WHERE lang = 'fr' UNION ALL SELECT concat('gone/', doc_id), 'MISSING' FROM labels""")
def a14_verify(t):
    expected = content(t).select("path", F.col("doc_id")).join(t.documents.select("doc_id", F.sha2("text", 256).alias("sha256")), "doc_id").select("path", "sha256")
    gone = t.labels.select(F.concat(F.lit("gone/"), F.col("doc_id").cast("string")).alias("path"), F.lit("0").alias("sha256"))
    return FS.verify_manifest(content(t), expected.unionByName(gone))


@query("a15_combine_sets", """SELECT l_partkey AS node_id, min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS origin FROM lineitem GROUP BY 1""")
def a15(t):
    sets = [t.lineitem.filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("node_id"), F.lit(i).alias("origin")).distinct() for i, f in enumerate("ANR")]
    return K.combine(sets, "node_id")


@query("a15_combine_counters", """SELECT l_suppkey AS node_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS nodes, count(*) FILTER (l_returnflag = 'R') AS edges FROM lineitem GROUP BY 1""")
def a15_counters(t):
    one = t.lineitem.filter("l_returnflag <> 'R'").select(F.col("l_suppkey").alias("node_id"), F.col("l_quantity").cast("long").alias("nodes"))
    two = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("node_id"), F.col("l_quantity").cast("long").alias("nodes"), F.lit(1).alias("edges"))
    return K.combine_counters([one, two], "node_id", ["nodes", "edges"])
