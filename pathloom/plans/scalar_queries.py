"""H: column functions over whole tables."""

from pyspark.sql import functions as F

from pathloom.bindings import oracle
from pathloom.functions import scalars as S
from pathloom.registry import query

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _lines(t, *extra):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *extra)


@query("h01_normalise_path", """
    SELECT p_partkey, concat('repo/', lower(p_name), '/part', CAST(p_partkey AS VARCHAR), '.java') AS path FROM part""")
def h01(t):
    raw = F.concat(
        F.when(F.col("p_size") % 3 == 0, "file:///").when(F.col("p_size") % 3 == 1, "./").otherwise("/"),
        F.lit("Repo/tmp/.././"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("%20")),
        F.lit("//Part"), F.col("p_partkey").cast("string"), F.lit(".java"),
    )
    return t.part.select("p_partkey", S.normalise_path(raw).alias("path"))


@query("h02_same_file", oracle("""
    SELECT p_partkey, p_size % 4 <> 3 AS same FROM part"""))
def h02(t):
    key = F.col("p_partkey").cast("string")
    left = F.concat(F.lit("a/b/P"), key, F.lit(".java"))
    right = (
        F.when(F.col("p_size") % 4 == 0, left).when(F.col("p_size") % 4 == 1, F.concat(F.lit("B/p"), key, F.lit(".java")))
        .when(F.col("p_size") % 4 == 2, F.concat(F.lit("/root/a/b/P"), key, F.lit(".java")))
        .otherwise(F.concat(F.lit("xP"), key, F.lit(".java")))
    )
    return t.part.select("p_partkey", S.same_file(S.normalise_path(left), S.normalise_path(right)).alias("same"))


@query("h03_repo_path", """
    SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN NULL WHEN n_chars % 5 = 1 THEN NULL WHEN n_chars % 5 = 2 THEN NULL
        ELSE concat(source, '/', CAST(doc_id AS VARCHAR), '.txt') END AS path FROM documents""")
def h03(t):
    base = F.concat("source", F.lit("/./"), F.col("doc_id").cast("string"), F.lit(".txt"))
    m = F.col("n_chars") % 5
    raw = (
        F.when(m == 0, F.concat(F.lit("/"), base)).when(m == 1, F.concat(F.lit("C:\\"), base))
        .when(m == 2, F.concat(F.lit("../"), base)).when(m == 3, F.replace(base, F.lit("/"), F.lit("\\"))).otherwise(base)
    )
    return t.documents.select("doc_id", S.repo_path(raw).alias("path"))


@query("h04_relativise", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CASE WHEN l_returnflag = 'N' THEN NULL ELSE concat('part/', CAST(l_partkey AS VARCHAR)) END AS path FROM lineitem""")
def h04(t):
    rel = F.concat(F.lit("part/"), F.col("l_partkey").cast("string"))
    raw = (
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("/srv/src/"), rel))
        .when(F.col("l_returnflag") == "A", rel).otherwise(F.concat(F.lit("/other/"), rel))
    )
    return _lines(t, S.relativise(raw, F.lit("/srv/src/")).alias("path"))


@query("h05_stable_id", """
    SELECT o_orderkey, concat('ord-', substr(sha256(concat('{"cust":', CAST(o_custkey AS VARCHAR), ',"kind":"',
        o_orderpriority, '","note":null,"order":', CAST(o_orderkey AS VARCHAR), '}')), 1, 24)) AS id FROM orders""")
def h05(t):
    fields = {"order": F.col("o_orderkey"), "kind": F.col("o_orderpriority"), "cust": F.col("o_custkey"), "note": F.lit(None).cast("string")}
    return t.orders.select("o_orderkey", S.stable_id("ord", fields).alias("id"))


@query("h06_safe_name", """
    SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '._'), ''), 'project') AS name FROM pages""")
def h06(t):
    return t.pages.select("page_id", S.safe_name(F.col("url")).alias("name"))


@query("h07_interval_distance", f"""
    SELECT {KEY}, d AS distance, CASE WHEN d = 0 THEN '0' WHEN d <= 5 THEN '1-5' WHEN d <= 20 THEN '6-20'
        WHEN d <= 100 THEN '21-100' ELSE '>100' END AS bucket
    FROM (SELECT *, CAST(CASE WHEN l_quantity BETWEEN 10 AND 20 THEN 0 WHEN l_quantity < 10 THEN 10 - l_quantity
        ELSE l_quantity - 20 END AS INT) AS d FROM lineitem)""")
def h07(t):
    d = S.interval_distance(F.col("l_quantity").cast("int"), F.lit(10), F.lit(20))
    return _lines(t, d.alias("distance"), S.line_bucket(d).alias("bucket"))


@query("h08_distance_bucket", f"""
    SELECT {KEY}, CASE WHEN l_linenumber = 7 THEN 'UNKNOWN' WHEN l_linenumber >= 5 THEN '3+' WHEN l_linenumber < 2 THEN 'UNKNOWN'
        ELSE CAST(l_linenumber - 2 AS VARCHAR) END AS bucket FROM lineitem""")
def h08(t):
    raw = F.when(F.col("l_linenumber") == 7, "n/a").otherwise((F.col("l_linenumber") - 2).cast("string"))
    return _lines(t, S.distance_bucket(raw).alias("bucket"))


@query("h09_find_value", "SELECT event_id, json_extract_string(props, '$.k') AS k, 'none' AS missing FROM events")
def h09(t):
    nested = t.events.select(
        "event_id", F.struct(F.array(F.struct(F.from_json("props", "k int").alias("inner"))).alias("items")).alias("record")
    )
    return nested.select(
        "event_id", S.find_value(nested.schema, "k").alias("k"), S.find_value(nested.schema, "absent", "none").alias("missing")
    )


@query("h10_optional_int", """
    SELECT event_id, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' THEN NULL ELSE user_id END AS n FROM events""")
def h10(t):
    raw = F.when(F.col("event_type") == "view", "  ").when(F.col("event_type") == "error", F.concat(F.lit("x"), F.col("user_id").cast("string")))
    return t.events.select("event_id", S.optional_int(raw.otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string")))).alias("n"))


@query("h11_rate", """
    SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN NULL ELSE round(c_acctbal / c_nationkey, 6) END AS rate FROM customer""")
def h11(t):
    return t.customer.select("c_custkey", S.rate(F.col("c_acctbal"), F.col("c_nationkey")).alias("rate"))


@query("h12_identities", """
    SELECT p_partkey, concat(p_brand, '.', p_name, '/', CAST(p_size AS VARCHAR)) AS callable,
        concat(p_brand, '.', p_name, '/', CAST(p_size AS VARCHAR), ' parameter ', p_type) AS parameter,
        concat(p_brand, '.', p_name, '/', CAST(p_size AS VARCHAR), '@src/', p_type, ':', CAST(p_partkey AS VARCHAR)) AS call FROM part""")
def h12(t):
    owner = S.callable_id(F.col("p_brand"), F.col("p_name"), F.col("p_size"))
    return t.part.select(
        "p_partkey", owner.alias("callable"), S.parameter_entity(owner, F.col("p_type")).alias("parameter"),
        S.call_id(F.concat_ws(".", "p_brand", "p_name"), F.col("p_size"), F.concat(F.lit("src/"), "p_type"), F.col("p_partkey")).alias("call"),
    )


@query("h13_param_list", """
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 3 = 1 THEN 2 ELSE 3 END AS n,
        CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN 'Map<String,List<Long>> a|int b'
        ELSE concat('@Named("x,y") ', p_type, ' c|int[] d|String... e') END AS params FROM part""")
def h13(t):
    body = (
        F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "Map<String,List<Long>> a, int b")
        .otherwise(F.concat(F.lit('@Named("x,y") '), "p_type", F.lit(" c, int[] d, String... e")))
    )
    sig = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("("), body, F.lit(")"))
    return t.part.select("p_partkey", S.param_count(sig).alias("n"), F.array_join(S.param_list(sig), "|").alias("params"))


@query("h14_erase_type", """
    SELECT p_partkey, concat('Map', ',', 'T', CAST(p_size AS VARCHAR), '[]') AS erased FROM part""")
def h14(t):
    raw = F.concat(F.lit("java.util.Map< java.lang.String , Long >, com.acme."), F.lit("T"), F.col("p_size").cast("string"), F.lit(" []"))
    return t.part.select("p_partkey", S.erase_type(raw).alias("erased"))


@query("h15_snippet", r"""
    SELECT doc_id, CASE WHEN length(s) > 500 THEN concat(substr(s, 1, 499), '…') ELSE s END AS snippet
    FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents)""")
def h15(t):
    return t.documents.select("doc_id", S.snippet(F.col("text")).alias("snippet"))


@query("h16_micros", "SELECT event_id, (CAST(round(value * 100) AS BIGINT) * 625 + 3) // 4 AS part_micros, "
       "CAST(CAST(value AS DECIMAL(18,2)) * 1000000 AS BIGINT) AS micros FROM events")
def h16(t):
    """A 64th of a value seldom comes out even, so the rounding up shows."""
    part = F.round(F.col("value") * 100) / 6400
    return t.events.select("event_id", S.micros(part).alias("part_micros"), S.micros(F.col("value")).alias("micros"))


@query("h17_module_of", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat('/mod', CAST(o_custkey AS VARCHAR)) END AS module,
        CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'com.acme' END AS package FROM orders""")
def h17(t):
    path = F.concat(F.lit("mod"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderstatus") == "P", "/lib/A.java").otherwise("/src/main/java/com/acme/A.java"))
    return t.orders.select("o_orderkey", S.module_of(path).alias("module"), S.package_of(path).alias("package"))


@query("h18_cwe_norm", """
    SELECT s_suppkey, concat('CWE-', CAST(s_nationkey AS VARCHAR)) AS cwe FROM supplier""")
def h18(t):
    return t.supplier.select("s_suppkey", S.cwe_norm(F.format_string("external/cwe/cwe-%03d", "s_nationkey")).alias("cwe"))


@query("h19_truthy", "SELECT event_id, event_type IN ('view', 'click') AS flag FROM events")
def h19(t):
    raw = F.when(F.col("event_type") == "view", " Yes ").when(F.col("event_type") == "click", "TRUE").when(F.col("event_type") == "error", F.lit(None)).otherwise("no")
    return t.events.select("event_id", S.truthy(raw).alias("flag"))


@query("h20_flow_type", """
    SELECT p_partkey, CASE WHEN p_size = 1 THEN 'LIBRARY_FLOW' WHEN p_type = 'PROMO' THEN 'CALLBACK_RELATION'
        WHEN p_type = 'LARGE' THEN 'FRAMEWORK_RELATION' ELSE 'LIBRARY_FLOW' END AS flow FROM part""")
def h20(t):
    name = F.when(F.col("p_type") == "PROMO", "onHandleEvent").when(F.col("p_type") == "LARGE", "run").otherwise("load")
    owner = F.when(F.col("p_type") == "LARGE", "RequestFilter")
    kind = F.when(F.col("p_size") == 1, "CONSTRUCTOR").otherwise("METHOD")
    return t.part.select("p_partkey", S.flow_type(kind, name, owner).alias("flow"))


@query("h21_wall_seconds", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
        ELSE round(CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS DOUBLE) / 1000000, 3) END AS seconds FROM events""")
def h21(t):
    end = F.when(F.col("event_type") == "error", "not a time").otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    return t.events.select("event_id", S.wall_seconds(F.lit("2024-01-01T00:00:00Z"), end).alias("seconds"))
