"""Journal streams over conversation turns written as journal files; each is drained to a table and read back."""

from pyspark.sql import functions as F

from pathloom.registry import query
from pathloom.sources.sinks import scratch
from pathloom.streaming import journal as S


def journal_files(t):
    """User turns start requests, the assistant turn after one answers it; first answers are written twice.

    A system turn is a note under another binding, and fails the request after it; a later user turn sets the one before aside.
    """
    c = t.conversations
    at = lambda step: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") + step).cast("string"))
    size, none = F.length("text").cast("long"), F.lit(None).cast("string")
    ts = F.timestamp_seconds(F.lit(1700000000) + F.col("turn") * 86400)

    def rows(where, event, key, outcome=none, binding="run"):
        return c.filter(where).select(
            F.lit(binding).alias("binding"), F.lit(event).alias("event"), key.alias("request_key"), "role", size.alias("reserved_tokens"), size.alias("charged_tokens"),
            outcome.alias("outcome"), ts.alias("ts"))

    answers = rows("role = 'assistant'", "response", at(-1))
    path = scratch(t.spark, "journal")
    rows("role = 'user'", "request_started", at(0)).unionByName(answers).write.json(path + "/a")
    rows("role = 'system'", "note", at(0), binding="other").write.json(path + "/b")
    rows("role = 'assistant' AND turn = 1", "response", at(-1)).write.json(path + "/c")
    failed = rows("role = 'system'", "request_outcome", at(1), F.lit("FAILED_HTTP"))
    failed.unionByName(rows("role = 'user' AND turn > 0", "request_outcome", at(-1), F.lit("UNKNOWN_QUARANTINED"))).write.json(path + "/d")
    return path


@query("k01_ingest_journal", """SELECT DISTINCT concat(conv_id, '-', CASE WHEN role = 'assistant' THEN turn - 1 ELSE turn END) AS request_key,
    CASE role WHEN 'user' THEN 'request_started' ELSE 'response' END AS event FROM conversations WHERE role <> 'system'
    UNION SELECT concat(conv_id, '-', turn + 1), 'request_outcome' FROM conversations WHERE role = 'system'
    UNION SELECT concat(conv_id, '-', turn - 1), 'request_outcome' FROM conversations WHERE role = 'user' AND turn > 0""")
def k01(t):
    stream = S.ingest(S.read_journal(t.spark, journal_files(t) + "/*"), "run")
    return S.drain(stream, scratch(t.spark, "ingest"), scratch(t.spark, "ingest-state")).select("request_key", "event")


@query("k01_refused_rows", "SELECT concat(conv_id, '-', turn) AS request_key, 'other' AS binding FROM conversations WHERE role = 'system'")
def k01_refused(t):
    stream = S.refused(S.read_journal(t.spark, journal_files(t) + "/*"), "run")
    return S.drain(stream, scratch(t.spark, "refused"), scratch(t.spark, "refused-state")).select("request_key", "binding")


@query("k02_settlement_stream", """WITH c AS (SELECT *, CAST(length(text) AS BIGINT) AS n FROM conversations),
    s AS (SELECT concat(conv_id, '-', turn) AS request_key, n FROM c WHERE role = 'user'),
    a AS (SELECT concat(conv_id, '-', turn - 1) AS request_key, max(n) AS total, max(turn) = 1 AS twice FROM c WHERE role = 'assistant' GROUP BY 1),
    o AS (SELECT request_key, min(outcome) AS outcome, min(outcome) <> max(outcome) AS conflict FROM (
        SELECT concat(conv_id, '-', turn + 1) AS request_key, 'FAILED_HTTP' AS outcome FROM c WHERE role = 'system'
        UNION ALL SELECT concat(conv_id, '-', turn - 1), 'UNKNOWN_QUARANTINED' FROM c WHERE role = 'user' AND turn > 0) GROUP BY 1),
    k AS (SELECT request_key FROM s UNION SELECT request_key FROM a UNION SELECT request_key FROM o)
    SELECT request_key, outcome, total IS NOT NULL AS settled, coalesce(total, 0) AS reported_tokens, CASE WHEN total IS NULL THEN coalesce(n, 0) ELSE 0 END AS open_reserve,
        total IS NULL AND outcome IS NULL AS active, total IS NULL AND outcome IS NOT NULL AS quarantined, total IS NULL AND coalesce(outcome = 'FAILED_HTTP', false) AS failed_http,
        coalesce(twice, false) AS duplicate_response, coalesce(conflict, false) AS conflict, n IS NULL AS without_start
    FROM k LEFT JOIN s USING (request_key) LEFT JOIN a USING (request_key) LEFT JOIN o USING (request_key)""")
def k02(t):
    stream = S.settle(S.read_journal(t.spark, journal_files(t) + "/*", files_per_trigger=4).filter("binding = 'run'"))
    rows = S.drain_updates(stream, scratch(t.spark, "settled"), scratch(t.spark, "settled-state"), "request_key")
    return rows.drop("duplicate_start").withColumn("failed_http", F.coalesce("failed_http", F.lit(False)))
