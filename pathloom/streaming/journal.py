"""Journal rows as streams: deduplicated ingest, and settlement of starts against responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.skew import first_by

JOURNAL = "binding string, event string, request_key string, role string, reserved_tokens bigint, charged_tokens bigint, outcome string, ts timestamp"


def read_journal(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of append-only JSONL journal files as a stream."""
    reader = spark.readStream.schema(JOURNAL)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def ingest(stream: DataFrame, binding: str) -> DataFrame:
    """Rows of one binding, each (request, event) once, however late a repeat comes: the state holds every pair seen."""
    return stream.filter(F.col("binding").eqNullSafe(binding)).dropDuplicates(["request_key", "event"])


def refused(stream: DataFrame, binding: str) -> DataFrame:
    """Rows of any other binding, which no account may take in."""
    return stream.filter(~F.col("binding").eqNullSafe(binding))


def settle(stream: DataFrame) -> DataFrame:
    """One row per request with the columns of the batch settlement, brought up to date by every new row of it.

    A running aggregate by request: a response or an outcome counts whenever it comes. The state is one row a request.
    """
    of = lambda event, value: F.when(F.col("event") == event, value)
    seen = stream.groupBy("request_key").agg(
        F.count(of("request_started", 1)).alias("starts"), F.count(of("response", 1)).alias("answers"),
        F.min(of("request_started", F.struct("ts", "reserved_tokens"))).alias("first"), F.max(of("response", F.col("charged_tokens"))).alias("total_tokens"),
        F.min(of("request_outcome", F.col("outcome"))).alias("outcome"), F.max(of("request_outcome", F.col("outcome"))).alias("other"))
    settled, quarantined = F.coalesce(F.col("total_tokens") >= 0, F.lit(False)), (F.col("answers") == 0) & F.col("outcome").isNotNull()
    return seen.select(
        "request_key", "outcome", settled.alias("settled"), F.when(settled, F.col("total_tokens")).otherwise(0).alias("reported_tokens"),
        F.when(~settled, F.coalesce("first.reserved_tokens", F.lit(0))).otherwise(0).alias("open_reserve"), (~settled & F.col("outcome").isNull()).alias("active"),
        quarantined.alias("quarantined"), (quarantined & (F.col("outcome") == "FAILED_HTTP")).alias("failed_http"),
        (F.col("starts") > 1).alias("duplicate_start"), (F.col("answers") > 1).alias("duplicate_response"),
        F.coalesce(F.col("outcome") != F.col("other"), F.lit(False)).alias("conflict"), (F.col("starts") == 0).alias("without_start"))


def drain_updates(stream: DataFrame, out: str, checkpoint: str, key: str) -> DataFrame:
    """Run a running aggregate over all files present and read the last state of each key.

    Every batch writes the keys it changed under its own number, so a batch that runs again replaces itself.
    """
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema, T.StructField("batch", T.LongType())])
    return first_by(stream.sparkSession.read.schema(schema).parquet(out), [key], ["batch"], last=True).drop("batch")


def drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over all files present, append to ``out``, and read the result back."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
