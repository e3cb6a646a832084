"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on; a cluster may override any of them.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(name: str = "pathloom", cpus: str | int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings the session."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or 8
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        **ADAPTIVE,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.log.level": "ERROR",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's own setting, else a local one on local masters."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        configured = tempfile.mkdtemp(prefix="pathloom-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


#: A query begun under this setting gives its shuffle files back as it ends, not when the driver next collects garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """For queries whose result outlives them as a table: what they shuffled is not read again."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder so later rounds neither recompute it nor depend on executors."""
    checkpoint_dir(df.sparkSession)
    with freeing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back: for wide rows that later steps read in part, and often."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    with freeing(df.sparkSession):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def some(df: DataFrame) -> bool:
    """Whether ``df`` has any row."""
    with freeing(df.sparkSession):
        return df.limit(1).count() > 0
