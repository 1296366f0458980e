"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the plans are designed for.  They are Spark's own
# adaptive-execution switches: runtime re-planning, partition coalescing,
# skew-join splitting and runtime broadcast conversion from *measured* sizes.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
}


# Spark's own switch: a query's shuffle files go when the query has ended, not when the driver collects its plan.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# Output files that a task keeps open at once instead of sorting its rows by folder first.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """``key`` has ``value`` inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Writes inside leave no shuffle files: what they wrote is read back from its files, never from their shuffles."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "profilebook") -> SparkSession:
    """Local/test session.  On a cluster the submitter's session is used as is."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in ADAPTIVE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only when it is unset (local tests) a
    fresh scratch folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="profilebook-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Lineage ends there, any executor can read it, and plans over it know its true size (a checkpoint keeps an estimate).
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
