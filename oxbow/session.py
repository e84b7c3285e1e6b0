"""Session helpers: builder, table loading, checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "querystats", "sqlstart", "sqlstop", "processlog",
    "stackslog", "stacks", "sysmodules", "common_words",
)


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for local runs; on a cluster the submitter's settings stand."""
    b = (
        SparkSession.builder.master(master)
        .appName("oxbow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temp views over the given tables (all known tables if none are named)."""
    for n in names or TABLES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only in a local session that names none (tests).

    A cluster's executors can't see a folder of one machine: there the session must name it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master or "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="oxbow-ck-"))
    return sc.getCheckpointDir()


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def set_priority(spark: SparkSession, level: str | None) -> None:
    """Run this thread's queries in the fair-scheduler pool of a priority (low, medium, high), or in the default one."""
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", level)


def spread(df: DataFrame) -> DataFrame:
    """The frame over all cores where its files make fewer tasks than there are cores (small inputs before Python work); else as it is.

    Judged by the planner's estimate of the input's bytes: nothing is planned twice or run.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores) if size < cores * split else df
