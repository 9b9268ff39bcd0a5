"""Session helpers used by the entry point, the bench and the tests."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8, app: str = "paperloom") -> SparkSession:
    """A local session with UTC time and adaptive execution; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared checkpoint folder; one of our own only where none is set and Spark runs locally."""
    _checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="paperloom-"))
    return context.getCheckpointDir()


def tabled(rows: DataFrame) -> DataFrame:
    """``rows`` as a Parquet table in the shared checkpoint folder, much smaller than a checkpoint; the driver deletes it when
    it ends, and the shuffles behind it go once it is written."""
    spark = rows.sparkSession
    root = _checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/paperloom-table-{uuid.uuid4().hex[:12]}"
    free = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(free, "false")
    spark.conf.set(free, "true")
    try:
        rows.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(free, before)
    atexit.register(_delete, spark, path)
    return spark.read.schema(rows.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the scan has fewer parts than that (one file with one row group is one part).

    Only for plans whose work on a row far outweighs moving it; a large table has enough parts and is not moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
