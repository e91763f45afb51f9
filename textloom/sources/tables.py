"""Table scans, work tables and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A table that the program itself holds: questions, personas, categories, criteria."""
    return spark.createDataFrame(rows, schema)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a scan has fewer partitions than cores; a larger scan, or a plan with shuffles of its own, stays as it is."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # asking it for its partitions would run its shuffles
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.execute().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's work folder, which goes with the driver's JVM."""
    folder = f"{shared_dir(spark)}/textloom-{spark.sparkContext.applicationId}"
    path, store = _path(spark, folder)
    if store.mkdirs(path):
        store.deleteOnExit(path)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, name: str, by: str | None = None) -> str:
    """Writes ``df`` to the work folder, with a subfolder for each value of ``by``; returns the path. The shuffle files of the write go at its end."""
    spark = df.sparkSession
    path = work_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the work folder and reads it back: it is evaluated once, and lineage ends here."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))


def delete(spark: SparkSession, name: str) -> None:
    path, store = _path(spark, name)
    store.delete(path, True)
