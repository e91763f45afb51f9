"""Data sets of a hub, read from a local mirror; no network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def dataset(spark: SparkSession, root: str, name: str, schema, streaming: bool = False, files_per_trigger: int = 8) -> DataFrame:
    """The data set ``root/name.parquet``, one file or a folder of files, as a table or as a stream over the files that there are."""
    path = f"{root}/{name}.parquet"
    if not streaming:
        return spark.read.schema(schema).parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    one = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(root) if one else stream.parquet(path)
