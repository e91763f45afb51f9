"""JSON-lines scans with an explicit row order, and their counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textloom.operators import sample

CORRUPT = "_corrupt"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, place): a file's lines; ordered by file, block start and place within the block's task."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def parsed(value: Column, schema: StructType, mode: str = "PERMISSIVE") -> Column:
    """A line as a record; what does not parse to an object is kept in ``_corrupt``."""
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    return F.from_json(value, full, {"mode": mode, "columnNameOfCorruptRecord": CORRUPT})


def _read(df: DataFrame, schema: StructType, value: str) -> DataFrame:
    blank = F.regexp_replace(F.col(value), r"(?U)[\s\x1c-\x1f]", "") == ""
    bad = blank | F.col("__r").isNull() | F.col(f"__r.{CORRUPT}").isNotNull()
    return df.withColumn("__r", parsed(F.col(value), schema)).withColumns({"blank": blank, "json_error": F.coalesce(bad, F.lit(True))})


def tolerant(df: DataFrame, schema: StructType, value: str = "value") -> DataFrame:
    """All lines with their record's columns; blank and broken ones have ``json_error`` set and null columns."""
    read = _read(df, schema, value)
    return read.select(*df.columns, "json_error", *(F.when(~F.col("json_error"), F.col(f"__r.{f.name}")).alias(f.name) for f in schema.fields))


def blank_skipping(df: DataFrame, schema: StructType, value: str = "value") -> DataFrame:
    """The lines that are not blank, with ``json_error``."""
    return tolerant(df, schema, value).where(F.regexp_replace(F.col(value), r"(?U)[\s\x1c-\x1f]", "") != "")


def strict(df: DataFrame, schema: StructType, value: str = "value") -> DataFrame:
    """Blank lines are skipped, a broken one fails the job."""
    kept = df.where(F.regexp_replace(F.col(value), r"(?U)[\s\x1c-\x1f]", "") != "")
    return kept.withColumn("__r", F.from_json(value, schema, {"mode": "FAILFAST"})).select(*df.columns, *(F.col(f"__r.{f.name}").alias(f.name) for f in schema.fields))


def records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON data set with a given schema."""
    return spark.read.schema(schema).json(path)


def line_at(df: DataFrame, number: int, order: str = "line_no") -> DataFrame:
    """The record with an ordinal."""
    return df.where(F.col(order) == number)


def index(df: DataFrame, value: str = "value") -> DataFrame:
    """The lines that are not blank with their number as ``record``, from 0 in file order."""
    return numbered(df.where(F.regexp_replace(F.col(value), r"(?U)[\s\x1c-\x1f]", "") != "")).withColumnRenamed("line_no", "record")


def lookup(indexed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose numbers a table (record) names."""
    return indexed.join(wanted.select("record").distinct(), "record", "left_semi")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``line_no`` from 0 in file order, by counts of the files' blocks."""
    counts = df.groupBy("file", "block").agg(F.count(F.lit(1)).alias("__n"))  # one row a block
    offsets = sample.prefix_sum(counts.withColumn("__at", F.struct("file", "block")), "__at", "__n", "__end").select("file", "block", (F.col("__end") - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("place"))
    return df.withColumn("__p", place).join(offsets, ["file", "block"]).withColumn("line_no", F.col("__before") + F.col("__p") - 1).drop("__p", "__before")
