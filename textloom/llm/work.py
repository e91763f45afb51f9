"""Shared-folder work tables, bucketed exchanges and Arrow batches for the llm operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources import tables
from textloom.sources.tables import shared_dir, spread, work_path

__all__ = ["ARROW_ROWS", "BUCKET_BYTES", "batches", "buckets", "fresh", "keep", "keep_by", "pieces", "release", "shared_dir", "spread", "text_of", "utf8", "work_path"]

#: Rows of an Arrow batch that are turned into Python objects at once; Spark bounds the batch itself by ``spark.sql.execution.arrow.maxBytesPerBatch``.
ARROW_ROWS = 512
#: Input bytes that one bucket of an exchange is planned for.
BUCKET_BYTES = 64 << 20


def pieces(parts: Iterable[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, without copies."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to the work folder and reads it back; also its path, for ``release``."""
    path = tables.write(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def keep_by(df: DataFrame, name: str, column: str) -> str:
    """Writes ``df`` to the work folder, a subfolder for each value of ``column``; returns the path."""
    return tables.write(df, name, column)


def release(spark: SparkSession, *paths: str) -> None:
    """Deletes work tables that no later step reads; what is left goes with the application."""
    for p in paths:
        tables.delete(spark, p)


def buckets(df: DataFrame) -> int:
    """Buckets for an exchange of ``df``: the shuffle partitions, or more where its scan is larger."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, size // BUCKET_BYTES) if size < 1 << 60 else least


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def batches(schema: pa.Schema, rows: Iterable[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``most`` bytes of strings and binaries."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 32 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if size >= most:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(name)
