"""Structured Streaming forms of cleansing, deduplication and packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.functions import text as T
from textloom.operators import clean, dedup, scrub

_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch at most, since documents may be long.
RECORDS = 1_000


def read(spark: SparkSession, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, some files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def cleansed(stream: DataFrame) -> DataFrame:
    """Rows cleaned, scrubbed once, and deduplicated by fingerprint: whichever row of one comes first stays.

    Without an event time the state holds every fingerprint; give the stream a watermark to bound it.
    """
    own = stream.where(F.length(F.coalesce("text", F.lit(""))) >= 50).select("doc_id", T.held(clean.clean(F.col("text"))).alias("text")).where(F.length("text") >= 50)
    return scrub.scrub(own).withColumn("fp", dedup.fingerprint(F.col("text"))).dropDuplicates(["fp"])


def packed(stream: DataFrame, key: str, length: int, encode: Callable[[str], np.ndarray] | None = None) -> DataFrame:
    """Chunks of ``length`` ids of each shard's documents, in arrival order; the open chunk is the shard's state. Null documents have no ids.

    Documents are (key, ids), or (key, text) with ``encode``, which makes a text's ids: then texts go through the shuffle. Each Arrow batch of documents is handed on
    as it is packed, so that no more is held of a shard.
    """
    name = "text" if encode else "ids"

    def step(shard: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = (np.array(state.get[0], dtype="int32"), state.get[1]) if state.exists else (np.empty(0, dtype="int32"), 0)
        for part in parts:
            own = [encode(x) if encode else np.asarray(x, dtype="int32") for x in part[name] if x is not None]
            whole = np.concatenate([held, *own])
            full = len(whole) // length
            chunks = whole[: full * length].reshape(full, length)
            for i in range(0, full, RECORDS):
                rows = chunks[i : i + RECORDS].tolist()  # Spark lists the rows anyhow, and Python's own numbers take less than NumPy's
                yield pd.DataFrame({"shard": shard[0], "chunk": np.arange(n + i, n + i + len(rows)), "input_ids": rows})
            held, n = whole[full * length :], n + full
        state.update((held.tolist(), n))

    return stream.groupBy(key).applyInPandasWithState(step, "shard long, chunk long, input_ids array<int>", "held array<int>, n long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all there is, once; a restart goes on from the checkpoint."""
    conf = stream.sparkSession.conf
    before = conf.get(_RECORDS)
    conf.set(_RECORDS, min(int(before), RECORDS) if int(before) > 0 else RECORDS)  # a stream takes the settings of its start
    try:
        writer = stream.writeStream.format("parquet").option("path", out).option("compression", "zstd").option("checkpointLocation", checkpoint)
        query = writer.outputMode(mode).trigger(availableNow=True).start()
    finally:
        conf.set(_RECORDS, before)
    query.awaitTermination()
