"""Functions called as a stream runs: after each batch that reports figures, and at its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Callbacks(StreamingQueryListener):
    """Calls ``on_log(batch, figures)`` with the figures that a batch observed, by name, and ``on_end(error)`` once, with None if the stream ended well."""

    def __init__(self, on_log: Callable[[int, dict], None] | None = None, on_end: Callable[[str | None], None] | None = None):
        self.log, self.end = on_log, on_end

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        figures = {name: row.asDict() for name, row in event.progress.observedMetrics.items()}
        if self.log and figures:
            self.log(event.progress.batchId, figures)

    def onQueryTerminated(self, event) -> None:
        if self.end:
            self.end(event.exception)


def listen(spark: SparkSession, callbacks: Callbacks) -> Callable[[], None]:
    """Adds the callbacks to all streams that start from now on; returns what takes them off again."""
    spark.streams.addListener(callbacks)
    return lambda: spark.streams.removeListener(callbacks)
