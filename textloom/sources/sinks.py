"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; text is not escaped beyond what JSON asks."""
    df.write.mode(mode).json(path)


def raw_lines(df: DataFrame, path: str, value: str = "value") -> None:
    """The lines as they were read."""
    df.select(value).write.text(path)


def texts(df: DataFrame, path: str, text: str = "text") -> None:
    """Records of the stripped text only."""
    from textloom.functions.text import strip

    df.select(strip(F.col(text)).alias("text")).write.json(path)


def append(df: DataFrame, path: str) -> None:
    """Adds a job's rows; Spark commits them together, so no lock is needed."""
    json_lines(df, path, "append")


def one_file(df: DataFrame, path: str) -> None:
    """A report of few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def comparison(report: DataFrame, samples: DataFrame, path: str) -> None:
    """A comparison's figures to ``path.json`` and its samples, where there are any, to ``path_samples.json``."""
    one_file(report, f"{path}.json")
    if not samples.isEmpty():
        json_lines(samples, f"{path}_samples.json", "overwrite")


def show_table(df: DataFrame, rows: int = 100) -> None:
    df.show(rows, truncate=False)
