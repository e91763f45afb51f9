"""Fingerprint deduplication in row order, and deduplication of prompt sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources import tables

#: Characters of a text's head that make its fingerprint, and of a shingle.
HEAD, SHINGLE = 200, 3


def fingerprint(text: Column) -> Column:
    """md5 of the sorted set of three-character shingles of the head; of the head itself if it is shorter; null for null."""
    head = F.substring(text, 1, HEAD)
    places = F.sequence(F.lit(1), F.greatest(F.length(head) - SHINGLE + 1, F.lit(1)))
    grams = F.transform(places, lambda i: F.substring(head, i, F.lit(SHINGLE)))
    joined = F.array_join(F.array_sort(F.array_distinct(grams)), "|")
    return F.when(text.isNotNull(), F.md5(F.when(F.length(head) < SHINGLE, head).otherwise(joined)))


def hashed(df: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows as ``own`` with their hashes, order and a number: what ``judged`` reads once it is written."""
    own = [F.col(f"`{c}`") for c in df.columns if c != "status"]
    hashes = {"fp": fingerprint(F.col(text)), "md5": F.md5(F.col(text)), "row": F.monotonically_increasing_id(), "o": F.col(order)}
    return df.select(F.struct(*own).alias("own"), *(c.alias(k) for k, c in hashes.items()))


def judged(rows: DataFrame) -> DataFrame:
    """The written rows of ``hashed`` with their ``status``."""
    key = F.coalesce("fp", F.lit(""))
    first = rows.groupBy(key.alias("key")).agg(F.min(F.struct("o", "md5", "row")).alias("first"))
    status = F.when(F.col("row") == F.col("first.row"), "unique").when(F.col("md5").eqNullSafe(F.col("first.md5")), "exact_dup").otherwise("near_dup")
    own = rows.schema["own"].dataType.names
    return rows.withColumn("key", key).join(first, "key").select(*(F.col("own").getField(c).alias(c) for c in own), status.alias("status"))


def dedup_status(df: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``status``: ``unique`` for the first row of a fingerprint, ``exact_dup`` for one with that row's text, ``near_dup`` for others.

    Equal texts have equal fingerprints and only first rows are kept, so this is what a pass in row order finds; of rows that share the order value one comes first.
    The rows are written once with their hashes. The first row of each fingerprint is a partial aggregate of narrow columns; a fingerprint that many rows share meets it
    in a join, which Spark may split. Only what a query selects is read again.

    Cases: null text has no fingerprint, so its rows are one group (the first is unique, the others are copies); null order values come first; a column of the rows
    named ``status`` is replaced.
    """
    return judged(tables.keep(hashed(df, order, text), "fingerprints"))


def new_prompts(batch: DataFrame, known: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows whose key is not known yet, the first of each; ``key`` is the prompt, or category and prompt."""
    first = batch.groupBy(*key).agg(F.min(order).alias(order))
    return first.join(known.select(*key).distinct(), key, "left_anti")


def first_per_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__place = 1").drop("__place")


FINGERPRINT_SQL = """md5(CASE WHEN length(left({t}, 200)) < 3 THEN left({t}, 200) ELSE
  array_to_string(list_sort(list_distinct(list_transform(range(1, length(left({t}, 200)) - 1), lambda i: substr(left({t}, 200), CAST(i AS INT), 3)))), '|') END)"""
