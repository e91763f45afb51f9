"""Bookkeeping of generated data: quotas, gaps, batches, sequence numbers, assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import sample


def gaps(targets: DataFrame, done: DataFrame, key: str = "category") -> DataFrame:
    """(key, target, done, gap) of every category of the dimension; rows of other categories do not count."""
    counts = done.groupBy(key).agg(F.count(F.lit(1)).alias("done"))
    joined = targets.join(counts, key, "left").fillna(0, ["done"])
    return joined.select(key, "target", "done", F.greatest(F.col("target") - F.col("done"), F.lit(0)).alias("gap"))


def with_total(report: DataFrame, key: str = "category") -> DataFrame:
    """The report with a row of totals."""
    sums = report.agg(F.lit("total").alias(key), *(F.sum(c).alias(c) for c in report.columns if c != key))
    return report.unionByName(sums)


def request_batches(gap: DataFrame, size: int = 200) -> DataFrame:
    """A row for each request: batch number and how many to ask for; the last asks for the rest."""
    n = F.ceil(F.col("gap") / size).cast("int")
    rows = gap.where("gap > 0").withColumn("batch", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("ask", F.least(F.lit(size), F.col("gap") - F.col("batch") * size).cast("long"))


def continued(new: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ``sample_idx``: numbers that go on from each category's existing rows, from 1."""
    counts = existing.groupBy(key).agg(F.count(F.lit(1)).alias("__have"))
    numbered = sample.number_within(new, key, F.col(order), "__place")
    return numbered.join(counts, key, "left").withColumn("sample_idx", F.col("__place") + F.coalesce("__have", F.lit(0))).drop("__place", "__have")


def remaining(prompts: DataFrame, done: DataFrame, targets: DataFrame, key: str, order: str) -> DataFrame:
    """Prompts of each category from the number done up to the target, by position."""
    counts = done.groupBy(key).agg(F.count(F.lit(1)).alias("__have"))
    rows = sample.number_within(prompts, key, F.col(order), "place").join(targets, key).join(counts, key, "left")
    return rows.where((F.col("place") > F.coalesce("__have", F.lit(0))) & (F.col("place") <= F.col("target"))).drop("__have")


def shuffled_take(df: DataFrame, key: str, draw: Column, need: DataFrame) -> DataFrame:
    """As many rows of each category as ``need`` (key, gap) says, in the order of ``draw``."""
    return sample.number_within(df, key, draw, "place").join(need.select(key, "gap"), key).where(F.col("place") <= F.col("gap")).drop("gap")


def assigned(key: Column, names: list[str], seed: int) -> Column:
    """One of the names for each key, by a hash that every engine has."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 7)
    return F.element_at(F.array(*(F.lit(n) for n in names)), (F.conv(digits, 16, 10).cast("long") % len(names) + 1).cast("int"))


def guide(category: Column, guides: dict[str, str], default: str) -> Column:
    """A category's guide text, or the default."""
    table = F.create_map(*(F.lit(x) for pair in guides.items() for x in pair))
    return F.coalesce(F.try_element_at(table, category), F.lit(default))
