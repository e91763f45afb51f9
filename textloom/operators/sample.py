"""Ordered sampling: prefix sums without one big partition, budgets, seeded order, paging, interleaving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources import tables


def ranges(df: DataFrame, *keys: str, written: bool = False) -> DataFrame:
    """The rows dealt to ranges of the keys, with their range as ``__range``, as a written table.

    They are written before too, unless ``df`` already reads a written table, since the choice of the ranges reads them once more; so ``df`` should hold no more than is needed.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df if written else tables.keep(df, "rows")
    return tables.keep(rows.repartitionByRange(n, *keys).withColumn("__range", F.spark_partition_id()), "ranges")


def prefix_sums(df: DataFrame, order: str, sums: dict[str, str], tie: list[str] | None = None, written: bool = False) -> DataFrame:
    """Adds the inclusive running sums by ``order`` and then ``tie``: of each value (its column) under its new name.

    Sums run within ranges of the order, and the ranges' totals, one row each, give every range its offset. Null values count as 0, null orders come first.
    """
    keys = [order, *(tie or [])]
    ranged = ranges(df, *keys, written=written)
    totals = ranged.groupBy("__range").agg(*(F.sum(value).alias(f"__total_{out}") for out, value in sums.items()))  # one row a range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", *(F.coalesce(F.sum(f"__total_{out}").over(before), F.lit(0)).alias(f"__before_{out}") for out in sums))
    own = Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select("*", *(F.coalesce(F.sum(value).over(own), F.lit(0)).alias(f"__own_{out}") for out, value in sums.items())).join(F.broadcast(offsets), "__range")
    return summed.select(*df.columns, *((F.col(f"__own_{out}") + F.col(f"__before_{out}")).alias(out) for out in sums))


def prefix_sum(df: DataFrame, order: str, value: str, out: str, tie: list[str] | None = None, written: bool = False) -> DataFrame:
    """Adds one running sum, as ``prefix_sums`` does."""
    return prefix_sums(df, order, {out: value}, tie, written)


def number_within(df: DataFrame, key: str, order: Column, out: str) -> DataFrame:
    """Adds the row number within ``key`` by ``order``, from 1. A key with most of the rows is dealt to many ranges, like the order itself.

    The rows are written once; only key, order and a number of the row are ranged, and meet the rows by that number.
    """
    rows = tables.keep(df.select("*", order.alias("__order"), F.monotonically_increasing_id().alias("__row")), "rows")
    ranged = ranges(rows.select("__row", F.col(key).alias("__key"), "__order"), "__key", "__order", "__row", written=True)
    totals = ranged.groupBy("__key", "__range").agg(F.count(F.lit(1)).alias("__n"))  # each range holds a run of keys, so these are ranges plus keys
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("__key").alias("__k"), F.col("__range").alias("__part"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")).where("__before > 0")
    place = F.row_number().over(Window.partitionBy("__key", "__range").orderBy("__order", "__row"))
    met = F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__range") == F.col("__part"))
    numbered = ranged.withColumn("__own", place).join(offsets, met, "left").select("__row", (F.col("__own") + F.coalesce("__before", F.lit(0))).alias(out))
    return rows.join(numbered, "__row").drop("__row", "__order")


def number_rows(df: DataFrame, order: str, out: str) -> DataFrame:
    """Adds the row number by ``order``, from 1, the same way."""
    return prefix_sum(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", out).drop("__one")


def token_budget(df: DataFrame, order: str, tokens: str, target: int) -> DataFrame:
    """The rows of the prefix up to and with the row that reaches the target."""
    return prefix_sum(df, order, tokens, "running").where(F.col("running") - F.col(tokens) < target)


def estimated_tokens(text: Column, per: float = 1.5) -> Column:
    """Characters by the estimate of characters a token, cut to a whole number."""
    return F.floor(F.length(text) / per).cast("long")


def counted_tokens(text: Column, count: Callable[[Column], Column] | None = None) -> Column:
    """Tokens by the estimate, or by a counter that is passed in: a function of columns, or a pandas UDF such as ``tokens.bpe_count``."""
    return estimated_tokens(text) if count is None else count(text).cast("long")


def seeded(key: Column, seed: int) -> Column:
    """A key's place in a seeded shuffle: a hash, the same in every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def skip_batches(df: DataFrame, order: str, size: int, skip: int) -> DataFrame:
    """Rows by batches of ``size`` in order, without the first ``skip``; the short tail stays."""
    numbered = number_rows(df, order, "row_no")
    batch = F.floor((F.col("row_no") - 1) / size).cast("long")
    return numbered.withColumn("batch", batch).where(F.col("batch") >= skip)


def interleave(first: DataFrame, second: DataFrame, draws: DataFrame) -> DataFrame:
    """Two ordered streams merged by draws (step, take_first): place and side of every row.

    A draw takes the next row of its side, or of the other if its own has run out. So rows follow the draws' ranks on each side until a draw meets an
    empty side; from there the other side's rest follows in order. Streams have (rank, id) with ranks from 1.
    """
    ranked = draws.select("step", "take_first", F.col("take_first").cast("long").alias("f"), F.lit(1).cast("long").alias("one"))
    ranked = prefix_sums(ranked, "step", {"n": "one", "nf": "f"}).withColumn("ns", F.col("n") - F.col("nf"))
    sizes = first.agg(F.count(F.lit(1)).alias("cf")).crossJoin(second.agg(F.count(F.lit(1)).alias("cs")))  # one row each
    ranked = ranked.crossJoin(F.broadcast(sizes))
    stop = ranked.where((F.col("nf") > F.col("cf")) | (F.col("ns") > F.col("cs"))).agg(F.min("step").alias("stop"), F.min(F.struct("step", "nf", "ns")).alias("at"))
    out = []
    for name, side, own, size in (("first", first, "nf", "cf"), ("second", second, "ns", "cs")):
        taken = ranked.where(F.col("take_first") if name == "first" else ~F.col("take_first")).select(F.col(own).alias("rank"), F.col("n").alias("place"))
        # after the stop the other side is empty, so places run on by rank
        shift = stop.crossJoin(F.broadcast(sizes)).select(F.when(F.col(f"at.{own}") <= F.col(size), F.col("cs" if own == "nf" else "cf")).alias("other"), F.when(F.col(f"at.{own}") <= F.col(size), F.col(f"at.{own}")).alias("from_rank"))
        rows = side.join(taken, "rank", "left").crossJoin(F.broadcast(shift))
        place = F.when(F.col("from_rank").isNotNull() & (F.col("rank") > F.col("from_rank")), F.col("rank") + F.col("other")).otherwise(F.coalesce("place", F.col("rank") + F.col("other")))
        out.append(rows.select("id", F.lit(name).alias("side"), place.alias("place")))
    return out[0].unionByName(out[1])
