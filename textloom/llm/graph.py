"""Connected components of a table of links, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import work


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every node of ``links`` (a, b: longs) that has a smaller node in its component; root is the smallest.

    Rounds of hooking and contraction: each node hooks to its smallest smaller neighbour, the trees are flattened by pointer
    doubling, and links between the roots go to the next round. Every table is written to the shared folder. The hooking is a partial
    aggregate; joins meet a hub on one side only, as many narrow rows that Spark may split.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path = work.keep(edges, "links")
    paths, total = [path], None
    while not edges.isEmpty():
        parent, path = work.keep(edges.groupBy("a").agg(F.min("b").alias("b")), "hooks")
        paths.append(path)
        parent, more = _flatten(parent)
        paths += more
        total = parent if total is None else _follow(total, parent).unionByName(parent)
        total, path = work.keep(total, "roots")
        paths.append(path)
        own = parent.select(F.col("a").alias("x"), F.col("b").alias("y"))
        # every a has hooked; a b that is a root stays
        moved = edges.join(own, F.col("a") == F.col("x")).select(F.col("y").alias("a"), "b")
        moved = moved.where("a <> b").distinct()
        moved = moved.join(own, F.col("b") == F.col("x"), "left").select("a", F.coalesce("y", "b").alias("b"))
        moved = moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges, path = work.keep(moved, "links")
        paths.append(path)
    if total is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out, _ = work.keep(total.select(F.col("a").alias("id"), F.col("b").alias("root")), "components")
    work.release(links.sparkSession, *paths)
    return out


def _follow(table: DataFrame, parent: DataFrame) -> DataFrame:
    """The table's b replaced by b's own parent where it has one."""
    own = parent.select(F.col("a").alias("x"), F.col("b").alias("y"))
    return table.join(own, F.col("b") == F.col("x"), "left").select("a", F.coalesce("y", "b").alias("b"))


def _flatten(parent: DataFrame) -> tuple[DataFrame, list[str]]:
    """Pointer doubling until every parent is a root."""
    paths = []
    while not parent.join(parent.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi").isEmpty():
        parent, path = work.keep(_follow(parent, parent), "jumps")
        paths.append(path)
    return parent, paths
