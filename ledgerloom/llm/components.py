"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import stored

MOST_ROUNDS = 100  # a path of n nodes needs about log2(n) rounds


def _least(pairs: DataFrame) -> DataFrame:
    """For each ``u`` the smallest of itself and its ``v``; combined before the shuffle."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_least(both), "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node with a smaller one.

    ``links`` has the columns ``u`` and ``v``. Every round ends in a written table.
    """
    current = stored(_small_star(links.select("u", "v")), "links")
    told = None
    for _ in range(MOST_ROUNDS):
        row = current.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"),
        ).first()
        if row["n"] == 0 or (row["n"], row["sum"]) == told:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        told = (row["n"], row["sum"])
        current = stored(_small_star(_large_star(current)), "links")
    raise RuntimeError("the links have not settled")
