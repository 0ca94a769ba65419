"""Connected components by alternating large-star and small-star rounds, all in DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _fixed(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (
        both.join(least, "u").where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """Maps every node of links(u, v) to the least node of its component: columns node, component.

    Self links and nulls are ignored; nodes without links are not listed. The number of rounds grows with
    the logarithm of the longest chain. Each round writes its edges to the shared folder, so a lost executor
    costs one round at most; only two numbers a round reach the driver. A node with very many links is a
    skewed join key, which adaptive execution splits; the minima are combined before the shuffle.
    """
    edges = stage(links.select("u", "v").where("u <> v").distinct())
    seen = _fixed(edges)
    while seen[0]:
        edges = stage(_small_star(_large_star(edges)))
        now = _fixed(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
