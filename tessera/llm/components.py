"""Connected components by alternating large-star and small-star steps.

Each step is joins and grouped minima over (node, neighbour) rows; no group is
gathered anywhere, a hub's rows stay out of the shuffle, and every round is
made durable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, met_by_key


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """Each row with the least neighbour of its node."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
    return met_by_key(rows, least, ["u"], "c", total).drop("c")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = _with_least(both, 2 * n).withColumn("m", F.least("u", "m"))
    return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    moved = _with_least(edges, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(edges.groupBy("u").agg(F.min("v").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable, for every node with a link.

    Nulls and self-links are ignored; repeated links and empty input are fine.
    Rounds end when the stars no longer change.
    """
    edges = durable(links.where(F.col(a) != F.col(b))
                    .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        edges = durable(_large_star(edges, before[0]))
        edges = durable(_small_star(edges, before[0]))
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
