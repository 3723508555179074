"""Connected components of a link table by alternating large and small stars.

Links stay distributed; each round is an aggregation of minima (combined on the map side) and a join with them, in which
hubs (nodes with a thousandth of all link ends) are broadcast and all other nodes are shuffled. Rounds are written to the
shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import join_hot, materialise


def _with_least(ends: DataFrame, total: int) -> DataFrame:
    """u, v, m: the smallest of u and all its v."""
    least = ends.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_hot(ends, least, "u", "n", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. Links have u > v."""
    least = _with_least(edges, total)
    return least.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _print(edges: DataFrame) -> tuple:
    """What tells two link tables apart: their size and an order-free sum of hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])


def connected(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """edges: u, v (long, any order), at most about `rows`. Per node that has a link to a smaller one in its component: u, v = the smallest node reachable."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialise(now, "links", rows=rows)
    seen = _print(now)
    while n := seen[0]:  # a round gives no more links than it gets
        star = materialise(_large_star(now, n), "star", rows=n)
        now = materialise(_small_star(star, n), "links", rows=n)
        if (mark := _print(now)) == seen:
            break
        seen = mark
    return now
