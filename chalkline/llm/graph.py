"""Connected components of a link table by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lows", n)
    return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame, n: int) -> DataFrame:
    low = stored(e.groupBy("a").agg(F.min("b").alias("m")), "lows", n)
    moved = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link: component is the smallest node that can be reached.

    edges: two long columns; null ends and self links are ignored, repeated links count once. Minima are aggregated
    and written before they are joined back, so that a node with very many links meets only its own minimum, in a join of
    two plain exchanges that adaptive execution can split. Every round is written to the shared folder.
    """
    e = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    was = None
    while (now := _mark(e)) != was:
        was, old = now, e
        big = stored(_large_star(e, now[0]), "stars", now[0])
        e = stored(_small_star(big, now[0]), "stars", now[0])
        dropped(big)
        dropped(old)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
