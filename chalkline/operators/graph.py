"""Graphs of any size: nothing is gathered in one task or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.plans.scratch import stored


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, root) of every node of nodes(v): the smallest node that edges(a, b) connect it with.

    Each round a node takes the least label around it and then the label of that label, so that long chains halve; the
    minima are aggregated before they are joined. Labels go through a table each round.
    """
    hops = stored(edges.where("a <> b").select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct(), "hops")
    labels, was = stored(nodes.select("v", F.col("v").alias("root")), "labels"), None
    while (now := labels.agg(F.sum("root").cast("string")).first()[0]) != was:
        was = now
        around = hops.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("low"))
        taken = stored(labels.join(around, "v", "left").select("v", F.least("root", F.coalesce("low", "root")).alias("root")), "labels")
        jump = taken.select(F.col("v").alias("root"), F.col("root").alias("further"))
        labels = stored(taken.join(jump, "root").select("v", F.least("root", "further").alias("root")), "labels")
    return labels


def euler_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (v, e, pieces, faces, chi, dangles) of a graph nodes(v), edges(a, b) of any size, equal edges once."""
    links = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").count()
    n = component_labels(nodes, links).agg(F.count("*").alias("v"), F.count_distinct("root").alias("pieces"))
    counts = n.crossJoin(links.agg(F.count("*").alias("e"))).crossJoin(degree.agg(F.count_if(F.col("count") == 1).alias("dangles")))  # single rows
    return counts.select("v", "e", "pieces", (F.col("e") - F.col("v") + F.col("pieces")).alias("faces"), (F.col("v") - F.col("e")).alias("chi"), "dangles")
