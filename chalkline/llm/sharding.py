"""Sharding by a k-d tree over document metadata, split at weighted medians until each leaf is one shard.

What is placed is a group of equal texts: its weight is the bytes of its rows, its place the metadata of its smallest id.
A cell is split along the dimension in which it is widest, at the key below which lies its share of the bytes. A key is
the value in that dimension and then a hash of the group, so that rows of one value can be split as well. The histogram
of a cell is added up on the executors, first by value, then by hash inside the value that holds the median; the driver
sees at most BINS sums for each cell. Groups that weigh much in one shard are placed first, largest first, each into the
lightest shard; the tree then fills every leaf up to the same bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

BITS = 12
BINS = 1 << BITS
HEAVY = 50  # a group of more than 1 / HEAVY of a shard is placed by itself; there are fewer than HEAVY * shards of them
DIMENSIONS = ("by_source", "by_lang", "by_size", "by_id")
SLOT_BINS = 1024


def _weighed(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    lacking = lambda c: F.lit(None).cast("string") if c not in docs.columns else F.col(c).cast("string")
    return docs.select(F.col("doc_id").cast("long"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).substr(1, 32).alias("grp"), lacking("source").alias("source"), lacking("lang").alias("lang"))


def _groups(rows: DataFrame) -> DataFrame:
    """(grp, weight, h, dimensions): one row for each text; every dimension is an integer below BINS."""
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "source", "lang", "size"))
    own = rows.groupBy("grp").agg(F.sum("size").alias("weight"), first.alias("f"))
    lo, hi = own.agg(F.min("f.doc_id"), F.max("f.doc_id")).first()
    span = max(1.0, float((hi or 0) - (lo or 0)))
    name = lambda c: F.coalesce(F.shiftright(F.crc32(c.cast("binary")), 32 - BITS), F.lit(0)).cast("int")
    by_size = F.least(F.lit(BINS - 1), F.floor(F.log2("f.size") * (BINS / 40))).cast("int")
    by_id = F.floor((F.col("f.doc_id") - F.lit(lo or 0)) / span * (BINS - 1)).cast("int")
    return own.select("grp", "weight", F.pmod(F.xxhash64("grp"), F.lit(BINS)).cast("int").alias("h"), name(F.col("f.source")).alias("by_source"), name(F.col("f.lang")).alias("by_lang"), by_size.alias("by_size"), by_id.alias("by_id"))


def _chosen(values: dict[int, object], key: str, cell: str = "cell") -> Column:
    """The entry of a small table, by cell; a column name or a number."""
    out = F.lit(None)
    for at, v in values.items():
        out = F.when(F.col(cell) == at, F.col(v) if key == "column" else F.lit(v)).otherwise(out)
    return out


def _cut(sums: list[tuple[int, float]], goal: float) -> tuple[int, float, float]:
    """The bin in which the running sum passes the goal, the sum before it and in it."""
    before = 0.0
    for at, w in sums:
        if before + w >= goal:
            return at, before, w
        before += w
    return (sums[-1][0], before - sums[-1][1], sums[-1][1]) if sums else (0, 0.0, 0.0)


def _tree(groups: DataFrame, room: list[float], n: int) -> DataFrame:
    """groups with shard: the leaves get bytes in proportion to room."""
    cells = {0: (0, len(room))}  # the leaves [from, to) below a cell
    rows, done = groups.withColumn("cell", F.lit(0)), {}
    while cells:
        for c, (a, b) in list(cells.items()):
            if b - a == 1:
                done[c] = a
                del cells[c]
        if not cells:
            break
        alive = rows.where(F.col("cell").isin(*cells))
        spread = {r.cell: r for r in alive.groupBy("cell").agg(F.sum("weight").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()}
        axis = {c: max(DIMENSIONS, key=lambda d: spread[c][d]) if c in spread else DIMENSIONS[0] for c in cells}
        part = {c: sum(room[a : (a + b) // 2]) / max(1e-9, sum(room[a:b])) for c, (a, b) in cells.items()}
        goal = {c: (spread[c].w * part[c] if c in spread else 0.0) for c in cells}
        value = _chosen(axis, "column").cast("int")

        def sums(frame: DataFrame, bin_: Column) -> dict[int, list[tuple[int, float]]]:
            out: dict[int, list[tuple[int, float]]] = {c: [] for c in cells}
            for r in frame.groupBy("cell", bin_.alias("bin")).agg(F.sum("weight").alias("w")).orderBy("cell", "bin").collect():
                out[r.cell].append((r.bin, float(r.w)))
            return out

        outer = {c: _cut(x, goal[c]) for c, x in sums(alive, value).items()}
        inner = {}
        for c, x in sums(alive.where(value == _chosen({c: o[0] for c, o in outer.items()}, "value")), F.col("h")).items():
            at, before, w = _cut(x, goal[c] - outer[c][1])
            over = abs(before + w - (goal[c] - outer[c][1])) <= abs(before - (goal[c] - outer[c][1]))
            inner[c] = at + 1 if over else at
        edge = F.struct(_chosen({c: o[0] for c, o in outer.items()}, "value").cast("int"), _chosen(inner, "value").cast("int"))
        right = F.struct(value, F.col("h").cast("int")) >= edge
        cells_next = {}
        moved = F.col("cell")
        for c, (a, b) in cells.items():
            cells_next[2 * c + 1], cells_next[2 * c + 2] = (a, (a + b) // 2), ((a + b) // 2, b)
        moved = F.when(F.col("cell").isin(*cells), F.when(right, 2 * F.col("cell") + 2).otherwise(2 * F.col("cell") + 1)).otherwise(F.col("cell"))
        rows = rows.withColumn("cell", moved)
        if len(cells_next) and max(cells_next) < 4 * len(room):
            rows = stored(rows, "cells", n)
        cells = cells_next
    return rows.withColumn("shard", _chosen(done, "value").cast("int"))


def kd_shards(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; the law is `bytes`.

    size: UTF-8 bytes of the text (none for null) plus 8. Rows of equal text share a shard unless their bytes exceed a
    whole shard: then its rows are placed one by one, since the law promises near equal bytes. slot counts the rows of a
    shard from 0 without gaps. Null metadata, missing columns and null ids count as the lowest value of a dimension.
    """
    rows = stored(_weighed(docs), "weighed")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    target = total / n_shards
    whole = _groups(rows)
    huge = [r.grp for r in whole.where(F.col("weight") > target).select("grp").collect()] if total else []  # fewer than n_shards
    if huge:
        single = F.concat_ws("/", "grp", F.col("doc_id").cast("string"), F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 30)).cast("string"))
        rows = stored(rows.withColumn("grp", F.when(F.col("grp").isin(huge), single).otherwise(F.col("grp"))), "weighed")
        whole = _groups(rows)
    groups = stored(whole, "groups", n)
    heavy = [(r.grp, r.weight) for r in groups.where(F.col("weight") > target / HEAVY).orderBy(F.desc("weight"), "grp").select("grp", "weight").collect()]
    load, placed = [0] * n_shards, {}
    for grp, weight in heavy:
        at = int(np.argmin(load))
        placed[grp] = at
        load[at] += weight
    level = max(target, *load)
    room = [max(0.0, target - x) for x in load] if max(load) <= target else [max(0.0, level - x) for x in load]
    light = groups.where(F.col("weight") <= target / HEAVY)
    shard_of = _tree(light, room, n).select("grp", "shard")
    if placed:
        fixed = groups.sparkSession.createDataFrame(list(placed.items()), "grp string, shard int")
        shard_of = shard_of.union(fixed)
    dealt = stored(rows.join(shard_of, "grp").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BINS)).cast("int").alias("bin")), "dealt", n)
    by_shard = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "bin").agg(F.count("*").alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(by_shard), F.lit(0))).select("shard", "bin", "skip")
    inside = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32", "size")) - 1
    return dealt.withColumn("own", inside).join(F.broadcast(offsets), ["shard", "bin"]).select("doc_id", "size", "text_crc32", "shard", (F.col("own") + F.col("skip")).cast("long").alias("slot"))
