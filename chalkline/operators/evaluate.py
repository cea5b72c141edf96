"""How answers compare with the truth, and what plainer methods answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chalkline.operators import judge as J
from chalkline.operators import planar as P
from chalkline.plans.scratch import stored

D = P.D


def tally(rows: DataFrame, by: list[str], answer: str = "answer", truth: str = "truth") -> DataFrame:
    """(by, wrong, exact, refused): a null answer is a refusal."""
    a, t = F.col(answer), F.col(truth)
    return rows.groupBy(*by).agg(F.count_if(a.isNotNull() & (a != t)).alias("wrong"), F.count_if(a.isNotNull() & (a == t)).alias("exact"), F.count_if(a.isNull()).alias("refused"))


def first_wrong(rows: DataFrame, by: list[str], order: list[str], answer: str = "answer", truth: str = "truth") -> DataFrame:
    """(by, order, truth, answer): of each group the first row in order whose answer is wrong."""
    wrong = rows.where(F.col(answer) != F.col(truth)).select(*by, F.struct(*order, truth, answer).alias("_r"))
    return wrong.groupBy(*by).agg(F.min("_r").alias("_r")).select(*by, "_r.*")


def agreement(found: DataFrame, methods: dict[str, DataFrame], step: int = 1) -> DataFrame:
    """(method, checked, agree, disagree): the faces of every step-th certified drawing against (drawing_id, faces) of others.

    A method that says nothing of a drawing disagrees.
    """
    held = stored(every(found.where("status = 'CERTIFIED'").select(D, "faces"), step, [D]), "certified")
    rows = None
    for name, says in methods.items():
        own = held.join(says.toDF(D, "_says"), D, "left").select(F.lit(name).alias("method"), F.col("faces").eqNullSafe(F.col("_says")).alias("same"))
        rows = own if rows is None else rows.union(own)
    return rows.groupBy("method").agg(F.count("*").alias("checked"), F.count_if("same").alias("agree"), F.count_if(~F.col("same")).alias("disagree"))


def histogram(rows: DataFrame, levels: list[str], total: int | None = None) -> DataFrame:
    """(levels, n, percent): counts with subtotals, largest first within a level by n."""
    n = rows.count() if total is None else total
    return rows.rollup(*levels).agg(F.count("*").alias("n")).withColumn("percent", F.round(100.0 * F.col("n") / F.lit(max(n, 1)), 6))


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """rows with _k: the place of each from 0 in its group, in order.

    Rows are sorted over the cluster in ranges, numbered within each, and each range's numbers go on where those before it
    end: no group is a single task.
    """
    by = by or []
    ranged = stored(rows.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    skip = ranged.groupBy(*by, "_p").agg(F.count("*").alias("_m")).withColumn("_skip", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    skip = skip.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), "_skip")
    inside = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p", *by).orderBy(*order)) - 1)
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return inside.join(skip, same).select(*rows.columns, (F.col("_k") + F.col("_skip")).alias("_k"))


def quantiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, median, p95, smallest, largest): p95 is the value at index min(n - 1, floor(0.95 n)) in order, no interpolation."""
    held = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    sizes = held.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("smallest"), F.max("_v").alias("largest"))
    sizes = sizes.select(*[F.col(c).alias(f"_own{i}") for i, c in enumerate(by)], "n", "smallest", "largest")
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_own{i}"))
    k, n = F.col("_k"), F.col("n")
    low, high, at = F.floor((n - 1) / 2), F.floor(n / 2), F.least(n - 1, F.floor(n * 0.95))
    met = numbered(held, ["_v"], by).join(sizes, same).where((k == low) | (k == high) | (k == at))
    median = (F.max(F.when(k == low, F.col("_v"))) + F.max(F.when(k == high, F.col("_v")))) / 2
    return met.groupBy(*by, "n", "smallest", "largest").agg(median.alias("median"), F.max(F.when(k == at, F.col("_v"))).alias("p95")).select(*by, "n", "median", "p95", "smallest", "largest")


def growth(rows: DataFrame, by: list[str], size: Column, cost: Column, at: float) -> DataFrame:
    """(by, exponent, estimate): the least-squares line of log cost over log size, and what it says of a size."""
    x, y = F.ln(size), F.ln(cost)
    fit = rows.where((size > 0) & (cost > 0)).groupBy(*by).agg(F.regr_slope(y, x).alias("exponent"), F.regr_intercept(y, x).alias("_i"))
    return fit.select(*by, "exponent", F.exp(F.col("_i") + F.col("exponent") * F.ln(F.lit(at))).alias("estimate"))


def every(rows: DataFrame, step: int, order: list[str], limit: int | None = None) -> DataFrame:
    """Every step-th row in order, the first included; at most limit of them."""
    taken = F.col("_k") % step == 0
    if limit is not None:
        taken &= F.col("_k") < step * limit
    return numbered(rows, order).where(taken).drop("_k")


def rounded_faces(segments: DataFrame, digits: int = 6) -> DataFrame:
    """(drawing_id, faces) of the drawing whose coordinates are rounded: self loops go, equal edges are one."""
    near = segments.withColumns({c: F.bround(c, digits) for c in ("x1", "y1", "x2", "y2")})  # halves to even
    return J.plain_faces(near)


def _holes(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, px: int, owner: np.ndarray) -> int:
    """Holes of one drawing as pixels that also touch at corners: pieces less the Euler number.

    owner: a square of px + 2 as a flat array, all -1, and left so. A line's pixels hang together, so pieces are those of
    lines whose pixels touch; the Euler number is that of the closed squares: corners - sides + pixels.
    """
    wide = px + 2
    scale = (px - 6) / max(max(x1.max(), x2.max()) - (lx := min(x1.min(), x2.min())), max(y1.max(), y2.max()) - (ly := min(y1.min(), y2.min())), 1e-12)
    ends = np.stack([np.rint((c - low) * scale) for c, low in ((x1, lx), (y1, ly), (x2, lx), (y2, ly))]).astype(np.int64) + 3
    code = ((ends[0] * wide + ends[1]) * wide + ends[2]) * wide + ends[3]
    ends = ends[:, np.unique(code, return_index=True)[1]]
    dx, dy = ends[2] - ends[0], ends[3] - ends[1]
    n = np.maximum(np.abs(dx), np.abs(dy))
    marked, links = [], []
    for part in P.chunks(n + 1):
        own, k = P.spread(np.zeros(part.stop - part.start, np.int64), n[part] + 1)
        own += part.start
        # The minor axis moves by the nearest whole number of pixels, halves away from the start.
        at = lambda c, d: ends[c][own] + np.sign(d)[own] * ((2 * np.abs(d)[own] * k + n[own]) // (2 * np.maximum(n[own], 1)))  # noqa: B023, E731
        dots = at(0, dx) * wide + at(1, dy)
        was = owner[dots]
        links.append(np.stack([own, was], axis=1)[(was >= 0) & (was != own)])
        owner[dots] = own
        now = owner[dots]  # the last line that has the pixel
        links.append(np.stack([own, now], axis=1)[now != own])
        marked.append(dots[now == own])
    dots = np.concatenate(marked)
    dots = np.unique(dots[owner[dots] >= 0])
    mine, sides = owner[dots], 4 * len(dots)
    for step in (1, wide - 1, wide, wide + 1):
        other = owner[dots + step]
        sides -= int((other >= 0).sum()) if step in (1, wide) else 0
        links.append(np.stack([mine, other], axis=1)[(other >= 0) & (other != mine)])
    corners = len(np.unique(np.concatenate([dots, dots + 1, dots + wide, dots + wide + 1])))
    owner[dots] = -1
    root = P.roots_of(len(n), np.concatenate(links))
    return int((root == np.arange(len(n))).sum()) - (corners - sides + len(dots))


def raster_holes(segments: DataFrame, px: int = 512) -> DataFrame:
    """(drawing_id, holes) of the drawing scaled to a square of px, as pixels of Bresenham's lines. A segment with a coordinate
    that is no finite number leaves no pixel.

    A task holds one drawing's segments and one square of pixels; no pixel is moved.
    """

    def holes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = np.full((px + 2) ** 2, -1, np.int64)
        for rows, new in P.whole_groups(batches):
            ends = [rows.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")]
            found = [_holes(*(c[i:j] for c in ends), px, owner) for i, j in zip(new, np.append(new[1:], rows.num_rows), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(D).take(pa.array(new)).combine_chunks(), pa.array(found, pa.int64())], [D, "holes"])

    own = segments.where(P.finite(segments)).select(D, *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return P.numbered(own, [D]).mapInArrow(holes, f"{D} {dict(segments.dtypes)[D]}, holes long")
