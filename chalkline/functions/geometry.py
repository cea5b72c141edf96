"""Scalar geometry as columns. Distances are sqrt(x*x + y*y), which numpy, Spark and DuckDB round alike."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Policy and budgets that decide verdicts.
RHO = 10.0
CAND_MAX = 4
FLOOR_ULPS = 4096
MARGIN_ULPS = 64
CLUSTER_MAX = 16
VERTEX_CAP = 2000
EPS = 2.0**-52
SITES = 8


def pair_budget(cap: int = VERTEX_CAP) -> int:
    return 4 * cap * cap


def dist(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def seg_param(px, py, ax, ay, bx, by) -> Column:
    """Where the projection of p falls on the segment from a to b: 0 at a, 1 at b, never outside; 0 if a = b."""
    dx, dy = bx - ax, by - ay
    den = dx * dx + dy * dy
    return F.when(den > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / den))).otherwise(F.lit(0.0))


def seg_dist(px, py, ax, ay, bx, by, t: Column | None = None) -> Column:
    t = seg_param(px, py, ax, ay, bx, by) if t is None else t
    return dist(ax + t * (bx - ax), ay + t * (by - ay), px, py)


def orient(ax, ay, bx, by, px, py) -> Column:
    """Twice the signed area of a, b, p."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def proper_cross(a, b, c, d) -> Column:
    """Each of a..d is a pair of columns: segment ab properly crosses cd. A zero orientation counts as not positive."""
    d1, d2 = orient(*a, *b, *c) > 0, orient(*a, *b, *d) > 0
    d3, d4 = orient(*c, *d, *a) > 0, orient(*c, *d, *b) > 0
    return (d1 != d2) & (d3 != d4)


def crossing_point(a, b, c, d) -> Column:
    """Where the lines ab and cd meet; null if they are parallel."""
    rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    den = rx * sy - ry * sx
    u = ((c[0] - a[0]) * sy - (c[1] - a[1]) * sx) / den
    return F.when(den != 0, F.array(a[0] + u * rx, a[1] + u * ry))


def ulps(n: int, magnitude: Column) -> Column:
    return F.lit(n * EPS) * F.when(magnitude == 0, F.lit(1.0)).otherwise(magnitude)


def is_geometry(path: Column) -> Column:
    """The file's last suffix is .svg, in any case."""
    return F.coalesce(F.lower(path).rlike(r"[^/]\.svg$"), F.lit(False))


def number(x: float) -> str:
    """Six significant digits, or four in exponent form beyond [1e-4, 1e7)."""
    return "0" if x == 0 else ("%.6g" if 1e-4 <= abs(x) < 1e7 else "%.4g") % x


def register(spark: SparkSession) -> None:
    """The same functions for SQL."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION orient(ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE, px DOUBLE, py DOUBLE) RETURNS DOUBLE RETURN (bx - ax) * (py - ay) - (by - ay) * (px - ax)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION seg_param(px DOUBLE, py DOUBLE, ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE) RETURNS DOUBLE RETURN CASE WHEN (bx-ax)*(bx-ax)+(by-ay)*(by-ay) > 0 THEN greatest(0D, least(1D, ((px-ax)*(bx-ax)+(py-ay)*(by-ay)) / ((bx-ax)*(bx-ax)+(by-ay)*(by-ay)))) ELSE 0D END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION seg_dist(px DOUBLE, py DOUBLE, ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE) RETURNS DOUBLE RETURN sqrt(power(ax + seg_param(px,py,ax,ay,bx,by)*(bx-ax) - px, 2) + power(ay + seg_param(px,py,ax,ay,bx,by)*(by-ay) - py, 2))")
    sides = ["orient(ax,ay,bx,by,cx,cy)", "orient(ax,ay,bx,by,dx,dy)", "orient(cx,cy,dx,dy,ax,ay)", "orient(cx,cy,dx,dy,bx,by)"]
    points = ", ".join(f"{p}{c} DOUBLE" for p in "abcd" for c in "xy")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION proper_cross({points}) RETURNS BOOLEAN RETURN (({sides[0]} > 0) <> ({sides[1]} > 0)) AND (({sides[2]} > 0) <> ({sides[3]} > 0))")
