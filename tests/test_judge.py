"""Verdicts of many drawings at once against the same by tables, and what they write on the way."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from chalkline.operators import judge as J
from chalkline.operators import planar as P
from chalkline.plans import catalog
from chalkline.plans import verdicts as V
from chalkline.sources import figures

SF = "/root/testdata/sf0.001"


def _rows(found):
    return {r.drawing_id: repr(r) for r in found.collect()}


def _corpus(spark, name):
    if name == "figures":
        return figures.table(spark, {k: s for k, (s, _) in (figures.families() | figures.refusals()).items()})
    return catalog._view(spark, SF, getattr(catalog, name)).where(F.col("drawing_id") % 3 == 0)


@pytest.mark.parametrize(("name", "rho", "grid", "cap"), [("figures", 1.2, None, 2000), ("HEAPS", 10.0, None, 2000), ("HEAPS", 10.0, catalog.GRID, 2000), ("WEBS", 10.0, None, 6), ("WEBS", 10.0, None, 4), ("CHORDS", 1.2, None, 2000), ("LONG", 10.0, None, 2000)])
def test_whole_drawings_and_tables_agree(spark, name, rho, grid, cap):
    rows = V.stored(_corpus(spark, name), "rows")
    got, want = (f(rows, rho, 4, grid, cap, True) for f in (V._by_drawing, V._by_tables))
    assert got.dtypes == want.dtypes
    assert _rows(got) == _rows(want)


def test_drawings_that_no_task_holds_go_by_tables(spark, monkeypatch):
    rows = V.stored(_corpus(spark, "figures"), "rows")
    want = _rows(V.verdicts(rows))
    assert 0 < rows.groupBy("drawing_id").count().where("count > 12").count() < len(want)
    monkeypatch.setattr(J, "LARGE", 12)
    assert _rows(V.verdicts(rows)) == want


@pytest.fixture
def written(monkeypatch):
    """The tables that a query writes on its way."""
    labels, own = [], V.stored

    def stored(df, label, rows=None):
        labels.append(label)
        return own(df, label, rows)

    monkeypatch.setattr(V, "stored", stored)
    return labels


# Each table is a plan and jobs that the driver holds: there were 15 for one call of verdicts().
@pytest.mark.parametrize(("name", "most"), [("verdicts", 1), ("checked_claims", 1), ("verdict_json", 1), ("arrangement_digests", 1), ("grid_verdicts", 1), ("budget_verdicts", 1), ("heap_verdicts", 1), ("refusals_by_reason", 1), ("claims_on_heaps", 1), ("contested_verdicts", 1), ("rebuilt_verdicts", 2), ("rho_sensitivity", 3)])
def test_verdicts_write_few_tables(spark, written, name, most):
    catalog.QUERIES[name](spark, SF).collect()
    assert len(written) <= most


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_pixels_do_not_move(spark):
    # One shuffle, of the segments by drawing: pixels and their neighbours were shuffled by place.
    assert _exchanges(catalog.raster_holes(spark, SF)) == 1


def test_collapsed_edges_move_segments_once(spark):
    # The shuffle that numbers the segments, and one of whole drawings: there were joins for every step.
    assert _exchanges(catalog.collapsed_edges(spark, SF)) <= 2


def test_collapsed_edges_joined_through_others(spark, tmp_path):
    # From (0, p) to (0, 3p): 12 to 36 is longer than SHORT, and only the second drawing has a point between. Such edges were left out.
    rows = [(97 * 83 * i, c, p) for i, (c, p) in enumerate([(1, 12.0), (2, 12.0), (2, 8.0), (None, 8.0)])]  # the last is of no drawing
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    want = [(2, 0, "line#0", 24.0), (2, 1, "line#1", 16.0)]
    assert sorted(map(tuple, catalog.collapsed_edges(spark, str(tmp_path)).collect())) == want
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(con.sql(catalog.SQL["collapsed_edges"]).fetchall()) == want


def test_plain_faces(spark):
    rows = catalog._view(spark, SF, catalog.HEAPS).withColumn("y2", F.when(F.col("drawing_id") % 7 > 0, F.col("y2")))
    vs = P.vertices(rows)
    want = P.euler(vs, P.distinct_edges(P.edges(rows, vs)).where("a <> b")).select("drawing_id", "faces")
    got = J.plain_faces(rows)
    assert _exchanges(got) == 1  # there were joins, and a Python call for each drawing
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("kind", ["apart", "copies", "one place", "few", "none"])
def test_nearest_pairs(spark, kind):
    rng = random.Random(3)
    points = {
        "apart": [(rng.random(), rng.random()) for _ in range(400)], "copies": [(rng.randrange(9) / 3, rng.randrange(9) / 3) for _ in range(300)], "one place": [(0.5, -0.0)] * 300,
        "few": [(0.0, 0.0), (3.0, 4.0), (None, 1.0), (float("nan"), 1.0)], "none": [(None, None)] * 4,
    }[kind]
    rows = spark.createDataFrame([(1, i, *p) for i, p in enumerate(points)], "drawing_id int, v int, x double, y double")
    pairs = rows.join(rows.toDF("drawing_id", "w", "x2", "y2"), "drawing_id").where("v < w").withColumn("d", F.expr("round(sqrt((x2-x)*(x2-x) + (y2-y)*(y2-y)), 9)"))
    want = pairs.orderBy(F.asc_nulls_last("d"), "v", "w").limit(3).select("v", "w", "d").collect()
    assert str(P.nearest_pairs(rows, 3).orderBy("place").select("v", "w", "d").collect()) == str(want)


def test_nearest_pairs_of_copies_stay_few(spark):
    """Copies are left out before pairs are made: of 3,000 points in one place 4.5 million were."""
    rows = spark.range(3000).select(F.lit(1).alias("drawing_id"), F.col("id").cast("int").alias("v"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    assert [(r.v, r.w) for r in P.nearest_pairs(rows, 3).orderBy("place").collect()] == [(0, 1), (0, 2), (0, 3)]
