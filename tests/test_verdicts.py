"""Verdicts on figures whose counts are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.operators import evaluate as E
from chalkline.operators import planar as P
from chalkline.plans import verdicts as V
from chalkline.sources import figures


def _judge(spark, drawings, **kw):
    return {r.drawing_id: r for r in V.verdicts(figures.table(spark, drawings), **kw).collect()}


@pytest.fixture(scope="module")
def families():
    return figures.families()


@pytest.fixture(scope="module")
def clean(spark, families):
    return _judge(spark, {k: s for k, (s, _) in families.items()}, digests=True)


def test_all_families_are_exact(families, clean):
    assert len(families) == 44
    for name, (_, truth) in families.items():
        r = clean[name]
        assert (r.status, r.v, r.e, r.pieces, r.faces, r.chi) == ("CERTIFIED", *truth), name
        assert r.n_merged == 0 and r.diam_max == 0.0 and r.faces == r.e - r.v + r.pieces and r.chi == r.pieces - r.faces


def test_details_of_certificates(clean):
    assert clean["T-junction"].n_subdivided == 2 and clean["exact duplicate segment"].n_dup_edges == 1
    assert clean["comb(3)"].dangles == 5 and clean["square"].dangles == 0
    assert len({r.digest for r in clean.values()}) >= 40 and all(len(r.digest) == 40 for r in clean.values())


def test_refusals_name_the_place(spark):
    got = _judge(spark, {k: s for k, (s, _) in figures.refusals().items()})
    for name, (_, reason) in figures.refusals().items():
        r = got[name]
        assert (r.status, r.reason, r.kind) == ("REFUSED", reason, "geometry") and r.pieces is None and r.faces is None
    assert len(got["pentagram raw"].look_at) == 5
    assert got["wall missing the floor"].look_at[0].d == pytest.approx(2.2e-6) and got["wall missing the floor"].look_at[0].edge == "line#0"
    assert got["two crossing"].look_at[0].xy == [5.0, 5.0]


def test_neighbours_merge_below_a_tenth(spark):
    got = _judge(spark, {"near": figures.box() + figures.box(10 + 1.0), "far": figures.box() + figures.box(10 + 1.01)})
    near, far = got["near"], got["far"]
    assert (near.pieces, near.faces, near.n_merged) == (1, 2, 2) and (far.pieces, far.faces, far.n_merged) == (2, 2, 0)


def test_a_given_grid_is_a_window_of_its_own(spark):
    drawing = {"x": figures.box() + figures.box(10 + 2.2e-6), "s": figures.box() + [(5, 5, 5.0001, 5)]}
    got = _judge(spark, drawing, grid=1e-8)
    assert (got["x"].pieces, got["x"].faces, got["x"].grid_source, got["x"].radius) == (2, 2, "user", 1e-8)
    got = _judge(spark, drawing, grid=0.01)
    assert got["x"].n_merged == 2 and got["s"].reason == "EDGE_COLLAPSED" and got["s"].look_at[0].length == pytest.approx(1e-4)
    assert {r.reason for r in _judge(spark, drawing, grid=1e6).values()} == {"NO_STABLE_SCALE"}


def test_jitter_is_exact_or_refused(spark, families):
    segments = figures.table(spark, {k: s for k, (s, _) in families.items()})
    draws = figures.stratum(spark, P.smallest_gap(*_graph(segments)), seeds=1)
    again = draws.where("family = 'theta(3)'").orderBy("drawing_id", "seg_ix")
    assert again.collect() == again.collect()
    got = V.verdicts(draws.select(*segments.columns)).collect()
    assert len(got) == 6 * len(families)
    exact = {}
    for r in got:
        name, ratio, _ = r.drawing_id.split("|")
        assert r.status == "REFUSED" or (r.pieces, r.faces, r.chi) == families[name][1][2:], r.drawing_id
        exact[float(ratio)] = exact.get(float(ratio), 0) + (r.status == "CERTIFIED")
    assert set(exact) == set(figures.RATIOS) and exact[1e-7] >= 0.9 * len(families), exact


def test_contested_figures_are_certified_as_they_are_read(spark):
    got = _judge(spark, {k: s for k, (s, _, _) in figures.contested().items()})
    for name, (_, certified, drawn) in figures.contested().items():
        assert (got[name].pieces, got[name].faces) == certified != drawn


def test_certificates_are_found_again(spark, families):
    names = ["triangle", "grid(4)", "T-junction", "nested unconnected squares"]
    segments = figures.table(spark, {k: families[k][0] for k in names} | {"near": figures.box() + figures.box(11.0), "raw": figures.star(False)})
    found = V.verdicts(segments)
    assert {(r.drawing_id, r.same) for r in V.rebuilt(segments, found).collect()} == {(k, True) for k in [*names, "near"]}
    other = found.withColumn("faces", F.when(F.col("drawing_id") == "triangle", F.col("faces") + 1).otherwise(F.col("faces")))
    assert [r.drawing_id for r in V.rebuilt(segments, other).where("not same").collect()] == ["triangle"]


def test_agreement_counts_what_a_method_leaves_out(spark, families):
    segments = figures.table(spark, {k: families[k][0] for k in ("square", "grid(3)", "tree(3)", "T-junction")})
    rounded = E.rounded_faces(segments).where("drawing_id <> 'square'")
    got = {r.method: (r.checked, r.agree, r.disagree) for r in E.agreement(V.verdicts(segments), {"raster": E.raster_holes(segments, 256), "rounded": rounded}).collect()}
    assert got == {"raster": (4, 4, 0), "rounded": (4, 2, 2)}  # a rounded T-junction is not joined


def _graph(segments):
    vs = P.vertices(segments)
    return vs, P.distinct_edges(P.edges(segments, vs))


def test_budgets_refuse_before_the_quadratic_pass(spark):
    sizes = spark.createDataFrame([("big", 46), ("small", 4)], "drawing_id string, k int")
    got = {r.drawing_id: r for r in V.verdicts(figures.grids(spark, sizes)).collect()}
    assert (got["big"].reason, got["big"].kind, got["big"].look_at[0]["count"]) == ("TOO_MANY_VERTICES", "budget", 2209)
    assert (got["small"].pieces, got["small"].faces) == (1, 16)


def test_bad_and_missing_input(spark):
    rows = [("nan", 0, math.nan, 0.0, 1.0, 1.0, "line#0"), ("inf", 0, math.inf, 0.0, 1.0, 1.0, "line#0"), ("ok", 0, 0.0, -0.0, 1.0, 1.0, "line#0"), ("ok", 1, 0.0, 0.0, 1.0, 2.0, "line#1")]
    seen = spark.createDataFrame([("nan", None), ("ok", None), ("empty", {"text": 2})], "drawing_id string, skipped map<string,int>")
    got = {r.drawing_id: r for r in V.verdicts(spark.createDataFrame(rows, figures.SCHEMA), seen).collect()}
    assert got["nan"].status == got["inf"].status == "BAD INPUT"
    assert got["empty"].reason == "NO_GEOMETRY" and got["empty"].look_at[0].element == "text" and got["empty"].look_at[0]["count"] == 2
    assert (got["ok"].v, got["ok"].e) == (3, 2)


def test_rigid_motion_and_scale_change_nothing(spark, families):
    draws = {}
    for k in ("triangle", "grid(3)", "T-junction", "planar K4"):
        seg = np.array(families[k][0], float).reshape(-1, 2)
        draws[f"{k}|scaled"] = [tuple(x) for x in (seg * 1024).reshape(-1, 4).tolist()]
        draws[f"{k}|moved"] = [tuple(x) for x in (seg[:, ::-1] * [1, -1] + 64).reshape(-1, 4).tolist()]
    for name, r in _judge(spark, draws).items():
        assert (r.v, r.e, r.pieces, r.faces, r.chi) == families[name.split("|")[0]][1], name


def test_unions_add_and_edits_keep_their_promise(spark, families):
    names = ["triangle", "grid(4)", "theta(3)"]
    a = figures.table(spark, {k: families[k][0] for k in names})
    for segments, change in ((figures.edited(a, "pendant"), (1, 1, 0, 0, 0)), (figures.edited(a, "loop"), (4, 5, 0, 1, -1))):
        for r in V.verdicts(segments).collect():
            assert (r.v, r.e, r.pieces, r.faces, r.chi) == tuple(x + y for x, y in zip(families[r.drawing_id][1], change, strict=True))
    for r in V.verdicts(figures.shifted_union(a, a)).collect() + V.verdicts(figures.edited(a, "copy")).collect():
        assert (r.v, r.e, r.pieces, r.faces, r.chi) == tuple(2 * x for x in families[r.drawing_id][1])


def test_claims(spark, families):
    found = V.verdicts(figures.table(spark, {"square": families["square"][0], "star": figures.star(False)}))
    claims = spark.createDataFrame([("square", 1, None, None), ("square", 2, 1, None), ("star", 6, None, None)], "drawing_id string, faces long, pieces long, chi long")
    got = sorted((r.drawing_id, r.said_faces, r.verdict, r.exit_code) for r in V.checked(claims, found).collect())
    assert got == [("square", 1, "HELD", 0), ("square", 2, "BROKEN", 1), ("star", 6, "REFUSED", 2)]
    nothing = spark.createDataFrame([("square", None, None, None)], claims.schema)
    with pytest.raises(Exception, match="nothing is claimed"):
        V.checked(nothing, found).collect()


def test_self_loops_raise(spark):
    vs = spark.createDataFrame([("g", 0), ("g", 1)], "drawing_id string, v int")
    with pytest.raises(Exception, match="self loop"):
        P.euler(vs, spark.createDataFrame([("g", 0, 0)], "drawing_id string, a int, b int")).collect()


def test_other_methods_agree_on_clean_figures(spark, families):
    segments = figures.table(spark, {k: s for k, (s, _) in families.items()})
    rounded = {r.drawing_id: r.faces for r in E.rounded_faces(segments).collect()}
    assert rounded["grid(4)"] == 16 and rounded["theta(5)"] == 4
    walked = {r.drawing_id: r["count"] for r in P.bounded_faces(*_graph(figures.grids(spark, spark.createDataFrame([("g", 5)], "drawing_id string, k int")))).groupBy("drawing_id").count().collect()}
    assert walked == {"g": 25}
    holes = {r.drawing_id: r.holes for r in E.raster_holes(segments.where(F.col("drawing_id").isin("square", "grid(3)", "tree(3)", "two disjoint squares")), 512).collect()}
    assert holes == {"square": 1, "grid(3)": 9, "tree(3)": 0, "two disjoint squares": 2}


@pytest.mark.parametrize("kind", ["general", "collinear", "clustered", "duplicated"])
def test_spanning_trees_have_the_least_weights(kind):
    draw = np.random.default_rng(5)
    for n in (2, 3, 17, 62):
        p = draw.normal(0, 10, (n, 2))
        if kind == "collinear":
            p[:, 1] = 0
        if kind == "clustered":
            p = p[draw.integers(0, max(1, n // 4), n)] + draw.normal(0, 1e-6, (n, 2))
        if kind == "duplicated":
            p = np.unique(np.round(p), axis=0)
        a, b, w = P.spanning_tree(p[:, 0], p[:, 1])
        inside, best, want = np.zeros(len(p), bool), np.full(len(p), np.inf), []
        best[0] = 0
        for _ in range(len(p)):
            i = int(np.where(inside, np.inf, best).argmin())
            inside[i] = True
            want.append(best[i])
            best = np.minimum(best, np.sqrt(((p - p[i]) ** 2).sum(axis=1)))
        assert np.allclose(sorted(w), sorted(want[1:]), rtol=1e-12)
        assert P.labels_of(len(p), np.stack([a, b], axis=1)).max() == 0


def test_verdicts_are_not_broadcast_to_meet_claims(spark):
    found = spark.range(5).select(F.col("id").alias("drawing_id"), F.lit("CERTIFIED").alias("status"), *[F.lit(1).cast("bigint").alias(c) for c in ("faces", "pieces", "chi")])
    claims = found.select("drawing_id", "faces", "pieces", "chi")
    got = V.checked(claims, found)
    assert "Broadcast" not in got._jdf.queryExecution().toString() and {r.verdict for r in got.collect()} == {"HELD"}
