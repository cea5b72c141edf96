"""Reading and writing SVG, and verdicts over documents with curves."""

import pytest
from pyspark.sql import functions as F

from chalkline.plans import verdicts as V
from chalkline.sources import figures, svg

MIXED = """<?xml version="1.0"?><svg xmlns="http://www.w3.org/2000/svg"><line x1="0" y1="0" x2="1" y2="1"/><rect width="3" height="2"/>
<polyline points="0,0 1,1 2,0"/><polygon points="0,0 1,1 2,0"/><g transform="translate(200 5)"><line x2="1" id="far"/></g><text>a</text></svg>"""


def test_shapes_and_counts():
    d = svg.parse(MIXED)
    assert len(d.segments) == 11 and d.skipped == {"text": 1} and d.segments[-1] == (200 + 5j, 201 + 5j, "line#far")
    d = svg.parse('<svg><circle r="5"/></svg>')
    assert (len(d.segments), d.n_degenerate, d.n_curves) == (64, 1, 4)
    assert len(svg.parse('<svg><path d="M0 0C1 1 2 1 3 0"/></svg>', 7).segments) == 7
    d = svg.parse('<svg><path/><line x1="1" x2="1"/></svg>')
    assert d.segments == [] and d.skipped == {"path-without-d": 1, "line": 1} and d.n_degenerate == 1
    assert svg.parse("junk").error and svg.parse(None).error and svg.parse('<svg><path d="M0 0L1"/></svg>').error
    with pytest.raises(ValueError, match="flatten"):
        svg.parse(MIXED, 0)


@pytest.mark.parametrize(("d", "last"), [("M1 2h3v4H0V0z", 1 + 2j), ("m1,2 3,4 5,6", 9 + 12j), ("M0 0Q1 1 2 0T4 0", 4 + 0j), ("M0 0C0 1 1 1 1 0S2-1 2 0", 2 + 0j), ("M0 0A5 5 0 0 1 10 0", 10 + 0j), ("M0 0a5 5 0 1 0 10 0", 10 + 0j)])
def test_paths_end_where_they_say(d, last):
    segments = svg.parse(f'<svg><path d="{d}"/></svg>').segments
    assert segments[-1][1] == last
    assert all(a[1] == b[0] for a, b in zip(segments, segments[1:], strict=False))


def test_documents_as_found():
    full = svg.parse('<svg><path d="M0 0A1 1 0 0 1 1 -1z"/></svg>').segments
    assert svg.parse('<svg><path d="M0 0a1 1 0 011-1z"/></svg>').segments == full and len(full) == 17
    d = svg.parse('<svg xmlns:xlink="http://www.w3.org/1999/xlink"><defs><rect id="r" width="2" height="1"/></defs><use xlink:href="#r" x="5" y="6"/><symbol><line x2="9"/></symbol><mask><line x2="9"/></mask></svg>')
    assert len(d.segments) == 4 and d.segments[0] == (5 + 6j, 7 + 6j, "rect#r")
    assert svg.parse('<svg><g id="a"><use href="#a"/><line x2="1"/></g></svg>').error is None
    d = svg.parse('<svg><rect width="10" height="6" rx="2"/></svg>', 8)
    assert len(d.segments) == 4 + 4 * 8 and d.n_curves == 4 and d.skipped == {}
    assert svg.parse('<svg><line x2="25.4mm" y2="1in"/></svg>').segments[0][1] == 96 + 96j
    d = svg.parse("<svg><linearGradient><stop/></linearGradient><filter/><script/><view/><animate/><image/></svg>")
    assert d.skipped == {"image": 1}


def test_arcs_stay_on_their_circle():
    points = [z for a, b, _ in svg.parse('<svg><path d="M10 0A10 10 0 0 1 0 10"/></svg>').segments for z in (a, b)]
    assert all(abs(abs(z) - 10) < 1e-9 for z in points) and all(z.real >= -1e-9 and z.imag >= -1e-9 for z in points)


def test_transforms_and_view_boxes():
    d = svg.parse('<svg><g transform="translate(10,0) scale(2)"><g transform="rotate(90)"><line x2="1"/></g></g></svg>').segments[0]
    assert abs(d[1] - (10 + 2j)) < 1e-12
    d = svg.parse('<svg viewBox="0 0 10 10" width="100" height="100"><line x2="10" y2="10"/></svg>').segments[0]
    assert d[1] == 100 + 100j


@pytest.mark.parametrize("as_path", [False, True])
def test_families_survive_a_round_trip(spark, as_path):
    fam = figures.families()
    rows = svg.parsed(svg.written(figures.table(spark, {k: s for k, (s, _) in fam.items()}), as_path))
    for r in V.verdicts(svg.segments(rows)).collect():
        assert (r.v, r.e, r.pieces, r.faces, r.chi) == fam[r.drawing_id][1], r.drawing_id


def test_curves_are_judged_twice(spark):
    docs = spark.createDataFrame([("circle", '<svg><circle r="5"/></svg>'), ("words", "<svg><text/><text/></svg>"), ("broken", "<svg"), ("box", '<svg><rect width="4" height="4"/></svg>')], "drawing_id string, svg string")
    passes = None
    for k, n in ((1, 16), (2, 32)):
        rows = svg.parsed(docs, n)
        rows = rows if k == 1 else rows.where("n_curves > 0")
        found = V.verdicts(svg.segments(rows), rows.select("drawing_id", "skipped", "error")).withColumn("pass", F.lit(k))
        passes = found if passes is None else passes.unionByName(found)
    got = {r.drawing_id: r for r in V.settled(passes).collect()}
    assert (got["circle"].status, got["circle"].pieces, got["circle"].faces) == ("CERTIFIED", 1, 1)
    assert got["words"].reason == "NO_GEOMETRY" and got["broken"].status == "BAD INPUT" and got["box"].faces == 1


def test_disagreeing_passes_are_unstable(spark):
    kind = "drawing_id string, pass int, status string, reason string, kind string, pieces long, faces long, chi long, look_at array<string>, n_more long, rho double, grid_source string"
    rows = [("a", 1, "CERTIFIED", None, None, 1, 1, 0, None, 0, 10.0, "derived"), ("a", 2, "CERTIFIED", None, None, 1, 2, -1, None, 0, 10.0, "derived"), ("b", 1, "CERTIFIED", None, None, 1, 1, 0, None, 0, 10.0, "derived"), ("b", 2, "REFUSED", "TOO_MANY_VERTICES", "budget", None, None, None, None, 0, 10.0, "derived"), ("c", 1, "CERTIFIED", None, None, 1, 1, 0, None, 0, 10.0, "derived")]
    got = {r.drawing_id: r for r in V.settled(spark.createDataFrame(rows, kind)).collect()}
    assert (got["a"].reason, got["b"].reason, got["c"].status) == ("CURVE_UNSTABLE", "TOO_MANY_VERTICES", "CERTIFIED") and got["a"].faces is None


def test_sources(spark, tmp_path):
    (tmp_path / "a.svg").write_text(MIXED)
    (tmp_path / "b.svg.bak").write_text(MIXED)
    assert svg.read(spark, str(tmp_path)).count() == 1
    spark.dataSource.register(svg.SvgSource)
    (tmp_path / "c.svg").write_text("<svg")
    rows = spark.read.format("svg").load(str(tmp_path))
    assert rows.where("error is null").count() == 11 and [r.seg_ix for r in rows.where("error is not null").collect()] == [None]
    head = spark.createDataFrame([("<svg/>",), ("  <?xml?>",), ("a.svg",), ("<html>",)], "t string").select(svg.looks_like_svg(F.col("t")).alias("x"))
    assert [r.x for r in head.collect()] == [True, True, False, False]
