"""Documents in, verdicts out, as rows, text, JSON and exit codes."""

import json

import pytest

from chalkline import __main__ as cli
from chalkline import api
from chalkline.plans import reports
from chalkline.sources import figures


def test_demo_and_curves(spark):
    got = {r.drawing_id: r for r in api.judge_texts(spark, {"demo": api.DEMO, "round": '<svg><circle r="5"/></svg>', "none": "<svg><text/></svg>", "bad": "no"}).collect()}
    demo = got["demo"]
    assert (demo.v, demo.e, demo.pieces, demo.faces, demo.chi) == (9, 12, 1, 4, -3)
    assert (got["round"].status, got["round"].faces, got["none"].reason, got["bad"].status) == ("CERTIFIED", 1, "NO_GEOMETRY", "BAD INPUT")
    text = reports.block(demo.asDict(recursive=True), "demo")
    assert "faces                4" in text and "window" in text
    assert "NO_GEOMETRY" in reports.block(got["none"].asDict(recursive=True)) and "element=text" in reports.block(got["none"].asDict(recursive=True))


def test_curves_between_two_flattenings_are_unstable(spark):
    """A hand that ends between the two polygons of a circle is inside one and outside the other."""
    svg = figures.unstable_curve()
    got = api.judge_texts(spark, {"x": svg}).first()
    assert got.status == "REFUSED" and got.reason in ("CURVE_UNSTABLE", "EDGES_CROSS", "VERTEX_NEAR_EDGE")


def test_json_round_trip_checks_itself(spark):
    found = api.judge_texts(spark, {"demo": api.DEMO})
    rows = reports.to_json(found)
    assert json.loads(rows.first().json)["faces"] == 4
    assert reports.from_json(rows).first().faces == 4
    broken = spark.createDataFrame([("x", rows.first().json.replace('"faces":4', '"faces":5'))], "drawing_id string, json string")
    with pytest.raises(Exception, match="contradict"):
        reports.from_json(broken).collect()


def test_command_line(spark, tmp_path, capsys):
    file = tmp_path / "a.svg"
    file.write_text(api.DEMO)
    assert cli.main([str(file), "--json"]) == 0 and '"pieces":1' in capsys.readouterr().out
    assert cli.main(["check", str(file), "--faces", "4"]) == 0 and "HELD" in capsys.readouterr().out
    assert cli.main(["check", str(file), "--faces", "5"]) == 1
    file.write_text("<svg/>")
    assert cli.main([str(file)]) == 2 and cli.main([str(file), "--refuse-ok"]) == 0
