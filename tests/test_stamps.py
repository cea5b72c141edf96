"""What a change says, in batch and as a stream."""

import json

from chalkline.functions.geometry import number
from chalkline.streaming import stamps

KIND = "path string, seq long, status string, pieces long, faces long, dangles long, rho double, grid_source string, reason string"


def _event(seq, faces=None, reason=None, pieces=1, dangles=0, path="/a/demo.svg", rho=10.0):
    ok = reason is None
    return (path, seq, "CERTIFIED" if ok else "BAD INPUT" if reason == "BAD_INPUT" else "REFUSED", pieces if ok else None, faces, dangles if ok else None, rho, "derived", reason)


EVENTS = [_event(1, 4), _event(2, 3), _event(3, 3), _event(4, reason="EDGES_CROSS"), _event(5, reason="EDGES_CROSS"), _event(6, reason="NO_GEOMETRY"), _event(7, 5, dangles=2), _event(8, 6, rho=3.0), _event(9, reason="BAD_INPUT"), _event(1, 1, path="/b/x.svg")]
WANT = ["drawing demo.svg  pieces 1  faces 4", "drawing demo.svg  pieces 1  faces 4 -> 3", "drawing demo.svg  pieces 1  faces 3", "drawing demo.svg  edges cross", "drawing demo.svg  no line work", "drawing demo.svg  pieces 1  faces 5  dangles 2", "drawing demo.svg  pieces 1  faces 6"]


def test_batch(spark):
    got = stamps.stamped(spark.createDataFrame(EVENTS, KIND)).orderBy("path", "seq").collect()
    assert [r.stamp for r in got if r.path == "/a/demo.svg"] == WANT and len(got) == len(WANT) + 1


def test_stream_keeps_state_between_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for i in range(3):
        spark.createDataFrame(EVENTS[4 * i : 4 * i + 4], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stamps.stream(source).writeStream.format("memory").queryName("stamps_test").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination()
    got = spark.table("stamps_test").orderBy("path", "seq").collect()
    assert [r.stamp for r in got if r.path == "/a/demo.svg"] == WANT


def test_only_writes_of_drawings_count(spark):
    say = lambda tool, path: json.dumps({"tool_name": tool, "tool_input": {"file_path": path}})
    rows = [say("Write", "a/x.svg"), say("Edit", "a/X.SVG"), say("Bash", "x.svg"), say("Write", "walls.svg.bak"), say("Write", ""), "not json", json.dumps({"tool_name": "Write", "tool_input": {"path": "y.svg"}})]
    got = stamps.writes(spark.createDataFrame([(r,) for r in rows], "payload string")).collect()
    assert sorted(r.path for r in got) == ["a/X.SVG", "a/x.svg", "y.svg"]


def test_numbers():
    assert [number(x) for x in (0, 1, 2.2e-6, 12345678.0, 0.5)] == ["0", "1", "2.2e-06", "1.235e+07", "0.5"]
