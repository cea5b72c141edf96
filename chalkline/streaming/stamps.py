"""Change stamps: one line for each write to a drawing whose certified answer is news. A stream with state, and a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from chalkline.functions.geometry import is_geometry

# What a refusal is called, and the tools that write files. A bad input says nothing.
TOKENS = {
    "NO_STABLE_SCALE": "no certified scale", "VERTEX_NEAR_EDGE": "vertex near edge", "EDGES_CROSS": "edges cross", "EDGE_COLLAPSED": "edge collapsed", "CURVE_UNSTABLE": "curve unstable",
    "MARGIN_TOO_SMALL": "margin too small", "NO_GEOMETRY": "no line work", "TOO_MANY_PAIRS": "too large to certify", "TOO_MANY_VERTICES": "too large to certify",
}
TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit")
LABEL = "drawing"
FIELDS = ["status", "pieces", "faces", "dangles", "rho", "grid_source", "reason"]
STATE = "status string, faces long, rho double, grid_source string, reason string"
OUT = "path string, seq long, stamp string"


def writes(payloads: DataFrame) -> DataFrame:
    """(path, ..): payload rows with a JSON text whose tool wrote a drawing; malformed rows drop out."""
    kind = "tool_name string, tool_input struct<file_path:string,path:string>"
    rows = payloads.withColumn("_p", F.from_json("payload", kind))
    path = F.coalesce("_p.tool_input.file_path", "_p.tool_input.path")
    return rows.withColumn("path", path).where(F.col("_p.tool_name").isin(*TOOLS) & is_geometry(F.col("path"))).drop("_p", "payload")


def _token(reason: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in TOKENS.items() for x in kv])[reason]


def stamped(events: DataFrame) -> DataFrame:
    """(path, seq, stamp) of the events(path, seq, FIELDS) that say something, each against the one before on its path."""
    was = {c: F.lag(c).over(Window.partitionBy("path").orderBy("seq")) for c in ("status", "faces", "rho", "grid_source", "reason")}
    rows = events.withColumns({f"was_{c}": w for c, w in was.items()})
    name = F.substring_index("path", "/", -1)
    same = (F.col("was_status") == "CERTIFIED") & (F.col("was_rho") == F.col("rho")) & (F.col("was_grid_source") == F.col("grid_source")) & (F.col("was_faces") != F.col("faces"))
    faces = F.when(same, F.concat_ws(" -> ", F.col("was_faces").cast("string"), F.col("faces").cast("string"))).otherwise(F.col("faces").cast("string"))
    loose = F.when(F.col("dangles") > 0, F.concat(F.lit("  dangles "), F.col("dangles").cast("string"))).otherwise("")
    said = F.concat(F.lit(LABEL + " "), name, F.lit("  pieces "), F.col("pieces").cast("string"), F.lit("  faces "), faces, loose)
    refused = F.when(~F.col("reason").eqNullSafe(F.when(F.col("was_status") != "CERTIFIED", F.col("was_reason"))), F.concat(F.lit(LABEL + " "), name, F.lit("  "), _token(F.col("reason"))))
    return rows.select("path", "seq", F.when(F.col("status") == "CERTIFIED", said).otherwise(refused).alias("stamp")).where("stamp is not null")


def hook_lines(stamps: DataFrame) -> DataFrame:
    """(.., line): each stamp as the JSON that a tool's caller takes up as context."""
    said = F.struct(F.lit("PostToolUse").alias("hookEventName"), F.col("stamp").alias("additionalContext"))
    return stamps.withColumn("line", F.to_json(F.struct(said.alias("hookSpecificOutput")))).drop("stamp")


#: What is said, by whether the drawing is certified, at the scale of the answer before, and with another answer or reason.
SAID = {(True, True, True): "pieces {pieces}  faces {was} -> {faces}{loose}", (False, True, True): "{token}", (False, False, True): "{token}"}
SAID |= {(True, *rest): "pieces {pieces}  faces {faces}{loose}" for rest in ((True, False), (False, True), (False, False))}


def line(name: str, now: dict, before: dict | None) -> str | None:
    """What one event says after another, by the table; None for silence."""
    was, certified = before or {}, now["status"] == "CERTIFIED"
    answer = "faces" if certified else "reason"
    scale = all(was.get(k) == now[k] for k in ("status", "rho", "grid_source"))
    said = SAID.get((certified, scale, was.get(answer) != now[answer]))
    token = TOKENS.get(now["reason"])
    if said is None or not (certified or token):
        return None
    return f"{LABEL} {name}  " + said.format(**now, was=was.get("faces"), token=token, loose=f"  dangles {now['dangles']}" if now["dangles"] else "")


class _Stamps(StatefulProcessor):
    """The last verdict of each path; rows of one path come in the order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        path = key[0]
        pdf = pd.concat(list(rows)).sort_values("seq")
        before = dict(zip(("status", "faces", "rho", "grid_source", "reason"), self.last.get(), strict=True)) if self.last.exists() else None
        out = []
        for r in pdf.to_dict("records"):
            now = {k: None if pd.isna(v) else v for k, v in r.items()}
            for k in ("faces", "pieces", "dangles"):
                now[k] = None if now[k] is None else int(now[k])
            said = line(path.rpartition("/")[2], now, before)
            certified = now["status"] == "CERTIFIED"
            before = {"status": now["status"], "faces": now["faces"] if certified else None, "rho": now["rho"] if certified else None, "grid_source": now["grid_source"] if certified else None, "reason": None if certified else now["reason"]}
            if said:
                out.append((path, int(now["seq"]), said))
        self.last.update(tuple(before.values()))
        yield pd.DataFrame(out, columns=["path", "seq", "stamp"])

    def close(self) -> None:
        pass


def stream(events: DataFrame) -> DataFrame:
    """The stamps of a stream of events(path, seq, FIELDS), with state by path."""
    return events.groupBy("path").transformWithStateInPandas(statefulProcessor=_Stamps(), outputStructType=OUT, outputMode="Append", timeMode="None")
