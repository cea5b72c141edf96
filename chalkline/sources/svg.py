"""SVG documents as segments, and segments as SVG documents.

Lines keep the coordinates as written. A curve becomes `flatten` chords whose outer ends are the curve's own ends, so that
neighbours still share them bit by bit. Elements that draw nothing are counted by tag.
"""

from __future__ import annotations

import cmath
import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chalkline.functions.geometry import EPS, FLOOR_ULPS

FLATTEN, FLATTEN_MAX = 16, 5000
# Tags, in lower case, that are no drawing of their own and are not counted as skipped; and tags that draw.
CONTAINERS = frozenset([
    "svg", "g", "defs", "symbol", "clippath", "mask", "marker", "pattern", "title", "desc", "style", "metadata", "switch", "a", "view", "script",
    "lineargradient", "radialgradient", "stop", "filter", "font", "fontface", "animate", "animatetransform", "animatemotion", "set", "use",
])
SHAPES = frozenset(["line", "rect", "polyline", "polygon", "circle", "ellipse", "path"])
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_COMMAND = re.compile(r"[MmLlHhVvCcSsQqTtAaZz]")
_CALL = re.compile(r"(matrix|translate|scale|rotate|skewX|skewY)\s*\(([^)]*)\)")
# How many numbers a path command takes.
ARITY = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}

# What is drawn only where a use element asks for it, and the pixels of a unit.
KEPT = frozenset(["defs", "symbol", "clippath", "mask", "marker", "pattern"])
UNITS = {"": 1.0, "px": 1.0, "pt": 4 / 3, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "q": 96 / 101.6}
USES = 32  # uses inside uses

Affine = tuple[float, float, float, float, float, float]
IDENTITY: Affine = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


@dataclass
class Drawing:
    segments: list[tuple[complex, complex, str]] = field(default_factory=list)
    skipped: dict[str, int] = field(default_factory=dict)
    n_curves: int = 0
    n_degenerate: int = 0
    n_elements: int = 0
    error: str | None = None


def times(a: Affine, b: Affine) -> Affine:
    """First b, then a."""
    return (a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5])


def moved(m: Affine, p: complex) -> complex:
    return p if m == IDENTITY else complex(m[0] * p.real + m[2] * p.imag + m[4], m[1] * p.real + m[3] * p.imag + m[5])


def transform(text: str | None) -> Affine:
    out = IDENTITY
    for name, inside in _CALL.findall(text or ""):
        x = [float(n) for n in _NUMBER.findall(inside)]
        if name == "matrix" and len(x) == 6:
            step = tuple(x)
        elif name == "translate":
            step = (1, 0, 0, 1, x[0], x[1] if len(x) > 1 else 0.0)
        elif name == "scale":
            step = (x[0], 0, 0, x[1] if len(x) > 1 else x[0], 0, 0)
        elif name == "rotate":
            c, s = math.cos(math.radians(x[0])), math.sin(math.radians(x[0]))
            step = (c, s, -s, c, 0, 0)
            if len(x) == 3:
                step = times(times((1, 0, 0, 1, x[1], x[2]), step), (1, 0, 0, 1, -x[1], -x[2]))
        else:
            k = math.tan(math.radians(x[0]))
            step = (1, 0, k, 1, 0, 0) if name == "skewX" else (1, k, 0, 1, 0, 0)
        out = times(out, step)
    return out


def _length(text: str | None, whole: float = 100.0, default: float = 0.0) -> float:
    m = _NUMBER.match((text or "").strip())
    if not m:
        return default
    unit = text.strip()[m.end() :].strip().lower()
    return float(m[0]) * (whole / 100 if unit == "%" else UNITS.get(unit, 1.0))


def viewport(root: ET.Element) -> Affine:
    """The transform of a viewBox into width and height, centred and with the aspect kept."""
    box = [float(n) for n in _NUMBER.findall(root.get("viewBox", ""))]
    if len(box) != 4 or box[2] <= 0 or box[3] <= 0 or not (root.get("width") or root.get("height")):
        return (1, 0, 0, 1, -box[0], -box[1]) if len(box) == 4 else IDENTITY
    w, h = _length(root.get("width"), box[2], box[2]), _length(root.get("height"), box[3], box[3])
    sx, sy = w / box[2], h / box[3]
    if root.get("preserveAspectRatio", "").strip() != "none":
        sx = sy = min(sx, sy)
    return (sx, 0, 0, sy, -box[0] * sx + (w - box[2] * sx) / 2, -box[1] * sy + (h - box[3] * sy) / 2)


def bezier(points: list[complex], n: int) -> list[complex]:
    out = [points[0]]
    for i in range(1, n):
        t, p = i / n, points
        while len(p) > 1:
            p = [a + (b - a) * t for a, b in zip(p, p[1:], strict=False)]
        out.append(p[0])
    return [*out, points[-1]]


def arc(p: complex, rx: float, ry: float, turn: float, large: bool, sweep: bool, q: complex, n: int) -> list[complex]:
    """Chords of an elliptical arc by its centre; radii that are too small grow until they reach."""
    rx, ry = abs(rx), abs(ry)
    if not rx or not ry or p == q:
        return [p, q]
    spin = cmath.rect(1, math.radians(turn))
    u = (p - q) / 2 / spin
    x, y = u.real, u.imag
    over = math.sqrt((x / rx) ** 2 + (y / ry) ** 2)
    if over > 1:
        rx, ry = rx * over, ry * over
    top = max(0.0, rx * rx * ry * ry - rx * rx * y * y - ry * ry * x * x)
    k = math.sqrt(top / (rx * rx * y * y + ry * ry * x * x)) * (1 if large != sweep else -1)
    c = complex(k * rx * y / ry, -k * ry * x / rx)
    angle = lambda z: math.atan2((z.imag - c.imag) / ry, (z.real - c.real) / rx)
    first, span = angle(u), angle(-u) - angle(u)
    span += 2 * math.pi if sweep and span < 0 else -2 * math.pi if not sweep and span > 0 else 0
    centre = c * spin + (p + q) / 2
    inner = [centre + spin * complex(rx * math.cos(first + span * i / n), ry * math.sin(first + span * i / n)) for i in range(1, n)]
    return [p, *inner, q]


def _ellipse(cx: float, cy: float, rx: float, ry: float) -> Iterator[tuple[str, tuple]]:
    """Four arcs and a closing line, which has no length."""
    tip = [complex(cx + rx, cy), complex(cx, cy + ry), complex(cx - rx, cy), complex(cx, cy - ry)]
    for a, b in zip(tip, tip[1:] + tip[:1], strict=True):
        yield "arc", (a, rx, ry, 0.0, False, True, b)
    yield "close", (tip[0], tip[0])


def _tokens(d: str) -> list[str]:
    """Commands and numbers. The flags of an arc are single digits, which may stand against the next number."""
    out, at, arc, nth = [], 0, False, 0
    while at < len(d):
        c = d[at]
        if _COMMAND.match(c):
            arc, nth = c in "Aa", 0
            found = c
        elif arc and nth % ARITY["A"] in (3, 4) and c in "01":
            found, nth = c, nth + 1
        elif m := _NUMBER.match(d, at):
            found, nth = m[0], nth + 1
        else:
            at += 1
            continue
        out.append(found)
        at += len(found)
    return out


def _rounded(x: float, y: float, w: float, h: float, rx: float, ry: float) -> Iterator[tuple[str, tuple]]:
    """A rectangle whose corners are quarters of an ellipse, clockwise from the left end of the top side."""
    sides = [(complex(x + rx, y), complex(x + w - rx, y)), (complex(x + w, y + ry), complex(x + w, y + h - ry)), (complex(x + w - rx, y + h), complex(x + rx, y + h)), (complex(x, y + h - ry), complex(x, y + ry))]
    for i, (a, b) in enumerate(sides):
        yield "line", (a, b)
        yield "arc", (b, rx, ry, 0.0, False, True, sides[(i + 1) % 4][0])


def _path(d: str) -> Iterator[tuple[str, tuple]]:
    tokens, i = _tokens(d), 0
    at = start = last = 0j
    command, before = "", ""
    while i < len(tokens):
        if tokens[i].isalpha():
            command = tokens[i]
            i += 1
        elif not command:
            raise ValueError("path data begins with a number")
        kind, own = command.upper(), command.islower()
        k = ARITY[kind]
        if i + k > len(tokens) or any(t.isalpha() for t in tokens[i : i + k]):
            raise ValueError("path data breaks off")
        x = [float(t) for t in tokens[i : i + k]]
        i += k
        base = at if own else 0j
        point = lambda j: base + complex(x[j], x[j + 1])  # noqa: B023, E731
        if kind == "Z":
            yield "close", (at, start)
            at, command = start, ""
        elif kind == "M":
            at = start = point(0)
            command = "l" if own else "L"
        elif kind in "LHV":
            end = point(0) if kind == "L" else complex(x[0] + base.real, at.imag) if kind == "H" else complex(at.real, x[0] + base.imag)
            yield "line", (at, end)
            at = end
        elif kind == "A":
            yield "arc", (at, x[0], x[1], x[2], x[3] != 0, x[4] != 0, point(5))
            at = point(5)
        else:
            mirrored = 2 * at - last if before in ("CS" if kind == "S" else "QT") and before else at
            inner = [point(0), point(2)] if kind == "C" else [mirrored, point(0)] if kind == "S" else [point(0)] if kind == "Q" else [mirrored]
            end = point(k - 2)
            yield "curve", (at, *inner, end)
            at, last = end, inner[-1]
        before = kind
        if kind == "Z":
            command = ""


def _pieces(tag: str, e: ET.Element) -> Iterator[tuple[str, tuple]]:
    n = lambda name: _length(e.get(name))
    if tag == "line":
        yield "line", (complex(n("x1"), n("y1")), complex(n("x2"), n("y2")))
    elif tag == "rect":
        x, y, w, h = n("x"), n("y"), n("width"), n("height")
        rx, ry = _length(e.get("rx"), w, -1.0), _length(e.get("ry"), h, -1.0)
        rx, ry = min(ry if rx < 0 else rx, w / 2), min(rx if ry < 0 else ry, h / 2)
        if w > 0 and h > 0 and rx > 0 and ry > 0:
            yield from _rounded(x, y, w, h, rx, ry)
        elif w > 0 and h > 0:
            corner = [complex(x, y), complex(x + w, y), complex(x + w, y + h), complex(x, y + h)]
            for a, b in zip(corner, corner[1:], strict=False):
                yield "line", (a, b)
            yield "close", (corner[3], corner[0])
    elif tag in ("polyline", "polygon"):
        x = [float(t) for t in _NUMBER.findall(e.get("points", ""))]
        p = [complex(a, b) for a, b in zip(x[::2], x[1::2], strict=False)]
        for a, b in zip(p, p[1:], strict=False):
            yield "line", (a, b)
        if tag == "polygon" and len(p) > 1:
            yield "close", (p[-1], p[0])
    elif tag == "circle" and n("r") > 0:
        yield from _ellipse(n("cx"), n("cy"), n("r"), n("r"))
    elif tag == "ellipse" and n("rx") > 0 and n("ry") > 0:
        yield from _ellipse(n("cx"), n("cy"), n("rx"), n("ry"))
    elif tag == "path":
        yield from _path(e.get("d", ""))


def parse(text: str | None, flatten: int = FLATTEN) -> Drawing:
    """All straight segments of a document; what can't be read is an error in the result, not an exception."""
    if not 1 <= flatten <= FLATTEN_MAX:
        raise ValueError(f"flatten is 1 to {FLATTEN_MAX}")
    out, ordinal, closes = Drawing(), {}, []
    try:
        root = ET.fromstring(text or "")
        named = {e.get("id"): e for e in root.iter() if e.get("id")}
        stack = [(root, viewport(root), 0)]
        while stack:
            e, m, depth = stack.pop()
            tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
            m = times(m, transform(e.get("transform"))) if e.get("transform") else m
            if tag.lower() == "use":
                link = next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == "href"), "")
                target = named.get(link.removeprefix("#")) if link.startswith("#") else None
                if target is not None and depth < USES:
                    m = times(m, (1, 0, 0, 1, _length(e.get("x")), _length(e.get("y"))))
                    if target.tag.rpartition("}")[2].lower() in KEPT:  # what it holds, not the holder
                        m = times(m, transform(target.get("transform")))
                        stack += [(child, m, depth + 1) for child in reversed(list(target))]
                    else:
                        stack.append((target, m, depth + 1))
                continue
            if tag.lower() in KEPT:
                continue
            stack += [(child, m, depth) for child in reversed(list(e))]
            if not tag or tag.lower() in CONTAINERS:
                continue
            if tag not in SHAPES:
                out.skipped[tag] = out.skipped.get(tag, 0) + 1
                continue
            if tag == "path" and not (e.get("d") or "").strip():
                out.skipped["path-without-d"] = out.skipped.get("path-without-d", 0) + 1
                continue
            out.n_elements += 1
            name = e.get("id")
            if not name:
                name = str(ordinal.get(tag, 0))
                ordinal[tag] = ordinal.get(tag, 0) + 1
            held = len(out.segments)
            for kind, p in _pieces(tag, e):
                if kind in ("line", "close"):
                    chain = list(p)
                else:
                    out.n_curves += 1
                    chain = bezier(list(p), flatten) if kind == "curve" else arc(*p, flatten)
                chain = [moved(m, z) for z in chain]
                for a, b in zip(chain, chain[1:], strict=False):
                    if a == b:
                        out.n_degenerate += 1
                        continue
                    if kind == "close":
                        closes.append(len(out.segments))
                    out.segments.append((a, b, f"{tag}#{name}"))
            if len(out.segments) == held:
                out.skipped[tag] = out.skipped.get(tag, 0) + 1
    except (ET.ParseError, ValueError, IndexError, OverflowError) as problem:
        return Drawing(error=f"{type(problem).__name__}: {problem}")
    largest = max((abs(c) for a, b, _ in out.segments for z in (a, b) for c in (z.real, z.imag)), default=0.0) or 1.0
    gone = {i for i in closes if abs(out.segments[i][1] - out.segments[i][0]) < FLOOR_ULPS * EPS * largest}
    out.n_degenerate += len(gone)
    out.segments = [s for i, s in enumerate(out.segments) if i not in gone]
    return out


ROW = "drawing_id string, segments array<struct<seg_ix:int,x1:double,y1:double,x2:double,y2:double,element:string>>, skipped map<string,int>, n_curves int, n_degenerate int, n_elements int, error string"


def _row(key: str, text: str | None, flatten: int) -> tuple:
    d = parse(text, flatten)
    segs = [(i, a.real, a.imag, b.real, b.imag, name) for i, (a, b, name) in enumerate(d.segments)]
    return (key, segs, d.skipped, d.n_curves, d.n_degenerate, d.n_elements, d.error)


def parsed(documents: DataFrame, flatten: int = FLATTEN) -> DataFrame:
    """One row for each document(drawing_id, svg): its segments and what was skipped; error is null if it could be read."""
    names = [x.split()[0] for x in ROW.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_row(k, t, flatten) for k, t in zip(pdf["drawing_id"], pdf["svg"], strict=True)]
            frame = pd.DataFrame(rows, columns=names)
            frame["segments"] = [[dict(zip(("seg_ix", "x1", "y1", "x2", "y2", "element"), s, strict=True)) for s in segs] for segs in frame["segments"]]
            yield frame

    return documents.select(F.col("drawing_id").cast("string"), "svg").mapInPandas(each, ROW)


def segments(rows: DataFrame) -> DataFrame:
    """The segments of parsed() as a segment table."""
    return rows.select("drawing_id", F.inline("segments"))


def written(segs: DataFrame, as_path: bool = False) -> DataFrame:
    """(drawing_id, svg): one document for each drawing, with coordinates that read back bit by bit."""
    num = lambda c: F.col(c).cast("string")  # noqa: E731  the shortest digits that give the same double
    if as_path:
        one = F.concat(F.lit('<path d="M '), num("x1"), F.lit(" "), num("y1"), F.lit(" L "), num("x2"), F.lit(" "), num("y2"), F.lit('" id="s'), F.col("seg_ix").cast("string"), F.lit('"/>'))
    else:
        one = F.concat(F.lit('<line x1="'), num("x1"), F.lit('" y1="'), num("y1"), F.lit('" x2="'), num("x2"), F.lit('" y2="'), num("y2"), F.lit('" id="s'), F.col("seg_ix").cast("string"), F.lit('"/>'))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seg_ix", one.alias("x")))), lambda s: s["x"])
    return segs.groupBy("drawing_id").agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), F.array_join(parts, ""), F.lit("</svg>")).alias("svg"))


def looks_like_svg(text: Column) -> Column:
    """Whether a text is a document and no path: it starts with < and has <svg early, or is declared as XML."""
    head = F.lower(F.ltrim(F.substring(text, 1, 512)))
    return head.startswith("<") & (F.lower(F.substring(text, 1, 4096)).contains("<svg") | head.startswith("<?xml"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(drawing_id, source, svg): the files below path, through Spark's own file reader; broken UTF-8 is replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.svg").load(path)
    return files.select(F.col("path").alias("drawing_id"), F.col("path").alias("source"), F.make_valid_utf8(F.col("content").cast("string")).alias("svg"))


class SvgSource(DataSource):
    """spark.read.format("svg").load(path): segments of the .svg files below a folder that every executor sees.

    A file that can't be read as a drawing is one row with its error and no segment. The folder may be any that the
    file systems of Arrow know; read() is the way through Spark's own file systems.
    """

    @classmethod
    def name(cls) -> str:
        return "svg"

    def schema(self) -> str:
        return "drawing_id string, seg_ix int, x1 double, y1 double, x2 double, y2 double, element string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _SvgReader(self.options)


class _SvgReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.flatten = options["path"], int(options.get("flatten", FLATTEN))

    def _opened(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self):
        from pyarrow import fs

        system, top = self._opened()
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(top, recursive=True)) if f.is_file and f.path.lower().endswith(".svg"))
        return [InputPartition(files[i : i + 64]) for i in range(0, len(files), 64)] or [InputPartition([])]

    def read(self, partition):
        system, _ = self._opened()
        for file in partition.value:
            with system.open_input_stream(file) as f:
                found = parse(f.read().decode("utf-8", "replace"), self.flatten)
            if found.error:
                yield (file, None, None, None, None, None, None, found.error)
            for i, (a, b, name) in enumerate(found.segments):
                yield (file, i, a.real, a.imag, b.real, b.imag, name, None)
