"""Verdicts: for every drawing of a corpus the three integers with the scale that certifies them, or a typed refusal.

One job judges all drawings. A drawing's spectrum is its floor, its merge heights and its vertex-edge distances; wide gaps in
it are candidate scales. Each candidate is judged in full, and the first that neither collapses an edge nor drowns in rounding
gives the verdict. Whole drawings are judged in one task each, many at once (operators/judge.py); those with more segments than
a task should hold as rows of (drawing_id, cand), step by step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chalkline.functions import geometry as G
from chalkline.operators import judge as J
from chalkline.operators import planar as P
from chalkline.plans.scratch import stored, workspace

D, K = P.D, [P.D, "cand"]
VERSION = "0.1.0"
# Reasons, their kinds and the exit code of each status.
GEOMETRY, BUDGET, INPUT = "geometry", "budget", "input"
KIND_OF = {
    "NO_STABLE_SCALE": GEOMETRY, "VERTEX_NEAR_EDGE": GEOMETRY, "EDGES_CROSS": GEOMETRY, "EDGE_COLLAPSED": GEOMETRY, "CURVE_UNSTABLE": GEOMETRY,
    "MARGIN_TOO_SMALL": GEOMETRY, "NO_GEOMETRY": GEOMETRY, "TOO_MANY_PAIRS": BUDGET, "TOO_MANY_VERTICES": BUDGET, "BAD_INPUT": INPUT,
}
EXIT = {"CERTIFIED": 0, "HELD": 0, "BROKEN": 1, "REFUSED": 2, "BAD INPUT": 3}
FALL_THROUGH = ("EDGE_COLLAPSED", "MARGIN_TOO_SMALL")
SITE = "struct<xy:array<double>,element:string,edge:string,other:string,d:double,length:double,ratio:double,failed:string,count:bigint>"


def site(**fields: Column) -> Column:
    kinds = dict(x.split(":", 1) for x in SITE[7:-1].split(",") if ":" in x)
    return F.struct(*[fields.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def _sites(rows: DataFrame, keys: list[str], order: list, one: Column) -> DataFrame:
    """(keys, n, look_at): the number of rows and the first few as sites."""
    ranked = rows.withColumn("_s", one).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    few = F.array_sort(F.collect_list(F.when(F.col("_k") <= G.SITES, F.struct("_k", "_s"))))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.transform(few, lambda x: x["_s"]).alias("look_at"))


def sizes_of(segments: DataFrame, vs: DataFrame) -> DataFrame:
    """(drawing_id, m, n, floor, margin): segments, vertices and the two scales of rounding."""
    largest = F.max(F.greatest(*[F.abs(c) for c in ("x1", "y1", "x2", "y2")]))
    return segments.groupBy(D).agg(F.count("*").alias("m"), largest.alias("big")).join(vs.groupBy(D).agg(F.count("*").alias("n")), D).select(D, "m", "n", G.ulps(G.FLOOR_ULPS, F.col("big")).alias("floor"), G.ulps(G.MARGIN_ULPS, F.col("big")).alias("margin"))


def spectrum(vs: DataFrame, es: DataFrame, trees: DataFrame, sizes: DataFrame) -> DataFrame:
    """(drawing_id, s): the floor and every larger separation, each once."""
    apart = P.vertex_edge(P.with_ends(P.distinct_edges(es), vs), vs).select(D, F.col("d").alias("s")).distinct()
    found = trees.select(D, F.col("w").alias("s")).union(apart).join(sizes.select(D, "floor"), D).where("s > floor").select(D, "s")
    return found.union(sizes.select(D, F.col("floor").alias("s"))).distinct()


def gaps(values: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, lo, hi, ratio, nth): consecutive separations; nth counts from 0 at the floor."""
    up = Window.partitionBy(*(keys or [D])).orderBy("s")
    both = values.withColumn("hi", F.lead("s").over(up)).withColumn("nth", F.row_number().over(up) - 1).where("hi is not null")
    return both.select(*(keys or [D]), F.col("s").alias("lo"), "hi", (F.col("hi") / F.col("s")).alias("ratio"), "nth")


def windows(trees: DataFrame, all_gaps: DataFrame, vs: DataFrame, sizes: DataFrame, rho: float, cand_max: int, grid: float | DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Candidate windows in the order they are tried, and the clusters of each.

    Wide gaps by ratio, the gap above the floor last; a window whose largest cluster is too large is none. With a grid,
    the gap that the grid lies in.
    """
    wide = all_gaps.where(F.col("ratio") >= rho)
    if grid is not None:
        wide = wide.join(grid.select(D, "grid"), D) if isinstance(grid, DataFrame) else wide.withColumn("grid", F.lit(grid))
        wide = wide.where((F.col("lo") <= F.col("grid")) & (F.col("grid") < F.col("hi")))
    labels = stored(P.clustered(trees, wide, sizes), "clusters")
    points = labels.join(vs, [D, "v"])
    size = points.groupBy(D, "lo", "label").agg(F.count("*").alias("size"), F.min(F.struct("x", "y")).alias("rep"))
    many = points.join(size.where("size > 1").select(D, "lo", "label", "size"), [D, "lo", "label"]).where(F.col("size") <= G.CLUSTER_MAX)
    other = many.select(D, "lo", "label", F.col("x").alias("x2"), F.col("y").alias("y2"))
    diameter = many.join(other, [D, "lo", "label"]).groupBy(D, "lo").agg(F.max(G.dist(*map(F.col, ("x", "y", "x2", "y2")))).alias("diam_max"))
    fit = size.groupBy(D, "lo").agg(F.max("size").alias("largest"), F.count("*").alias("n_clusters")).where(F.col("largest") <= G.CLUSTER_MAX)
    order = Window.partitionBy(D).orderBy((F.col("nth") == 0).cast("int"), F.desc("ratio"), "lo")
    ranked = wide.join(fit, [D, "lo"]).join(diameter, [D, "lo"], "left").withColumn("cand", F.row_number().over(order) - 1).where(F.col("cand") < cand_max)
    radius = F.col("grid") if grid is not None else F.sqrt(F.col("lo") * F.col("hi"))
    tried = ranked.join(sizes.select(D, "n", "m", "margin"), D).select(*K, F.col("lo").alias("t_below"), F.col("hi").alias("t_above"), "ratio", radius.cast("double").alias("radius"), "n_clusters", (F.col("n") - F.col("n_clusters")).alias("n_merged"), F.coalesce("diam_max", F.lit(0.0)).alias("diam_max"), "n", "m", "margin")
    tried = stored(tried, "windows")
    placed = labels.join(tried.select(*K, F.col("t_below").alias("lo")), [D, "lo"]).join(size.select(D, "lo", "label", "rep"), [D, "lo", "label"]).select(*K, "v", "label", "rep")
    return tried, stored(placed, "placed")


def _judged(segments: DataFrame, es: DataFrame, tried: DataFrame, placed: DataFrame, budget: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every candidate's outcome, and the vertices and final edges of each."""
    points = placed.select(*K, F.col("label").alias("v"), F.col("rep.x").alias("x"), F.col("rep.y").alias("y")).distinct()
    ends = es
    for name in ("a", "b"):
        ends = ends.join(placed.select(*K, F.col("v").alias(name), F.col("label").alias(f"l{name}")), [D, name] if name == "a" else [D, "cand", name])
    ends = stored(ends.select(*K, "seg_ix", "element", F.col("la").alias("a"), F.col("lb").alias("b")), "ends")
    first = segments.select(D, "seg_ix", "x1", "y1", G.dist(*map(F.col, ("x1", "y1", "x2", "y2"))).alias("length"))
    dead = _sites(ends.where("a = b").join(first, [D, "seg_ix"]), K, ["seg_ix"], site(element=F.col("element"), xy=F.array("x1", "y1"), length=F.col("length")))
    whole = tried.where("t_above > margin").join(dead.select(*K, F.lit(True).alias("dead")), K, "left").where("dead is null")
    number = F.row_number().over(Window.partitionBy(*K).orderBy("seg_ix")) - 1
    unique = P.distinct_edges(ends.join(whole.select(*K), K), K).withColumn("e", number)
    n_edges = unique.groupBy(*K).agg(F.count("*").alias("n_edges"))
    fits = whole.join(n_edges, K).where(F.col("n_clusters") * F.col("n_edges") <= budget)
    near = stored(P.vertex_edge(P.with_ends(unique.join(fits.select(*K, "t_above"), K), points, K), points, K, F.col("t_above")), "near")
    owners = ends.select(*K, F.inline(F.array(*[F.struct(F.col(n).alias("v"), "seg_ix", "element") for n in "ab"]))).groupBy(*K, "v").agg(F.min_by("element", "seg_ix").alias("owner"))
    band = _sites(near.where("d > 0").join(owners, [*K, "v"]), K, ["d", "e", "v"], site(xy=F.array("x", "y"), element=F.col("owner"), edge=F.col("element"), d=F.col("d")))
    clear = fits.join(band.select(*K, F.lit(True).alias("band")), K, "left").where("band is null").select(*K)
    on = near.where("d = 0").join(clear, K)
    final = stored(P.subdivided(unique.join(clear, K), on, K).withColumn("e", F.row_number().over(Window.partitionBy(*K).orderBy("a", "b")) - 1), "final")
    n_final = final.groupBy(*K).agg(F.count("*").alias("n_final"), F.sum("parts").alias("parts"))
    small = n_final.where(F.col("n_final") * F.col("n_final") <= budget).select(*K)
    cross = _sites(P.crossings(P.with_ends(final.join(small, K), points, K), K), K, ["e", "e2"], site(element=F.col("element"), other=F.col("other"), xy=F.col("xy")))
    counted = P.euler(points.join(small, K), final.join(small, K), K)
    split = on.groupBy(*K).agg(F.count_distinct("e").alias("n_subdivided"))
    out = tried.join(n_edges, K, "left").join(n_final, K, "left").join(split, K, "left").join(counted, K, "left")
    for name, found in (("dead", dead), ("band", band), ("cross", cross)):
        out = out.join(found.select(*K, F.col("n").alias(f"n_{name}"), F.col("look_at").alias(f"at_{name}")), K, "left")
    pairs1, pairs2 = F.col("n_clusters") * F.col("n_edges"), F.col("n_final") * F.col("n_final")
    steps = [
        ("MARGIN_TOO_SMALL", ~(F.col("t_above") > F.col("margin")), F.array(site(xy=F.array("t_above", "margin"), failed=F.lit("margin"))), F.lit(1)),
        ("EDGE_COLLAPSED", F.col("n_dead") > 0, F.col("at_dead"), F.col("n_dead")),
        ("TOO_MANY_PAIRS", pairs1 > budget, F.array(site(element=F.lit("pairs"), count=pairs1)), F.lit(1)),
        ("VERTEX_NEAR_EDGE", F.col("n_band") > 0, F.col("at_band"), F.col("n_band")),
        ("TOO_MANY_PAIRS", pairs2 > budget, F.array(site(element=F.lit("pairs"), count=pairs2)), F.lit(1)),
        ("EDGES_CROSS", F.col("n_cross") > 0, F.col("at_cross"), F.col("n_cross")),
    ]
    pick = lambda i, typed: F.coalesce(*[F.when(s[1], F.lit(s[0]) if i == 0 else s[i].cast(typed)) for s in steps])
    outcome = out.withColumns({"reason": pick(0, "string"), "look_at": pick(2, f"array<{SITE}>"), "sites": pick(3, "bigint")})
    outcome = outcome.withColumn("n_subdivided", F.coalesce("n_subdivided", F.lit(0))).withColumn("n_dup_edges", F.col("m") - F.col("n_edges") + F.col("parts") - F.col("n_final"))
    return outcome, points, final


ANSWER = ["v", "e", "pieces", "faces", "chi", "dangles", "t_below", "t_above", "ratio", "radius", "n_subdivided", "n_dup_edges", "n_merged", "diam_max"]


def verdicts(segments: DataFrame, drawings: DataFrame | None = None, *, rho: float = G.RHO, cand_max: int = G.CAND_MAX, grid: float | DataFrame | None = None, max_vertices: int | None = None, digests: bool = False) -> DataFrame:
    """One row for each drawing: status, reason, kind, the integers and scales, and up to eight sites to look at.

    grid: a scale for all drawings, or (drawing_id, grid).

    drawings(drawing_id) adds drawings without segments, which are refused; a drawing with a coordinate that is no finite
    number is bad input. A refused drawing has null integers, never 0.
    """
    cap = G.VERTEX_CAP if max_vertices is None else max_vertices
    with workspace(segments.sparkSession) as own:  # the tables between the steps go when the verdicts are written
        found = stored(_by_drawing(segments, rho, cand_max, grid, cap, digests), "judged")
        large = found.where(F.col("reason") == J.TOO_LARGE).select(D)
        if large.limit(1).count():
            rest = segments.join(stored(large, "large"), D, "left_semi")
            found = found.where(~F.col("reason").eqNullSafe(F.lit(J.TOO_LARGE))).unionByName(_by_tables(rest, rho, cand_max, grid, cap, digests))
        elif drawings is None:
            return own.keep(found)
        return own.keep(stored(_with_empty(found, segments, drawings, rho, grid), "verdicts"))


def _named(found: DataFrame, rho: float, grid: float | DataFrame | None) -> DataFrame:
    """found with what follows from the reason."""
    kind = F.create_map(*[F.lit(x) for kv in KIND_OF.items() for x in kv])
    status = F.when(F.col("reason").isNull(), "CERTIFIED").when(F.col("reason") == "BAD_INPUT", "BAD INPUT").otherwise("REFUSED")
    return found.withColumns({"status": status, "kind": kind[F.col("reason")], "rho": F.lit(float(rho)), "grid_source": F.lit("derived" if grid is None else "user")})


def _by_drawing(segments: DataFrame, rho: float, cand_max: int, grid: float | DataFrame | None, cap: int, digests: bool) -> DataFrame:
    """The verdicts of whole drawings, each in one task; a drawing of more than J.LARGE segments is marked J.TOO_LARGE.

    One sort by drawing is all that moves: where the segments are spread by drawing already, nothing does.
    """
    kinds, scale, most = dict(segments.dtypes), grid if isinstance(grid, float | int) else None, J.LARGE
    if isinstance(grid, DataFrame):
        segments = segments.join(grid.select(D, F.col("grid").cast("double").alias("grid")), D, "left")
    coords = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    place = F.row_number().over(Window.partitionBy(D).orderBy("seg_ix")).alias("_place")
    rows = segments.select(D, *coords, F.col("element").cast("string").alias("element"), *(["grid"] if isinstance(grid, DataFrame) else []), place)
    doubles = ", ".join(f"{c} {'double' if c in J.DOUBLES else 'bigint'}" for c in [*ANSWER, "n_candidates"])
    schema = f"{D} {kinds[D]}, reason string, {doubles}, look_at array<{SITE}>, n_more bigint" + (", digest string" if digests else "")
    names = [D, "reason", *ANSWER, "n_candidates", "look_at", "n_more", *(["digest"] if digests else [])]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, new in J.whole_drawings(batches, "_place", cap, most):
            if len(new):
                yield J.judged(part, new, rho, cand_max, scale, cap, VERSION if digests else None).select(names)
            else:
                out = J.judged(part, np.zeros(1, np.int64), rho, cand_max, scale, cap, VERSION if digests else None).select(names)
                yield out.set_column(1, "reason", pa.array([J.TOO_LARGE], pa.string()))

    found = _named(rows.mapInArrow(judge, schema).where(F.col(D).isNotNull() | (F.col("reason") == "BAD_INPUT")), rho, grid)
    return found.select(*[c for c in found.columns if c != "digest"], *(["digest"] if digests else []))


def _lacking(rows: DataFrame, reason: str, look: Column) -> DataFrame:
    """Refusals of rows(drawing_id, ...), with the columns that verdicts start with."""
    return rows.select(D, F.lit(reason).alias("reason"), *[F.lit(None).cast("double" if c in J.DOUBLES else "bigint").alias(c) for c in [*ANSWER, "n_candidates"]], look.cast(f"array<{SITE}>").alias("look_at"), F.lit(0).cast("bigint").alias("n_more"))


def _with_empty(found: DataFrame, segments: DataFrame, drawings: DataFrame | None, rho: float, grid: float | DataFrame | None) -> DataFrame:
    """found and the refusals of drawings that have no segments."""
    if drawings is None:
        return found
    skipped = F.col("skipped") if "skipped" in drawings.columns else F.lit(None).cast("map<string,int>")
    look = F.transform(F.array_sort(F.map_entries(skipped)), lambda x: site(element=x["key"], count=x["value"]))
    empty = drawings.join(segments.select(D).distinct(), D, "left_anti")
    broken = F.col("error").isNotNull() if "error" in drawings.columns else F.lit(False)
    more = _lacking(empty.where(~broken), "NO_GEOMETRY", look).union(_lacking(empty.where(broken), "BAD_INPUT", F.lit(None)))
    return found.unionByName(_named(more, rho, grid), allowMissingColumns=True)


def _by_tables(segments: DataFrame, rho: float, cand_max: int, grid: float | DataFrame | None, cap: int, digests: bool) -> DataFrame:
    """The verdicts of drawings that no task holds: each step is a relation of all drawings."""
    budget = G.pair_budget(cap)
    bad = segments.where(~P.finite(segments)).select(D).distinct()
    good = stored(segments.join(bad, D, "left_anti"), "segments")
    vs = stored(P.vertices(good), "vertices")
    es = stored(P.edges(good, vs), "edges")
    sizes = stored(sizes_of(good, vs), "sizes")
    over = (F.col("n") > cap) | (F.col("n") * F.col("m") > budget)
    fit = sizes.where(~over)
    vs, es = vs.join(fit.select(D), D, "left_semi"), es.join(fit.select(D), D, "left_semi")
    trees = stored(P.minimum_trees(vs), "trees")
    all_gaps = stored(gaps(spectrum(vs, es, trees, fit)), "gaps")
    tried, placed = windows(trees, all_gaps, vs, fit, rho, cand_max, grid)
    outcome, points, final = _judged(good, es, tried, placed, budget)
    outcome = stored(outcome, "outcomes")
    n_cands = Window.partitionBy(D)
    decided = F.when(~F.coalesce(F.col("reason").isin(*FALL_THROUGH), F.lit(False)), F.col("cand"))
    rows = outcome.withColumn("n_candidates", F.count("*").over(n_cands)).withColumn("at", F.coalesce(F.min(decided).over(n_cands), F.lit(0))).where("cand = at")
    known = [F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ANSWER]
    judged = rows.select(D, "cand", "reason", *known, F.when(F.col("reason").isNull(), F.col("n_candidates")).alias("n_candidates"), "look_at", F.greatest(F.col("sites") - G.SITES, F.lit(0)).alias("n_more"))
    without = stored(fit.join(judged.select(D), D, "left_anti").select(D), "without")
    first = F.row_number().over(Window.partitionBy(D).orderBy(F.desc("ratio"), "lo"))
    widest = all_gaps.join(without, D).withColumn("place", first).where("place <= 3")
    gap = F.struct("place", site(xy=F.array("lo", "hi"), ratio=F.col("ratio"), failed=F.when(F.col("ratio") < rho, "ratio below rho").otherwise("cluster above the largest")).alias("s"))
    listed = widest.groupBy(D).agg(F.transform(F.array_sort(F.collect_list(gap)), lambda g: g["s"]).alias("look_at"))
    lacking = lambda rows_, reason, look: _lacking(rows_, reason, look).withColumn("cand", F.lit(None).cast("int")).select(judged.columns)
    unscaled = lacking(without.join(listed, D, "left"), "NO_STABLE_SCALE", F.col("look_at"))
    large = lacking(sizes.where(over), "TOO_MANY_VERTICES", F.array(site(element=F.lit("vertices"), count=F.col("n"))))
    out = judged.union(unscaled).union(large).union(lacking(bad, "BAD_INPUT", F.lit(None)))
    out = _named(out, rho, grid)
    if digests:
        out = out.join(digest(points, final, outcome, rho), K, "left").withColumn("digest", F.when(F.col("reason").isNull(), F.col("digest")))
    return out.drop("cand")


def digest(points: DataFrame, final: DataFrame, outcome: DataFrame, rho: float, flatten: tuple[int, int] = (0, 0)) -> DataFrame:
    """(drawing_id, cand, digest): SHA-1 of an arrangement as canonical JSON."""
    reps = points.groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("x", "y", "v"))).alias("reps"))
    links = final.groupBy(*K).agg(F.collect_list(F.struct("a", "b")).alias("links"))

    @F.pandas_udf("string")
    def hashed(reps: pd.Series, links: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        out = []
        for r, ab, a, b in zip(reps, links, lo, hi, strict=True):
            rank = {p["v"]: i for i, p in enumerate(r)}
            edges = sorted(sorted((rank[x["a"]], rank[x["b"]])) for x in ab)
            out.append(J.sha1([[float(p["x"]), float(p["y"])] for p in r], edges, a, b, rho, flatten, VERSION))
        return pd.Series(out)

    return outcome.join(reps, K).join(links, K).select(*K, hashed("reps", "links", "t_below", "t_above").alias("digest"))


def rebuilt(segments: DataFrame, found: DataFrame) -> DataFrame:
    """(drawing_id, faces, same): certified drawings judged anew at the radius of their own certificates.

    same: the second arrangement has the vertices, edges, pieces, faces and upper scale of the first.
    """
    held = found.where("status = 'CERTIFIED'")
    own = segments.join(held.select(D), D, "left_semi")
    again = verdicts(own, grid=held.select(D, F.col("radius").alias("grid")))
    told = ["v", "e", "pieces", "faces", "t_above"]
    both = held.select(D, "faces", F.struct(*told).alias("first")).join(again.select(D, F.struct(*told).alias("second")), D, "left")
    return both.select(D, "faces", F.col("first").eqNullSafe(F.col("second")).alias("same"))


def by_ratio(segments: DataFrame, truth: DataFrame, ratios: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """(rho, by, wrong, exact, refused, merged_nothing): verdicts at several ratios against truth(drawing_id, by, truth).

    merged_nothing: the wrong ones that left every vertex apart.
    """
    known = truth.select(D, *(by or []), "truth")
    judged = [known.join(verdicts(segments, rho=r).select(D, F.col("faces").alias("answer"), "n_merged").hint("merge"), D, "left").withColumn("rho", F.lit(float(r))) for r in ratios]
    rows = judged[0]
    for other in judged[1:]:
        rows = rows.union(other)
    wrong = F.col("answer").isNotNull() & (F.col("answer") != F.col("truth"))
    return rows.groupBy("rho", *(by or [])).agg(F.count_if(wrong).alias("wrong"), F.count_if(F.col("answer") == F.col("truth")).alias("exact"), F.count_if(F.col("answer").isNull()).alias("refused"), F.count_if(wrong & (F.col("n_merged") == 0)).alias("merged_nothing"))


def settled(passes: DataFrame) -> DataFrame:
    """One verdict for each drawing from two flattenings: rows of verdicts() with pass 1 and, where there are curves, 2.

    The coarse verdict stands if both agree in status and integers, or in status and reason; a budget refusal of the fine
    pass is the verdict; else the curve is unstable. A budget refusal of the coarse pass is not tried again.
    """
    answers = ["status", "reason", "kind", "pieces", "faces", "chi", "look_at"]
    fine = passes.where("pass = 2").select(D, F.struct(*answers).alias("fine"))
    out = passes.where("pass = 1").join(fine, D, "left")
    shape = lambda p: F.when(F.col(f"{p}status") == "CERTIFIED", F.concat_ws("/", *[F.col(p + c).cast("string") for c in ("pieces", "faces", "chi")])).otherwise(F.concat_ws("/", F.col(f"{p}status"), F.col(f"{p}reason")))
    moved = F.col("fine").isNotNull() & ~F.coalesce(F.col("kind") == BUDGET, F.lit(False)) & (shape("") != shape("fine."))
    reason = F.when(F.col("fine.kind") == BUDGET, F.col("fine.reason")).otherwise("CURVE_UNSTABLE")
    kept = [c for c in passes.columns if c not in (D, "pass", "status", "reason", "kind", "rho", "grid_source", "look_at", "n_more")]
    return out.select(D, F.when(moved, "REFUSED").otherwise(F.col("status")).alias("status"), F.when(moved, reason).otherwise(F.col("reason")).alias("reason"), F.when(moved, F.when(F.col("fine.kind") == BUDGET, BUDGET).otherwise(GEOMETRY)).otherwise(F.col("kind")).alias("kind"), *[F.when(~moved, F.col(c)).alias(c) for c in kept], F.when(moved, F.col("fine.look_at")).otherwise(F.col("look_at")).alias("look_at"), "n_more", "rho", "grid_source")


def checked(claims: DataFrame, found: DataFrame, key: str = D) -> DataFrame:
    """Claims(key, faces, pieces, chi; null: not claimed) against verdicts: HELD, BROKEN or REFUSED, and the exit code.

    A claim that claims nothing raises an error.
    """
    names = ("faces", "pieces", "chi")
    said = claims.select(key, *[F.col(n).alias(f"said_{n}") for n in names])
    none = F.coalesce(*[f"said_{n}" for n in names]).isNull()
    both = said.where(F.assert_true(~none, F.lit("nothing is claimed")).isNull()).join(found.select(key, "status", *names).hint("merge"), key)  # few bytes in files may be many rows: never broadcast
    same = F.lit(True)
    for n in names:
        same &= F.col(f"said_{n}").isNull() | (F.col(f"said_{n}") == F.col(n))
    verdict = F.when(F.col("status") == "BAD INPUT", "BAD INPUT").when(F.col("status") != "CERTIFIED", "REFUSED").when(same, "HELD").otherwise("BROKEN")
    code = F.create_map(*[F.lit(x) for kv in EXIT.items() for x in kv])
    return both.withColumn("verdict", verdict).withColumn("exit_code", code[F.col("verdict")])
