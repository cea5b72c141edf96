"""Many whole drawings at once, judged in numpy: what plans/verdicts.py says by tables, for a run of drawings in one task.

Drawings come as runs of segments in order. Vertices, edges and pairs of all drawings of a run lie in flat arrays that lead with
the drawing, and pairs are made in chunks, so a run of small drawings costs a few array operations and a large one no more than
its spectrum in memory. Candidates are tried in rounds: a drawing whose candidate decides takes no part in the next round.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.functions import geometry as G
from chalkline.operators.planar import PAIRS, D, chunks, finite, numbered, offsets, places, roots_of, spread, starts, trees_of, whole_groups

RUN = 1 << 22  # pairs of the drawings that are judged together, at most, unless it is one drawing
LARGE = 1 << 16  # segments of a drawing that a task holds
NULL = 0x7FF8000000000001  # bits of a NaN that arithmetic does not make
TOO_LARGE = "TOO_LARGE"  # the mark of a drawing with more segments
LONGS = ["v", "e", "pieces", "faces", "chi", "dangles", "n_subdivided", "n_dup_edges", "n_merged", "n_candidates"]
DOUBLES = ["t_below", "t_above", "ratio", "radius", "diam_max"]
SITE = pa.struct([("xy", pa.list_(pa.float64())), ("element", pa.string()), ("edge", pa.string()), ("other", pa.string()), ("d", pa.float64()), ("length", pa.float64()), ("ratio", pa.float64()), ("failed", pa.string()), ("count", pa.int64())])


def sha1(reps: list, edges: list, lo: float, hi: float, rho: float, flatten: tuple[int, int], version: str) -> str:
    """Of an arrangement as canonical JSON: reps in order, edges as pairs of their places."""
    payload = {"reps": reps, "edges": edges, "t_below": lo, "t_above": hi, "rho": float(rho), "flatten": list(flatten), "version": version}
    return hashlib.sha1(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _before(group: np.ndarray, x: np.ndarray, of: np.ndarray, q: np.ndarray, equal: bool) -> np.ndarray:
    """For each (of, q) how many (group, x), sorted alike, come before it; equal: those equal to it too."""
    kind = np.concatenate([np.full(len(x), int(not equal)), np.full(len(q), int(equal))])
    order = np.lexsort((kind, np.concatenate([x, q]), np.concatenate([group, of])))
    mine = order < len(x)
    out = np.empty(len(q), np.int64)
    out[order[~mine] - len(x)] = np.cumsum(mine)[~mine]
    return out


def _vertices(g: np.ndarray, ends: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(drawing, x, y) of every vertex by first appearance, and each segment's two."""
    px, py = (np.empty(2 * len(g), c.dtype) for c in ends[:2])
    px[0::2], py[0::2], px[1::2], py[1::2] = ends
    px, py, pg = px + px.dtype.type(0), py + py.dtype.type(0), np.repeat(g, 2)  # -0.0 is 0.0
    order = np.lexsort((py, px, pg))
    new = starts(pg[order], px[order], py[order])
    first = order[new]
    by_first = np.argsort(first)
    number = np.empty(len(first), np.int64)
    number[by_first] = np.arange(len(first))
    of = np.empty(len(order), np.int64)
    of[order] = number[np.cumsum(new) - 1]
    at = first[by_first]
    return pg[at], px[at], py[at], of[0::2], of[1::2]


def _vertex_edge(x, y, ax, ay, bx, by) -> tuple[np.ndarray, np.ndarray]:
    """(t, d) as geometry.seg_param and seg_dist have them."""
    dx, dy = bx - ax, by - ay
    den = dx * dx + dy * dy
    t = np.where(den > 0, np.fmax(0.0, np.fmin(1.0, ((x - ax) * dx + (y - ay) * dy) / den)), 0.0)
    px, py = x - (ax + t * dx), y - (ay + t * dy)
    return t, np.sqrt(px * px + py * py)


def _spectra(n: np.ndarray, x: np.ndarray, y: np.ndarray, ends: tuple, trees: tuple, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(drawing, s), sorted: the floor and every larger separation, each once."""
    ug, ua, ub = ends
    first, found = offsets(n), [(np.arange(len(n)), floor), (trees[0], trees[3])]
    for part in chunks(n[ug]):
        times = n[ug[part]]
        _, at = spread(first[ug[part]], times)
        more = lambda c: np.repeat(c, times)  # noqa: B023, E731
        a, b, g = ua[part], ub[part], more(ug[part])
        _, d = _vertex_edge(x[at], y[at], more(x[a]), more(y[a]), more(x[b]), more(y[b]))
        held = (d > floor[g]) & (at != more(a)) & (at != more(b))
        g, d = g[held], d[held]
        if len(g) and len(g) > 500 * (1 + g[-1] - g[0]):  # large drawings: most distances repeat
            cut = np.flatnonzero(starts(g))
            each = [np.unique(v) for v in np.split(d, cut[1:])]
            g, d = np.repeat(g[cut], [len(v) for v in each]), np.concatenate(each)
        found.append((g, d))
    g, s = (np.concatenate(p) for p in zip(*found, strict=True))
    held = s >= floor[g]
    g, s = g[held], s[held]
    order = np.lexsort((s, g))
    g, s = g[order], s[order]
    new = starts(g, s)
    return g[new], s[new]


class _Sites:
    """Places to look at, as flat columns: (drawing, round, place) and the fields of SITE."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, int, np.ndarray, dict]] = []

    def add(self, g: np.ndarray, nth: int, most: int = G.SITES, **fields) -> None:
        """Rows sorted by drawing and order; the first few of each drawing stay. xy is a pair of columns."""
        place = places(g)
        few = np.flatnonzero(place < most)
        if len(few):
            own = {k: (v[0][few], v[1][few]) if k == "xy" else v.take(pa.array(few)) if isinstance(v, (pa.Array, pa.ChunkedArray)) else v[few] for k, v in fields.items()}
            self.parts.append((g[few], nth, place[few], own))

    def column(self, rows: int, chosen: np.ndarray, none: np.ndarray) -> pa.Array:
        """look_at of every drawing from the sites of its chosen round; none: null."""
        columns: dict[str, list] = {f.name: [] for f in SITE}
        gs, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for g, nth, place, fields in self.parts:
            held = np.flatnonzero(chosen[g] == nth)
            gs.append(g[held])
            places.append(place[held])
            for f in SITE:
                v = fields.get(f.name)
                if v is None:
                    v = pa.nulls(len(held), f.type)
                elif f.name == "xy":
                    v = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * 2, pa.int32()), pa.array(np.stack([v[0][held], v[1][held]], axis=1).ravel()))
                elif isinstance(v, (pa.Array, pa.ChunkedArray)):
                    v = v.take(pa.array(held))
                    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
                    v = v.cast(f.type)
                else:
                    v = pa.array(v[held], f.type)
                columns[f.name].append(v)
        g, place = np.concatenate(gs), np.concatenate(places)
        order = np.lexsort((place, g))
        flat = [pa.concat_arrays(c).take(pa.array(order)) if c else pa.nulls(0, SITE.field(k).type) for k, c in columns.items()]
        ends = np.concatenate([[0], np.cumsum(np.bincount(g, minlength=rows))])
        mask = np.concatenate([none, [False]])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=mask), pa.StructArray.from_arrays(flat, fields=list(SITE)))


def judged(rows: pa.Table, new: np.ndarray, rho: float, cand_max: int, grid: float | None, cap: int, version: str | None) -> pa.RecordBatch:
    """One row for each drawing of rows(drawing_id, seg_ix, x1, y1, x2, y2, element[, grid]), whose drawings start at `new`.

    version: that of the digests, None for none.
    """
    with np.errstate(all="ignore"):
        return _judged(rows, new, rho, cand_max, grid, cap, version)


def _judged(rows: pa.Table, new: np.ndarray, rho: float, cand_max: int, grid: float | None, cap: int, version: str | None) -> pa.RecordBatch:
    total, budget = len(new), G.pair_budget(cap)
    column = lambda c: rows.column(c).to_numpy().astype(float)
    coords = [column(c) for c in ("x1", "y1", "x2", "y2")]
    g = np.zeros(rows.num_rows, np.int64)
    g[new] = 1
    g = np.cumsum(g) - 1
    scale = np.full(total, np.nan if grid is None else grid) if "grid" not in rows.column_names else column("grid")[new]
    gridded = grid is not None or "grid" in rows.column_names
    longs = {c: np.zeros(total, np.int64) for c in LONGS}
    doubles = {c: np.zeros(total) for c in DOUBLES}
    reason, more, digest = np.full(total, None, object), np.zeros(total, np.int64), np.full(total, None, object)
    chosen, sites = np.full(total, -1), _Sites()

    bad = np.bincount(g, ~np.logical_and.reduce([np.isfinite(c) for c in coords]), minlength=total) > 0
    reason[bad] = "BAD_INPUT"
    si = np.flatnonzero(~bad[g])
    vg, vx, vy, sa, sb = _vertices(g[si], [c[si] for c in coords])
    m, n = np.bincount(g[si], minlength=total), np.bincount(vg, minlength=total)
    over = (n > cap) | (n * m > budget)
    reason[over] = "TOO_MANY_VERTICES"
    large = np.flatnonzero(over)
    sites.add(large, -1, element=pa.array(["vertices"] * len(large), pa.string()), count=n[large])
    if over.any():
        held = ~over[vg]
        number = np.cumsum(held) - 1
        keep = ~over[g[si]]
        si, sa, sb = si[keep], number[sa[keep]], number[sb[keep]]
        vg, vx, vy = vg[held], vx[held], vy[held]
        n = np.where(over, 0, n)
        m = np.where(over, 0, m)
    sg, element = g[si], rows.column("element")
    x1, y1, x2, y2 = (c[si] for c in coords)
    big = np.zeros(total)
    np.maximum.at(big, vg, np.maximum(np.abs(vx), np.abs(vy)))
    big[big == 0] = 1.0
    floor, margin = G.FLOOR_ULPS * G.EPS * big, G.MARGIN_ULPS * G.EPS * big
    fit = n > 0
    first = offsets(n)

    trees = trees_of(n, vx, vy)
    a, b = np.minimum(sa, sb), np.maximum(sa, sb)
    _, at = np.unique(a * len(vx) + b, return_index=True)
    s_g, s = _spectra(n, vx, vy, (sg[at], a[at], b[at]), trees, floor)
    pair = np.flatnonzero(s_g[1:] == s_g[:-1])
    gap_g, lo, hi, nth = s_g[pair], s[pair], s[pair + 1], places(s_g)[pair]
    ratio = hi / lo
    held = np.flatnonzero((ratio >= rho) & fit[gap_g] & (~gridded | ((lo <= scale[gap_g]) & (scale[gap_g] < hi))))

    # Clusters of every wide gap; a window whose largest cluster is too large is none.
    t_g, t_a, t_b, t_w = trees
    t_n = np.bincount(t_g, minlength=total)
    w_g, w_n = gap_g[held], n[gap_g[held]]
    w_first = offsets(w_n)
    own, edge = spread(offsets(t_n)[w_g], t_n[w_g])
    joined = t_w[edge] <= lo[held][own]
    own, edge = own[joined], edge[joined]
    shift = w_first[own] - first[w_g[own]]
    root = roots_of(int(w_n.sum()), np.stack([t_a[edge] + shift, t_b[edge] + shift], axis=1))
    size = np.bincount(root, minlength=len(root))
    largest = np.maximum.reduceat(size, w_first) if len(w_first) else size
    n_clusters = np.add.reduceat((size > 0).astype(np.int64), w_first) if len(w_first) else size
    small = np.flatnonzero(largest <= G.CLUSTER_MAX)
    order = small[np.lexsort((lo[held][small], -ratio[held][small], nth[held][small] == 0, w_g[small]))]
    cand = places(w_g[order])
    order, cand = order[cand < cand_max], cand[cand < cand_max]
    longs["n_candidates"] = np.bincount(w_g[order], minlength=total)

    open_ = np.ones(total, bool)
    for k in range(int(cand.max(initial=-1)) + 1):
        win = order[(cand == k) & open_[w_g[order]]]
        if not len(win):
            break
        wg = w_g[win]  # sorted
        here = np.zeros(total, bool)
        here[wg] = True
        per = lambda v: _scattered(total, wg, v)  # noqa: B023, E731
        below, above, k_cl = per(lo[held][win]), per(hi[held][win]), per(n_clusters[win])
        # Labels are the smallest vertex of a cluster; its place is the smallest point.
        label = np.full(len(vx), -1)
        _, from_ = spread(w_first[win], w_n[win])
        _, to = spread(first[wg], w_n[win])
        label[to] = root[from_] + np.repeat(first[wg] - w_first[win], w_n[win])
        count = np.bincount(label[to], minlength=len(vx))
        rx, ry = vx.copy(), vy.copy()
        many = to[count[label[to]] > 1]
        many = many[np.lexsort((vy[many], vx[many], label[many]))]
        lead = many[starts(label[many])]
        rx[label[lead]], ry[label[lead]] = vx[lead], vy[lead]
        points = np.flatnonzero(count > 0)  # by drawing, then label
        pg = vg[points]

        act = np.flatnonzero(here[sg])
        la, lb, ag = label[sa[act]], label[sb[act]], sg[act]
        dead = act[la == lb]
        n_dead = np.bincount(sg[dead], minlength=total)
        dx, dy = x2[dead] - x1[dead], y2[dead] - y1[dead]
        fine = here & (above > margin)
        low = np.where(here & ~fine, 1, 0)
        tight = np.flatnonzero(low)
        whole = fine & (n_dead == 0)

        live = np.flatnonzero(whole[ag])
        ea, eb = np.minimum(la[live], lb[live]), np.maximum(la[live], lb[live])
        _, at = np.unique(ea * len(vx) + eb, return_index=True)
        at.sort()  # by drawing and first segment
        ea, eb, eg, es = ea[at], eb[at], ag[live][at], act[live][at]
        n_edges = np.bincount(eg, minlength=total)
        fits = whole & (k_cl * n_edges <= budget)

        near_e, near_v, near_t, near_d = _near(eg, ea, eb, fits, points, pg, rx, ry, above)
        off = near_d > 0
        n_band = np.bincount(eg[near_e[off]], minlength=total)
        clear = fits & (n_band == 0)
        on = ~off & clear[eg[near_e]]
        o_e, o_v, o_t = near_e[on], near_v[on], near_t[on]
        n_sub = np.bincount(eg[np.unique(o_e)], minlength=total)

        ce = np.flatnonzero(clear[eg])
        st_e, st_v = np.concatenate([ce, ce, o_e]), np.concatenate([ea[ce], eb[ce], o_v])
        st_t = np.concatenate([np.full(len(ce), -1.0), np.full(len(ce), 2.0), o_t])
        along = np.lexsort((st_v, st_t, st_e))
        st_e, st_v = st_e[along], st_v[along]
        hop = np.flatnonzero(st_e[1:] == st_e[:-1])
        fa, fb, fe = np.minimum(st_v[hop], st_v[hop + 1]), np.maximum(st_v[hop], st_v[hop + 1]), st_e[hop]
        parts = np.bincount(eg[fe], minlength=total)
        _, at = np.unique(fa * len(vx) + fb, return_index=True)  # in order of (drawing, a, b)
        fa, fb, fe = fa[at], fb[at], fe[at]
        fg = eg[fe]
        n_final = np.bincount(fg, minlength=total)
        within = clear & (n_final * n_final <= budget)
        cross_e, cross_f = _crossings(fg, fa, fb, within, rx, ry)
        n_cross = np.bincount(fg[cross_e], minlength=total)

        # Outcomes: the first reason in order.
        said = np.full(total, None, object)
        n_sites = np.zeros(total, np.int64)
        pairs = np.zeros(total, np.int64)
        for name, when, found in (
            ("EDGES_CROSS", within & (n_cross > 0), n_cross), ("TOO_MANY_PAIRS", clear & ~within, None), ("VERTEX_NEAR_EDGE", n_band > 0, n_band),
            ("TOO_MANY_PAIRS", whole & ~fits, None), ("EDGE_COLLAPSED", here & (n_dead > 0), n_dead), ("MARGIN_TOO_SMALL", here & ~fine, None),
        ):
            said[when] = name
            n_sites[when] = 1 if found is None else found[when]
        pairs = np.where(whole & ~fits, k_cl * n_edges, n_final * n_final)
        fall = here & np.isin(said.astype(str), ("EDGE_COLLAPSED", "MARGIN_TOO_SMALL"))
        take = here & (~fall | (k == 0))
        open_ &= ~here | fall
        chosen[take] = k
        reason[take] = said[take]
        more[take] = np.maximum(n_sites[take] - G.SITES, 0)
        mine = lambda name: take & (said == name)  # noqa: B023, E731

        r = mine("MARGIN_TOO_SMALL")[tight]
        sites.add(tight[r], k, xy=(above[tight[r]], margin[tight[r]]), failed=pa.array(["margin"] * int(r.sum()), pa.string()))
        r = mine("EDGE_COLLAPSED")[sg[dead]]
        sites.add(sg[dead][r], k, element=element.take(pa.array(si[dead[r]])), xy=(x1[dead[r]], y1[dead[r]]), length=np.sqrt(dx * dx + dy * dy)[r])
        r = np.flatnonzero(mine("TOO_MANY_PAIRS"))
        sites.add(r, k, element=pa.array(["pairs"] * len(r), pa.string()), count=pairs[r])
        r = np.flatnonzero(off & mine("VERTEX_NEAR_EDGE")[eg[near_e]])
        if len(r):
            r = r[np.lexsort((near_v[r], near_e[r], near_d[r], eg[near_e[r]]))]
            r = r[places(eg[near_e[r]]) < G.SITES]
            owner = np.full(len(vx), len(act))
            np.minimum.at(owner, la, np.arange(len(act)))
            np.minimum.at(owner, lb, np.arange(len(act)))
            sites.add(eg[near_e[r]], k, xy=(rx[near_v[r]], ry[near_v[r]]), element=element.take(pa.array(si[act[owner[near_v[r]]]])), edge=element.take(pa.array(si[es[near_e[r]]])), d=near_d[r])
        r = np.flatnonzero(mine("EDGES_CROSS")[fg[cross_e]])
        if len(r):
            r = r[np.lexsort((cross_f[r], cross_e[r]))]
            r = r[places(fg[cross_e[r]]) < G.SITES]
            p, q = cross_e[r], cross_f[r]
            ax, ay, cx, cy = rx[fa[p]], ry[fa[p]], rx[fa[q]], ry[fa[q]]
            ux, uy, wx, wy = rx[fb[p]] - ax, ry[fb[p]] - ay, rx[fb[q]] - cx, ry[fb[q]] - cy
            u = ((cx - ax) * wy - (cy - ay) * wx) / (ux * wy - uy * wx)
            sites.add(fg[p], k, element=element.take(pa.array(si[es[fe[p]]])), other=element.take(pa.array(si[es[fe[q]]])), xy=(ax + u * ux, ay + u * uy))

        sure = take & (said == None)  # noqa: E711
        if not sure.any():
            continue
        e_in, p_in = np.flatnonzero(sure[fg]), points[sure[pg]]
        top = roots_of(len(vx), np.stack([fa[e_in], fb[e_in]], axis=1))
        degree = np.bincount(np.concatenate([fa[e_in], fb[e_in]]), minlength=len(vx))
        of = lambda idx: np.bincount(vg[idx], minlength=total)
        v, e, pieces = of(p_in), n_final, of(p_in[top[p_in] == p_in])
        answers = {"v": v, "e": e, "pieces": pieces, "faces": e - v + pieces, "chi": v - e, "dangles": of(p_in[degree[p_in] == 1]), "n_subdivided": n_sub, "n_dup_edges": m - n_edges + parts - n_final, "n_merged": n - k_cl}
        for c, value in answers.items():
            longs[c][sure] = value[sure]
        width = np.zeros(total)
        grouped = many[sure[vg[many]]]
        if len(grouped):
            lab = label[grouped]
            start, times = np.flatnonzero(starts(lab)), count[lab[starts(lab)]]
            own, other = spread(np.repeat(start, times), np.repeat(times, times))
            p, q = grouped[own], grouped[other]
            ux, uy = vx[q] - vx[p], vy[q] - vy[p]
            np.maximum.at(width, vg[p], np.sqrt(ux * ux + uy * uy))
        scales = {"t_below": below, "t_above": above, "ratio": per(ratio[held][win]), "radius": scale if gridded else np.sqrt(below * above), "diam_max": width}
        for c, value in scales.items():
            doubles[c][sure] = value[sure]
        if version is not None:
            p_in = p_in[np.lexsort((ry[p_in], rx[p_in], vg[p_in]))]
            rank = np.empty(len(vx), np.int64)
            rank[p_in] = places(vg[p_in])
            ra, rb = rank[fa[e_in]], rank[fb[e_in]]
            ra, rb = np.minimum(ra, rb), np.maximum(ra, rb)
            es_in = np.lexsort((rb, ra, fg[e_in]))
            links, reps = np.stack([ra, rb], axis=1)[es_in], np.stack([rx[p_in], ry[p_in]], axis=1)
            p_end, e_end = np.cumsum(v * sure), np.cumsum(e * sure)
            for i in np.flatnonzero(sure & (e > 0)):
                digest[i] = sha1(reps[p_end[i] - v[i] : p_end[i]].tolist(), links[e_end[i] - e[i] : e_end[i]].tolist(), float(below[i]), float(above[i]), rho, (0, 0), version)

    # Drawings without a window: their widest gaps.
    lost = fit & (longs["n_candidates"] == 0)
    reason[lost] = "NO_STABLE_SCALE"
    r = np.flatnonzero(lost[gap_g])
    r = r[np.lexsort((lo[r], -ratio[r], gap_g[r]))]
    sites.add(gap_g[r], -1, 3, xy=(lo[r], hi[r]), ratio=ratio[r], failed=pa.array(np.where(ratio[r] < rho, "ratio below rho", "cluster above the largest").astype(object), pa.string()))
    without = np.bincount(gap_g, minlength=total) == 0
    certified = reason == None  # noqa: E711
    none = bad | (lost & without) | certified
    arrays = {"drawing_id": rows.column("drawing_id").take(pa.array(new)).combine_chunks(), "reason": pa.array(reason, pa.string())}
    arrays |= {c: pa.array(longs[c], pa.int64(), mask=~certified) for c in LONGS} | {c: pa.array(doubles[c], pa.float64(), mask=~certified) for c in DOUBLES}
    arrays |= {"look_at": sites.column(total, chosen, none), "n_more": pa.array(more, pa.int64())}
    if version is not None:
        arrays["digest"] = pa.array(digest, pa.string())
    return pa.RecordBatch.from_pydict(arrays)


def _scattered(size: int, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = np.zeros(size, value.dtype)
    out[at] = value
    return out


def _near(eg, ea, eb, fits, points, pg, rx, ry, above) -> tuple[np.ndarray, ...]:
    """(edge, vertex, t, d): vertices nearer to an edge they aren't on than the window's upper end."""
    by_x = np.lexsort((rx[points], pg))
    points, pg = points[by_x], pg[by_x]
    e = np.flatnonzero(fits[eg])
    ax, ay, bx, by, w = rx[ea[e]], ry[ea[e]], rx[eb[e]], ry[eb[e]], above[eg[e]]
    start = _before(pg, rx[points], eg[e], np.minimum(ax, bx) - w, False)
    times = np.maximum(_before(pg, rx[points], eg[e], np.maximum(ax, bx) + w, True) - start, 0)
    y0, y1 = np.minimum(ay, by) - w, np.maximum(ay, by) + w
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))]
    for part in chunks(times):
        own, at = spread(start[part], times[part])
        own += part.start
        v = points[at]
        y = ry[v]
        held = (y >= y0[own]) & (y <= y1[own]) & (v != ea[e[own]]) & (v != eb[e[own]])
        own, v = own[held], v[held]
        t, d = _vertex_edge(rx[v], ry[v], ax[own], ay[own], bx[own], by[own])
        held = d < w[own]
        found.append((e[own[held]], v[held], t[held], d[held]))
    return tuple(np.concatenate(p) for p in zip(*found, strict=True))


def _crossings(fg, fa, fb, within, rx, ry) -> tuple[np.ndarray, np.ndarray]:
    """(e, f), e < f: edges that cross at a point no vertex occupies."""
    e = np.flatnonzero(within[fg])
    left, right = np.minimum(rx[fa[e]], rx[fb[e]]), np.maximum(rx[fa[e]], rx[fb[e]])
    by_x = np.lexsort((left, fg[e]))
    e, left, right = e[by_x], left[by_x], right[by_x]
    start = np.arange(len(e)) + 1
    times = np.maximum(_before(fg[e], left, fg[e], right, True) - start, 0)
    low, high = np.minimum(ry[fa[e]], ry[fb[e]]), np.maximum(ry[fa[e]], ry[fb[e]])
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for part in chunks(times):
        own, at = spread(start[part], times[part])
        own += part.start
        held = (low[own] <= high[at]) & (low[at] <= high[own])
        p, q = np.minimum(e[own[held]], e[at[held]]), np.maximum(e[own[held]], e[at[held]])
        a, b, c, d = fa[p], fb[p], fa[q], fb[q]
        held = (a != c) & (a != d) & (b != c) & (b != d)
        p, q, a, b, c, d = (z[held] for z in (p, q, a, b, c, d))
        side = lambda i, j, k: (rx[j] - rx[i]) * (ry[k] - ry[i]) - (ry[j] - ry[i]) * (rx[k] - rx[i]) > 0
        held = (side(a, b, c) != side(a, b, d)) & (side(c, d, a) != side(c, d, b))
        found.append((p[held], q[held]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def whole_drawings(batches: Iterator[pa.RecordBatch], place: str, cap: int, large: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts) of runs of whole drawings; place counts the rows of a drawing from 1. Of a drawing with more rows than
    `large` only the first comes, alone and with no start."""

    def runs(rows: pa.Table, new: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
        m = np.diff(np.append(new, rows.num_rows))
        cost, i = np.cumsum(np.where(m > large, RUN + 1, m * np.minimum(2 * m, cap))), 0
        while i < len(new):
            j = max(i + 1, int(np.searchsorted(cost, (cost[i - 1] if i else 0) + RUN, "right")))
            end = new[j] if j < len(new) else rows.num_rows
            if m[i] > large:
                yield rows.slice(new[i], 1), np.empty(0, np.int64)
            else:
                yield rows.slice(new[i], end - new[i]), new[i:j] - new[i]
            i = j

    held: list[pa.RecordBatch] = []
    size, skipping = 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.flatnonzero(batch.column(place).to_numpy() == 1)
        if skipping:
            if not len(new):
                continue
            batch = batch.slice(new[0])
            new, skipping = new - new[0], False
        if len(new):
            done = pa.Table.from_batches([*held, batch.slice(0, new[-1])])
            if done.num_rows:
                begun = np.flatnonzero(done.column(place).to_numpy() == 1)
                yield from runs(done, begun)
            held, size = [batch.slice(new[-1])], batch.num_rows - int(new[-1])
        else:
            held.append(batch)
            size += batch.num_rows
        if size > large:
            yield pa.Table.from_batches([held[0].slice(0, 1)]), np.empty(0, np.int64)
            held, size, skipping = [], 0, True
    if held:
        yield from runs(pa.Table.from_batches(held), np.zeros(1, np.int64))


def collapsed_edges(segments: DataFrame, radius: float) -> DataFrame:
    """(drawing_id, seg_ix, element, length) of the edges whose ends single linkage at the radius joins, by their first segments.

    A task holds whole drawings; a segment of no drawing or with a coordinate that is no finite number is no edge.
    """

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, new in whole_groups(batches):
            g = np.repeat(np.arange(len(new)), np.diff(np.append(new, rows.num_rows)))
            vg, x, y, sa, sb = _vertices(g, [rows.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")])
            _, a, b, w = trees_of(np.bincount(vg, minlength=len(new)), x, y)
            root = roots_of(len(x), np.stack([a, b], axis=1)[w <= radius])
            a, b = np.minimum(sa, sb), np.maximum(sa, sb)
            at = np.unique(a * len(x) + b, return_index=True)[1]
            at = np.sort(at[root[a[at]] == root[b[at]]])
            dx, dy = x[b[at]] - x[a[at]], y[b[at]] - y[a[at]]
            out = rows.select([D, "seg_ix", "element"]).take(pa.array(at)).append_column("length", pa.array(np.sqrt(dx * dx + dy * dy)))
            yield from out.to_batches()

    kinds = dict(segments.dtypes)
    own = segments.where(F.col(D).isNotNull() & finite(segments)).select(D, "seg_ix", "element", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return numbered(own, [D], ["seg_ix"]).mapInArrow(collapsed, f"{D} {kinds[D]}, seg_ix {kinds['seg_ix']}, element {kinds['element']}, length double")


def plain_faces(segments: DataFrame) -> DataFrame:
    """(drawing_id, faces) of drawings as they are: no end moves, no edge is parted. Like joins have it, NaN meets NaN, and a
    segment with a null coordinate is no edge, though its ends are vertices."""

    def code(column: pa.ChunkedArray) -> np.ndarray:
        v = column.to_numpy().astype(float) + 0.0
        v[np.isnan(v)] = np.nan
        return np.where(column.is_null().to_numpy(), NULL, v.view(np.int64))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, new in whole_groups(batches):
            g = np.repeat(np.arange(len(new)), np.diff(np.append(new, rows.num_rows)))
            ends = [code(rows.column(c)) for c in ("x1", "y1", "x2", "y2")]
            vg, x, _, sa, sb = _vertices(g, ends)
            held = (sa != sb) & np.logical_and.reduce([c != NULL for c in ends])
            links = np.unique(np.minimum(sa, sb)[held] * len(x) + np.maximum(sa, sb)[held])
            a, b = links // len(x), links % len(x)
            root = roots_of(len(x), np.stack([a, b], axis=1))
            of = lambda at: np.bincount(vg[at], minlength=len(new))  # noqa: B023, E731
            faces = of(a) - np.bincount(vg, minlength=len(new)) + of(np.flatnonzero(root == np.arange(len(x))))
            yield pa.RecordBatch.from_arrays([rows.column(D).take(pa.array(new)).combine_chunks(), pa.array(faces, pa.int64())], [D, "faces"])

    own = segments.select(D, "seg_ix", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return numbered(own, [D], ["seg_ix"]).mapInArrow(counted, f"{D} {dict(segments.dtypes)[D]}, faces long")
