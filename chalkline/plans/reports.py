"""Verdicts as JSON and as text, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.geometry import number
from chalkline.plans.verdicts import EXIT, SITE

RULE, THIN = "=" * 78, "-" * 78
CONVENTION = "faces are bounded regions; chi = pieces - faces = V - E"
FIELDS = "status string, reason string, kind string, v bigint, e bigint, pieces bigint, faces bigint, chi bigint, dangles bigint, t_below double, t_above double, ratio double, radius double, n_subdivided bigint, n_dup_edges bigint, n_merged bigint, diam_max double, n_candidates bigint, rho double, grid_source string, n_more bigint, look_at array<" + SITE + ">"


def to_json(found: DataFrame, key: str = "drawing_id") -> DataFrame:
    """(key, json): one document for each verdict; null fields are left out."""
    names = [f.strip().split(" ")[0] for f in FIELDS.split(", ")]
    return found.select(key, F.to_json(F.struct(*[F.col(n) for n in names if n in found.columns], F.lit(CONVENTION).alias("convention"))).alias("json"))


def from_json(rows: DataFrame, key: str = "drawing_id") -> DataFrame:
    """The verdicts of rows(key, json). Unknown fields are ignored; integers that contradict each other raise an error."""
    out = rows.select(key, F.from_json("json", FIELDS).alias("x")).select(key, "x.*")
    sound = F.col("faces").isNull() | ((F.col("faces") == F.col("e") - F.col("v") + F.col("pieces")) & (F.col("chi") == F.col("pieces") - F.col("faces")))
    return out.where(F.assert_true(sound, F.lit("faces, pieces, v, e and chi contradict each other")).isNull())


def exit_code(status: Column, refuse_ok: bool = False) -> Column:
    code = F.create_map(*[F.lit(x) for kv in EXIT.items() for x in kv])[status]
    return F.when(status == "REFUSED", F.lit(0)).otherwise(code) if refuse_ok else code


def _site(site: dict) -> str:
    parts = [f"({number(site['xy'][0])}, {number(site['xy'][1])})"] if site.get("xy") else []
    for k in ("element", "edge", "other", "d", "length", "ratio", "failed", "count"):
        if site.get(k) is not None:
            parts.append(f"{k}={number(site[k]) if isinstance(site[k], float) else site[k]}")
    return "  ".join(parts)


def block(r: dict, name: str = "(segments)") -> str:
    """A verdict, as a mapping, for people to read."""
    if r["status"] != "CERTIFIED":
        lines = [RULE, f"  {name[:52]:<62} {r['status']}", RULE, f"  reason   {r['reason']}   ({r['kind']})"]
        lines += [f"  {'look at ' if i == 0 else '        '} {_site(s if isinstance(s, dict) else s.asDict())}" for i, s in enumerate(r.get("look_at") or [])]
        return "\n".join([*lines, *([f"           ... {r['n_more']} more"] if r.get("n_more") else []), RULE])
    return "\n".join([
        RULE, f"  {name}", RULE,
        f"  pieces  {r['pieces']:14d}", f"  faces   {r['faces']:14d}", f"  chi     {r['chi']:14d}      chi = pieces - faces = V - E",
        *([f"  dangles {r['dangles']:14d}      vertices of degree 1"] if r["dangles"] else []), THIN,
        f"  vertices {r['v']:13d}      edges {r['e']:12d}", f"  subdivided {r['n_subdivided']:11d}      dup edges {r['n_dup_edges']:8d}",
        f"  merged {r['n_merged']:15d}      widest cluster {number(r['diam_max'])}",
        f"  window   [{number(r['t_below'])}, {number(r['t_above'])})   ratio {number(r['ratio'])}   radius {number(r['radius'])}   {r['grid_source']}",
        f"  rho {number(r['rho'])}   candidates tried {r['n_candidates']}", RULE,
    ])
