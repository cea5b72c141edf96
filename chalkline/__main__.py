"""python -m chalkline FILE... | check FILE --faces N | --demo"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chalkline import api
from chalkline.plans import reports
from chalkline.plans.verdicts import EXIT
from chalkline.sources import svg


def main(argv: list[str]) -> int:
    claiming = argv[:1] == ["check"]
    p = argparse.ArgumentParser(prog="chalkline", description=reports.CONVENTION)
    p.add_argument("files", nargs="*")
    for name, kind in (("--grid", float), ("--rho", float), ("--max-vertices", int), ("--flatten", int)):
        p.add_argument(name, type=kind)
    p.add_argument("--json", action="store_true")
    p.add_argument("--demo", action="store_true")
    p.add_argument("--refuse-ok", action="store_true")
    for name in ("--faces", "--pieces", "--chi"):
        p.add_argument(name, type=int)
    a = p.parse_args(argv[claiming:])
    options = {k: v for k, v in (("grid", a.grid), ("rho", a.rho), ("max_vertices", a.max_vertices), ("flatten", a.flatten)) if v is not None}
    spark = SparkSession.builder.appName("chalkline").getOrCreate()
    if a.demo:
        docs = spark.createDataFrame([("demo", api.DEMO)], "drawing_id string, svg string")
    elif a.files == ["-"]:
        docs = spark.createDataFrame([("-", sys.stdin.read())], "drawing_id string, svg string")
    else:
        docs = None
        for file in a.files:
            docs = svg.read(spark, file) if docs is None else docs.union(svg.read(spark, file))
        if docs is None:
            p.error("no file is given")
    found = api.judge(docs, **options)
    if claiming:
        said = found.select("drawing_id", *[F.lit(getattr(a, n)).cast("long").alias(n) for n in ("faces", "pieces", "chi")])
        rows = api.check(said, found).toLocalIterator()
        codes = []
        for r in rows:
            print(f"{r.verdict}  {r.drawing_id}")
            codes.append(r.exit_code)
        return max(codes, default=3)
    codes = []
    for r in (reports.to_json(found).join(found.select("drawing_id", "status"), "drawing_id") if a.json else found).toLocalIterator():
        print(r.json if a.json else reports.block(r.asDict(recursive=True), r.drawing_id))
        codes.append(0 if a.refuse_ok and r.status == "REFUSED" else EXIT[r.status])
    return max(codes, default=3)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
