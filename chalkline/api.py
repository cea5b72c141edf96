"""What a caller needs: verdicts of documents, verdicts of segments, and claims about either."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.plans import verdicts as V
from chalkline.plans.scratch import stored
from chalkline.sources import svg

segments_of = svg.parsed
judge_segments = V.verdicts
check = V.checked
DEMO = '<svg xmlns="http://www.w3.org/2000/svg">' + "".join(f'<line x1="{x}" y1="{y}" x2="{x + dx}" y2="{y + dy}"/>' for dx, dy in ((10, 0), (0, 10)) for x in range(0, 30 - dx, 10) for y in range(0, 30 - dy, 10)) + "</svg>"


def judge(documents: DataFrame, *, flatten: int = svg.FLATTEN, grid: float | None = None, rho: float = V.G.RHO, max_vertices: int | None = None) -> DataFrame:
    """The verdict of every document(drawing_id, svg); drawings with curves are judged at flatten and at twice that."""
    passes = None
    for k in (1, 2):
        rows = stored(svg.parsed(documents if k == 1 else curved, k * flatten), "parsed")
        found = V.verdicts(svg.segments(rows), rows.select("drawing_id", "skipped", "error"), grid=grid, rho=rho, max_vertices=max_vertices).withColumn("pass", F.lit(k))
        passes = found if passes is None else passes.unionByName(found)
        curved = documents.join(rows.where("n_curves > 0").select("drawing_id"), "drawing_id", "left_semi")
        if k == 1 and curved.limit(1).count() == 0:
            break
    return V.settled(stored(passes, "passes"))


def judge_texts(spark: SparkSession, texts: dict[str, str], **options) -> DataFrame:
    return judge(spark.createDataFrame(list(texts.items()), "drawing_id string, svg string"), **options)
