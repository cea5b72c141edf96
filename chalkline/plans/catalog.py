"""The registered queries of the geometry engine and the SQL that each must agree with.

Drawings are made from the driver's tables by SQL that Spark and DuckDB both read: a lattice of unit walls for each supplier,
the same with longer walls, chords between lattice points for each customer, and the values of each user as points on a line.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chalkline.functions import geometry as G
from chalkline.operators import evaluate as E
from chalkline.operators import graph
from chalkline.operators import judge as J
from chalkline.operators import planar as P
from chalkline.plans import reports
from chalkline.plans import verdicts as V
from chalkline.plans.scratch import shared_dir, stored
from chalkline.sources import figures, svg
from chalkline.streaming import stamps

D = P.D
FLAGSHIP = "verdicts"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def _walls(long: bool) -> str:
    run = "1 + l_linenumber % 3" if long else "1"
    return f"""
        SELECT l_suppkey AS drawing_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS INT) AS seg_ix,
            CAST(l_partkey % 12 AS DOUBLE) AS x1, CAST(l_linenumber + l_orderkey % 6 AS DOUBLE) AS y1,
            CAST(l_partkey % 12 + CASE WHEN l_quantity % 2 = 0 THEN {run} ELSE 0 END AS DOUBLE) AS x2,
            CAST(l_linenumber + l_orderkey % 6 + CASE WHEN l_quantity % 2 = 0 THEN 0 ELSE {run} END AS DOUBLE) AS y2,
            concat('line#', row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) AS element
        FROM lineitem"""


LATTICE, LONG = _walls(False), _walls(True)
CHORDS = """
        SELECT o_custkey AS drawing_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS seg_ix,
            CAST(o_orderkey % 97 AS DOUBLE) AS x1, CAST(floor(o_totalprice) % 89 AS DOUBLE) AS y1,
            CAST(o_orderkey * 7 % 83 AS DOUBLE) AS x2, CAST(floor(o_totalprice) * 3 % 101 AS DOUBLE) AS y2,
            concat('line#', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS element
        FROM orders"""
POINTS = """
        SELECT user_id AS drawing_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first_id) - 1 AS INT) AS v, x, CAST(0 AS DOUBLE) AS y
        FROM (SELECT user_id, value AS x, min(event_id) AS first_id FROM events WHERE value IS NOT NULL GROUP BY user_id, value) p"""
POLYLINES = """
        SELECT user_id AS drawing_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS seg_ix, x1, y1, x2, y2,
            concat('line#', row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS element
        FROM (SELECT user_id, event_id, CAST(event_id % 37 AS DOUBLE) AS x1, value AS y1, CAST(lead(event_id) OVER o % 37 AS DOUBLE) AS x2, lead(value) OVER o AS y2 FROM events WHERE value IS NOT NULL WINDOW o AS (PARTITION BY user_id ORDER BY event_id)) e
        WHERE x2 IS NOT NULL"""
_NUDGE = "CASE WHEN o_orderkey % 3 = 0 THEN 0.0000001 * (o_custkey % 5) ELSE 0 END"
_FAR = "CASE WHEN floor(o_orderkey / 4) % 13 = 5 THEN 1000000000000000 ELSE 0 END"
_SHORT = "CASE WHEN o_orderkey % 17 = 2 THEN 0.00001 ELSE 1 END"
#: Four short segments to a drawing: some cross, some nearly touch, some ends nearly meet, some lie too far out, some are no numbers.
HEAPS = f"""
        SELECT CAST(floor(o_orderkey / 4) AS BIGINT) AS drawing_id, CAST(o_orderkey % 4 AS INT) AS seg_ix,
            CASE WHEN o_orderkey % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(o_orderkey * 7 % 5 + {_FAR} AS DOUBLE) END AS x1, CAST(floor(o_totalprice) % 4 + {_NUDGE} AS DOUBLE) AS y1,
            CAST(o_orderkey * 7 % 5 + (1 + o_custkey % 3) * {_SHORT} + {_FAR} AS DOUBLE) AS x2, CAST(floor(o_totalprice) % 4 + floor(o_totalprice / 7) % 3 * {_SHORT} + CASE WHEN o_orderkey % 5 = 1 THEN 0.00002 ELSE 0 END AS DOUBLE) AS y2,
            concat('line#', o_orderkey % 4) AS element
        FROM orders"""
#: Twenty-four segments between three to six points, two times three in a row.
WEBS = """
        SELECT drawing_id, seg_ix, CAST(a % 3 AS DOUBLE) AS x1, floor(a / 3) AS y1, CAST(b % 3 AS DOUBLE) AS x2, floor(b / 3) AS y2, concat('line#', seg_ix) AS element
        FROM (SELECT drawing_id, seg_ix, a, (a + 1 + step % (k - 1)) % k AS b FROM (
            SELECT drawing_id, seg_ix, step, k, (o_custkey + seg_ix) % k AS a FROM (
                SELECT CAST(floor(o_orderkey / 24) AS BIGINT) AS drawing_id, CAST(o_orderkey % 24 AS INT) AS seg_ix, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS step, CAST(3 + floor(o_orderkey / 24) % 4 AS BIGINT) AS k FROM orders) p) q) r"""
GRID, FEW = 0.001, 6
PLANE = "SELECT label AS drawing_id, CAST(vec_id AS INT) AS v, CAST(element_at(embedding, 1) AS DOUBLE) AS x, CAST(element_at(embedding, 2) AS DOUBLE) AS y FROM embeddings"
PLANE_SQL = PLANE.replace("element_at", "list_extract")  # DuckDB's name for it
RHO, RADIUS, NEAR, CLOSE, SHORT = G.RHO, 0.5, 1.5, 0.02, 20.0


def _view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    for t in TABLES:
        if t in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


def _graph(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    vs = P.vertices(segments)
    return vs, P.distinct_edges(P.edges(segments, vs))


def exact_vertices(spark, sf_dir):
    return P.vertices(_view(spark, sf_dir, LATTICE))


def distinct_edges(spark, sf_dir):
    return _graph(_view(spark, sf_dir, LATTICE))[1]


def euler_counts(spark, sf_dir):
    return P.euler(*_graph(_view(spark, sf_dir, LATTICE)))


def vertex_edge_spectrum(spark, sf_dir):
    vs, es = _graph(_view(spark, sf_dir, CHORDS))
    return P.vertex_edge(P.with_ends(es, vs), vs).select(D, F.round("d", 9).alias("s")).distinct()


def near_incidences(spark, sf_dir):
    vs, es = _graph(_view(spark, sf_dir, CHORDS))
    near = P.vertex_edge(P.with_ends(es, vs), vs, within=F.lit(NEAR))
    first = Window.partitionBy(D).orderBy("d", "seg_ix", "v")
    return near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= G.SITES).select(D, "place", "seg_ix", "v", F.round("t", 9).alias("t"), F.round("d", 9).alias("d"))


def crossings(spark, sf_dir):
    vs, es = _graph(_view(spark, sf_dir, CHORDS))
    met = P.crossings(P.with_ends(es.withColumn("e", F.col("seg_ix")), vs))
    return met.select(D, "e", "e2", "element", "other", F.round(F.col("xy")[0], 6).alias("x"), F.round(F.col("xy")[1], 6).alias("y"))


def subdivided_edges(spark, sf_dir):
    vs, es = _graph(_view(spark, sf_dir, LONG))
    es = es.withColumn("e", F.col("seg_ix"))
    # Written before it is filtered: else the distance, spelled out, becomes part of the join's condition.
    on = stored(P.vertex_edge(P.with_ends(es, vs), vs, within=F.lit(1e-9)), "near").where("d = 0")
    return P.subdivided(es, on).select(D, "a", "b", "element", "parts")


def merge_heights(spark, sf_dir):
    return P.minimum_trees(_view(spark, sf_dir, POINTS)).select(D, F.round("w", 9).alias("w"))


def _linked(spark, sf_dir):
    vs = _view(spark, sf_dir, POINTS)
    asked = vs.select(D).distinct().withColumns({"lo": F.lit(RADIUS), "hi": F.lit(1.0)})
    return vs, P.clustered(P.minimum_trees(vs), asked, vs.groupBy(D).agg(F.count("*").alias("n")))


def single_linkage(spark, sf_dir):
    return _linked(spark, sf_dir)[1].select(D, "v", "label")


def cluster_stats(spark, sf_dir):
    vs, found = _linked(spark, sf_dir)
    p = found.join(vs, [D, "v"])
    return p.groupBy(D, "label").agg(F.count("*").alias("size"), F.min(F.struct("x", "y")).alias("rep"), F.round(F.max("x") - F.min("x"), 9).alias("diameter")).select(D, "label", "size", F.col("rep.x").alias("rep_x"), F.col("rep.y").alias("rep_y"), "diameter", (F.col("size") <= G.CLUSTER_MAX).alias("fits"))


def _line_gaps(spark, sf_dir):
    vs = _view(spark, sf_dir, POINTS)
    floor = vs.groupBy(D).agg(G.ulps(G.FLOOR_ULPS, F.max(F.abs("x"))).alias("floor"))
    heights = P.minimum_trees(vs).select(D, F.round("w", 9).alias("s"))
    return V.gaps(heights.join(floor, D).where("s > floor").select(D, "s").union(floor).distinct())


def scale_gaps(spark, sf_dir):
    order = Window.partitionBy(D).orderBy((F.col("nth") == 0).cast("int"), F.desc("ratio"), "lo")
    wide = _line_gaps(spark, sf_dir).where(F.col("ratio") >= RHO)
    return wide.withColumn("cand", F.row_number().over(order) - 1).where(F.col("cand") < G.CAND_MAX).select(D, "cand", F.round("hi", 9).alias("hi"), "nth")


def containing_window(spark, sf_dir):
    return _line_gaps(spark, sf_dir).where((F.col("lo") <= RADIUS) & (F.col("hi") > RADIUS)).select(D, F.round("hi", 9).alias("hi"), "nth", (F.col("ratio") >= RHO).alias("wide"))


def verdicts(spark, sf_dir):
    return V.verdicts(_view(spark, sf_dir, LATTICE)).select(D, "status", "v", "e", "pieces", "faces", "chi", "dangles")


def verdict_json(spark, sf_dir):
    back = reports.from_json(reports.to_json(V.verdicts(_view(spark, sf_dir, LATTICE))))
    return back.select(D, "status", "v", "e", "pieces", "faces", "chi", reports.exit_code(F.col("status")).alias("exit_code"))


def scale_sensitivity(spark, sf_dir):
    """How many gaps of each drawing's spectrum are windows at three ratios."""
    ratios = spark.createDataFrame([(3.0,), (10.0,), (100.0,)], "rho double")
    return _line_gaps(spark, sf_dir).join(F.broadcast(ratios), F.col("ratio") >= F.col("rho")).groupBy("rho").agg(F.count("*").alias("windows"), F.count_distinct(D).alias("drawings"))


def truth_by_name(spark, sf_dir):
    """Drawings with the truth that is known of some: what has none keeps nulls, and what has no drawing drops out."""
    found = P.euler(*_graph(_view(spark, sf_dir, LATTICE))).select(D, "pieces")
    known = _view(spark, sf_dir, "SELECT s_suppkey AS drawing_id, CAST(1 AS BIGINT) AS truth FROM supplier WHERE s_suppkey % 2 = 0")
    return found.join(known, D, "left").withColumn("agrees", F.col("pieces") == F.col("truth"))


def contested_verdicts(spark, sf_dir):
    """Chords cross nearly everywhere: what is refused, and why. SQL can't say it; the tests hold it against brute force."""
    return V.verdicts(_view(spark, sf_dir, CHORDS)).select(D, "status", "reason", "kind", "pieces", "faces", "n_more", F.size("look_at").alias("n_sites"))


TOLD = ["status", "reason", "kind", "v", "e", "pieces", "faces", "chi", "dangles", "n_subdivided", "n_dup_edges", "n_merged", "n_candidates", "n_more"]


def _told(found: DataFrame) -> DataFrame:
    return found.select(D, *TOLD, F.round("t_above", 9).alias("t_above"))


def heap_verdicts(spark, sf_dir):
    """What is certified, what is refused and why, for heaps of segments that touch in every way."""
    return _told(V.verdicts(_view(spark, sf_dir, HEAPS)))


def grid_verdicts(spark, sf_dir):
    """The same at a scale that the caller names."""
    return _told(V.verdicts(_view(spark, sf_dir, HEAPS), grid=GRID))


def budget_verdicts(spark, sf_dir):
    """Webs of segments under a ceiling of a few vertices."""
    return _told(V.verdicts(_view(spark, sf_dir, WEBS), max_vertices=FEW))


def refusals_by_reason(spark, sf_dir):
    """The refusals of heaps and their reasons, with subtotals."""
    return E.histogram(V.verdicts(_view(spark, sf_dir, HEAPS)).where("status <> 'CERTIFIED'").select("kind", "reason"), ["kind", "reason"])


def claims_on_heaps(spark, sf_dir):
    """One claim for each heap, against whatever its verdict is."""
    rows = _view(spark, sf_dir, HEAPS)
    claims = rows.select(D).distinct().select(D, F.lit(0).cast("bigint").alias("faces"), F.when(F.col(D) % 2 == 0, 1).cast("bigint").alias("pieces"), F.lit(None).cast("bigint").alias("chi"))
    return V.checked(claims, V.verdicts(rows)).select(D, "verdict", "exit_code")


SWEEP = (3.0, 10.0, 100.0)


def rho_sensitivity(spark, sf_dir):
    """Verdicts of heaps at three ratios against the faces of the drawings as they are."""
    rows = _view(spark, sf_dir, HEAPS)
    return V.by_ratio(rows, J.plain_faces(rows).withColumnRenamed("faces", "truth"), SWEEP)


def method_agreement(spark, sf_dir):
    """The faces of every third certified heap, against those of rounded coordinates and of coordinates as they are."""
    rows = _view(spark, sf_dir, HEAPS)
    return E.agreement(V.verdicts(rows), {"rounded": E.rounded_faces(rows), "plain": J.plain_faces(rows)}, 3)


def rebuilt_verdicts(spark, sf_dir):
    rows = _view(spark, sf_dir, HEAPS)
    return V.rebuilt(rows, V.verdicts(rows))


def jitter_stratum(spark, sf_dir):
    """Every family with known counts, jittered: how many draws each ratio has, and how many wrong answers."""
    segments = figures.table(spark, {k: s for k, (s, _) in figures.families().items()})
    draws = stored(figures.stratum(spark, P.smallest_gap(*_graph(segments))), "draws")
    truth = draws.select(D, "family", "ratio").distinct().join(F.broadcast(figures.truths(spark)), "family").select(D, "ratio", F.col("faces").alias("truth"))
    found = V.by_ratio(draws.select(*segments.columns), truth, (RHO,), ["ratio"])
    return found.select("ratio", (F.col("wrong") + F.col("exact") + F.col("refused")).alias("draws"), "wrong")


def arrangement_digests(spark, sf_dir):
    return V.verdicts(_view(spark, sf_dir, LATTICE), digests=True).select(D, "digest")


def first_wrong(spark, sf_dir):
    rows = _view(spark, sf_dir, "SELECT l_returnflag AS arm, l_orderkey, l_linenumber, CASE WHEN l_quantity < 40 THEN l_linenumber END AS answer, l_partkey % 7 + 1 AS truth FROM lineitem")
    return E.first_wrong(rows, ["arm"], ["l_orderkey", "l_linenumber"])


def hook_lines(spark, sf_dir):
    return stamps.hook_lines(stamps.stamped(_view(spark, sf_dir, EVENTS)))


def copy_counts(spark, sf_dir):
    return P.euler(*_graph(figures.edited(_view(spark, sf_dir, LATTICE), "copy")))


def crossings_by_function(spark, sf_dir):
    """Proper crossings by the SQL function of that name."""
    G.register(spark)
    _view(spark, sf_dir, f"SELECT * FROM ({CHORDS}) c").createOrReplaceTempView("chords")
    pairs = "p.x1, p.y1, p.x2, p.y2, q.x1, q.y1, q.x2, q.y2"
    return spark.sql(f"SELECT p.drawing_id, p.seg_ix, q.seg_ix AS other FROM chords p JOIN chords q ON p.drawing_id = q.drawing_id AND p.seg_ix < q.seg_ix WHERE proper_cross({pairs})")


CLAIMS = "SELECT s_suppkey AS drawing_id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS faces, CAST(1 AS BIGINT) AS pieces, CAST(NULL AS BIGINT) AS chi FROM supplier"


def checked_claims(spark, sf_dir):
    return V.checked(_view(spark, sf_dir, CLAIMS), verdicts(spark, sf_dir)).select(D, "verdict", "exit_code", "faces", "pieces")


def refusal_histogram(spark, sf_dir):
    rows = _view(spark, sf_dir, "SELECT CASE WHEN user_id % 3 = 0 THEN 'budget' ELSE 'geometry' END AS kind, event_type AS reason FROM events")
    return E.histogram(rows, ["kind", "reason"])


def latency_quantiles(spark, sf_dir):
    return E.quantiles(_view(spark, sf_dir, "SELECT event_type, value FROM events"), ["event_type"], "value")


def growth_fit(spark, sf_dir):
    rows = _view(spark, sf_dir, "SELECT o_orderpriority, CAST(o_custkey AS DOUBLE) AS size, o_totalprice AS cost FROM orders")
    found = E.growth(rows, ["o_orderpriority"], F.col("size"), F.col("cost"), 100000.0)
    return found.select("o_orderpriority", F.round("exponent", 6).alias("exponent"), F.round("estimate", 3).alias("estimate"))


def arm_tally(spark, sf_dir):
    rows = _view(spark, sf_dir, "SELECT l_returnflag AS arm, l_linestatus AS level, CASE WHEN l_quantity < 40 THEN l_linenumber END AS answer, l_partkey % 7 + 1 AS truth FROM lineitem")
    return E.tally(rows, ["arm", "level"])


def strided_sample(spark, sf_dir):
    return E.every(_view(spark, sf_dir, "SELECT c_custkey, c_name FROM customer"), 7, ["c_name", "c_custkey"])


NOISY = f"SELECT drawing_id, seg_ix, x1 + seg_ix * 1e-10 AS x1, y1, x2 - seg_ix * 1e-10 AS x2, y2, element FROM ({LATTICE}) s"


def rounded_faces(spark, sf_dir):
    return E.rounded_faces(_view(spark, sf_dir, NOISY))


def raster_holes(spark, sf_dir):
    return E.raster_holes(_view(spark, sf_dir, LATTICE), 512)


def walked_faces(spark, sf_dir):
    found = P.bounded_faces(*_graph(_view(spark, sf_dir, LATTICE)))
    return found.groupBy(D).agg(F.count("*").alias("faces"))


def smallest_gap(spark, sf_dir):
    return P.smallest_gap(*_graph(_view(spark, sf_dir, CHORDS))).select(D, F.round("gap", 9).alias("gap"))


def degree_histogram(spark, sf_dir):
    vs, es = _graph(_view(spark, sf_dir, LATTICE))
    return es.where("a <> b").select(D, F.explode(F.array("a", "b")).alias("v")).groupBy(D, "v").count().groupBy(F.col("count").alias("degree")).agg(F.count("*").alias("vertices"))


def collapsed_edges(spark, sf_dir):
    """Edges whose ends a grid of SHORT merges: no longer than that, or joined through others, however long."""
    return J.collapsed_edges(_view(spark, sf_dir, CHORDS), SHORT).withColumn("length", F.round("length", 9))


def plane_linkage(spark, sf_dir):
    """Single linkage of points in the plane: the members of a cluster by its smallest vector."""
    points = _view(spark, sf_dir, PLANE)
    numbered = points.withColumn("i", (F.row_number().over(Window.partitionBy(D).orderBy("v")) - 1).cast("int"))
    vs = numbered.select(D, F.col("i").alias("v"), "x", "y")
    asked = vs.select(D).distinct().withColumns({"lo": F.lit(CLOSE), "hi": F.lit(1.0)})
    found = P.clustered(P.minimum_trees(vs), asked, vs.groupBy(D).agg(F.count("*").alias("n")))
    named = found.join(numbered.select(D, F.col("v").alias("vec_id"), F.col("i").alias("v")), [D, "v"])
    return named.withColumn("root", F.min("vec_id").over(Window.partitionBy(D, "label"))).select(D, "vec_id", "root")


def nearest_pairs(spark, sf_dir):
    """The three closest pairs of points of each drawing."""
    return P.nearest_pairs(_view(spark, sf_dir, PLANE), 3).select(D, "place", "v", "w", "d")


def polyline_crossings(spark, sf_dir):
    vs, es = _graph(_view(spark, sf_dir, POLYLINES))
    met = P.crossings(P.with_ends(es.withColumn("e", F.col("seg_ix")), vs))
    return met.groupBy(D).agg(F.count("*").alias("crossings"))


PARTS = "SELECT DISTINCT 2 * l_partkey AS a, 2 * l_suppkey + 1 AS b FROM lineitem"


def part_supplier_euler(spark, sf_dir):
    """One graph that no drawing bounds: parts and the suppliers they came from."""
    edges = _view(spark, sf_dir, PARTS)
    return graph.euler_of(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct(), edges)


def union_counts(spark, sf_dir):
    lattice = _view(spark, sf_dir, LATTICE)
    return P.euler(*_graph(figures.shifted_union(lattice, lattice))).drop("dangles")


def loop_counts(spark, sf_dir):
    return P.euler(*_graph(figures.edited(_view(spark, sf_dir, LATTICE), "loop"))).drop("dangles")


def svg_round_trip(spark, sf_dir):
    return svg.segments(svg.parsed(svg.written(_view(spark, sf_dir, LATTICE).withColumn(D, F.col(D).cast("string")))))


DOCUMENTS = """SELECT p_partkey AS drawing_id, concat('<svg>', repeat('<text>t</text>', CAST(p_size % 4 AS INT)), repeat('<image/>', CAST(p_size % 3 AS INT)),
    repeat('<line x1="0" x2="9"/>', CAST(p_size % 2 AS INT)), '<path/></svg>') AS svg FROM part"""


def skipped_elements(spark, sf_dir):
    rows = svg.parsed(_view(spark, sf_dir, DOCUMENTS))
    return rows.select(F.explode("skipped").alias("tag", "n")).groupBy("tag").agg(F.sum("n").alias("n"), F.count("*").alias("drawings"))


SHAPES = """SELECT p_partkey AS drawing_id, p_size AS s, concat('<svg><defs><rect id="r" width="', p_size, 'px" height="3"/></defs><use href="#r" x="', p_size, '" y="2"/><text>t</text>',
    '<g transform="translate(10,', p_size, ') scale(2)"><line x1="1" y1="0.5" x2="', p_size, '" y2="4"/></g><path d="M0 0Q', p_size, ' 10 ', 2 * p_size, ' 0l3-1"/><clipPath><rect width="9" height="9"/></clipPath></svg>') AS svg FROM part"""


def svg_shapes(spark, sf_dir):
    """Documents with a unit, a use of a definition, transforms and a curve of four chords."""
    found = svg.segments(svg.parsed(_view(spark, sf_dir, SHAPES).select(D, "svg"), 4))
    return found.select(F.col(D).cast("bigint").alias(D), "seg_ix", *[(F.round(c, 6) + 0.0).alias(c) for c in ("x1", "y1", "x2", "y2")], "element")


EVENTS = """SELECT concat('/drawings/u', user_id, '.svg') AS path, event_id AS seq, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'CERTIFIED' ELSE 'REFUSED' END AS status,
    CAST(floor(value) % 3 + 1 AS BIGINT) AS pieces, CAST(floor(value) % 5 AS BIGINT) AS faces, CAST(event_id % 2 AS BIGINT) AS dangles, CAST(10 AS DOUBLE) AS rho, 'derived' AS grid_source,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN NULL WHEN event_id % 3 = 0 THEN 'EDGES_CROSS' ELSE 'NO_GEOMETRY' END AS reason FROM events"""


def change_stamps(spark, sf_dir):
    return stamps.stamped(_view(spark, sf_dir, EVENTS))


def stamp_stream(spark, sf_dir):
    """The stream into Parquet files, with its state, like its progress, in the folder that the cluster shares."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    name = f"events_{uuid.uuid4().hex}"
    source.createOrReplaceTempView(name)
    top = f"{shared_dir(spark)}/stamps-{uuid.uuid4().hex}"
    provider, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(provider)
    spark.conf.set(provider, own)  # read when the stream starts
    try:
        found = stamps.stream(spark.sql(EVENTS.replace("FROM events", f"FROM {name}")))
        run = found.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(provider, before)
    run.awaitTermination()
    spark.catalog.dropTempView(name)
    return spark.read.schema(stamps.OUT).parquet(f"{top}/out")


QUERIES = {f.__name__: f for f in (
    exact_vertices, distinct_edges, euler_counts, vertex_edge_spectrum, near_incidences, crossings, subdivided_edges, merge_heights, single_linkage,
    cluster_stats, scale_gaps, containing_window, verdicts, verdict_json, scale_sensitivity, truth_by_name, contested_verdicts, heap_verdicts, grid_verdicts, budget_verdicts, refusals_by_reason, claims_on_heaps, checked_claims, refusal_histogram, latency_quantiles, growth_fit, arm_tally,
    strided_sample, rounded_faces, raster_holes, walked_faces, smallest_gap, degree_histogram, collapsed_edges, plane_linkage, nearest_pairs, polyline_crossings, part_supplier_euler, union_counts, loop_counts, svg_round_trip, svg_shapes, skipped_elements, change_stamps, stamp_stream,
    rho_sensitivity, method_agreement, rebuilt_verdicts, jitter_stratum, arrangement_digests, first_wrong, hook_lines, copy_counts, crossings_by_function,
)}


def _vertices_sql(segments: str) -> str:
    return f"""WITH RECURSIVE s AS ({segments}), ends AS (
        SELECT drawing_id, 2 * seg_ix AS ord, x1 AS x, y1 AS y FROM s UNION ALL SELECT drawing_id, 2 * seg_ix + 1, x2, y2 FROM s
    ), g AS (SELECT drawing_id, x, y, min(ord) AS ord FROM ends GROUP BY drawing_id, x, y),
    vs AS (SELECT drawing_id, CAST(row_number() OVER (PARTITION BY drawing_id ORDER BY ord) - 1 AS INTEGER) AS v, x, y FROM g),
    es AS (
        SELECT s.drawing_id, least(p.v, q.v) AS a, greatest(p.v, q.v) AS b, min(s.seg_ix) AS seg_ix, arg_min(s.element, s.seg_ix) AS element, count(*) AS n
        FROM s JOIN vs p ON p.drawing_id = s.drawing_id AND p.x = s.x1 AND p.y = s.y1 JOIN vs q ON q.drawing_id = s.drawing_id AND q.x = s.x2 AND q.y = s.y2
        GROUP BY 1, 2, 3
    ), ee AS (
        SELECT es.*, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS b_y FROM es JOIN vs p ON p.drawing_id = es.drawing_id AND p.v = es.a JOIN vs q ON q.drawing_id = es.drawing_id AND q.v = es.b
    )"""


_DISTANCES = """, tt AS (
        SELECT ee.*, vs.v, vs.x, vs.y, CASE WHEN (bx-ax)*(bx-ax) + (b_y-ay)*(b_y-ay) > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x-ax)*(bx-ax) + (y-ay)*(b_y-ay)) / ((bx-ax)*(bx-ax) + (b_y-ay)*(b_y-ay)))) ELSE 0 END AS t
        FROM ee JOIN vs ON vs.drawing_id = ee.drawing_id AND vs.v <> ee.a AND vs.v <> ee.b
    ), dd AS (SELECT *, sqrt((x - (ax + t*(bx-ax)))*(x - (ax + t*(bx-ax))) + (y - (ay + t*(b_y-ay)))*(y - (ay + t*(b_y-ay)))) AS d FROM tt)"""
_COUNTS = """, hop AS (SELECT drawing_id, a AS u, b AS w FROM es WHERE a <> b UNION ALL SELECT drawing_id, b, a FROM es WHERE a <> b),
    reach(drawing_id, v, root) AS (
        SELECT drawing_id, v, v FROM vs UNION SELECT hop.drawing_id, hop.w, reach.root FROM reach JOIN hop ON hop.drawing_id = reach.drawing_id AND hop.u = reach.v AND reach.root < hop.w
    ), roots AS (SELECT drawing_id, v, min(root) AS root FROM reach GROUP BY 1, 2),
    nv AS (SELECT drawing_id, count(*) AS v, count(DISTINCT root) AS pieces FROM roots GROUP BY 1),
    ne AS (SELECT drawing_id, count(*) AS e FROM es WHERE a <> b GROUP BY 1),
    loose AS (SELECT drawing_id, count(*) AS dangles FROM (SELECT drawing_id, u FROM hop GROUP BY 1, 2 HAVING count(*) = 1) x GROUP BY 1),
    counts AS (SELECT nv.drawing_id, v, coalesce(e, 0) AS e, pieces, coalesce(e, 0) - v + pieces AS faces, v - coalesce(e, 0) AS chi, coalesce(dangles, 0) AS dangles FROM nv LEFT JOIN ne USING (drawing_id) LEFT JOIN loose USING (drawing_id))"""
_EULER = _vertices_sql(LATTICE) + _COUNTS
_LINE = f"""WITH p AS ({POINTS}), h AS (SELECT drawing_id, round(x - lag(x) OVER (PARTITION BY drawing_id ORDER BY x), 9) AS w FROM p)"""
_GAPS = _LINE + f""", fl AS (SELECT drawing_id, {G.FLOOR_ULPS * G.EPS!r}::DOUBLE * CASE WHEN max(abs(x)) = 0 THEN 1 ELSE max(abs(x)) END AS floor FROM p GROUP BY 1),
    sp AS (SELECT DISTINCT h.drawing_id, w AS s FROM h JOIN fl USING (drawing_id) WHERE w > floor UNION SELECT drawing_id, floor FROM fl),
    gp AS (SELECT drawing_id, s AS lo, lead(s) OVER (PARTITION BY drawing_id ORDER BY s) AS hi, row_number() OVER (PARTITION BY drawing_id ORDER BY s) - 1 AS nth FROM sp),
    gaps AS (SELECT *, hi / lo AS ratio FROM gp WHERE hi IS NOT NULL)"""
_CLUSTERS = _LINE + f""", m AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY drawing_id ORDER BY x) > {RADIUS} THEN 1 ELSE 0 END AS cut FROM p),
    c AS (SELECT *, sum(cut) OVER (PARTITION BY drawing_id ORDER BY x) AS k FROM m),
    l AS (SELECT *, min(v) OVER (PARTITION BY drawing_id, k) AS head FROM c),
    lab AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY drawing_id ORDER BY head) - 1 AS INTEGER) AS label FROM l)"""
_STAMPS = f"""WITH e AS ({EVENTS}), w AS (
        SELECT *, lag(status) OVER o AS ws, lag(faces) OVER o AS wf, lag(reason) OVER o AS wr FROM e WINDOW o AS (PARTITION BY path ORDER BY seq)
    ), t AS (
        SELECT path, seq, CASE
            WHEN status = 'CERTIFIED' THEN concat('drawing ', regexp_extract(path, '[^/]*$'), '  pieces ', pieces, '  faces ', CASE WHEN ws = 'CERTIFIED' AND wf <> faces THEN concat(wf, ' -> ', faces) ELSE CAST(faces AS VARCHAR) END, CASE WHEN dangles > 0 THEN concat('  dangles ', dangles) ELSE '' END)
            WHEN wr IS DISTINCT FROM reason THEN concat('drawing ', regexp_extract(path, '[^/]*$'), '  ', CASE reason WHEN 'EDGES_CROSS' THEN 'edges cross' ELSE 'no line work' END) END AS stamp
        FROM w
    ) SELECT * FROM t WHERE stamp IS NOT NULL"""



def _verdict_sql(segments: str, cap: int = G.VERTEX_CAP, grid: float | None = None, rho: float = RHO) -> str:
    """CTEs up to `told`: the verdict of every drawing of at most CLUSTER_MAX vertices, from its spectrum and windows on.

    The merge heights are the distances of pairs that no chain of shorter ones connects.
    """
    budget = G.pair_budget(cap)
    inside = "" if grid is None else f" AND lo <= {grid} AND hi > {grid}"
    sound = f"SELECT * FROM ({segments}) z WHERE drawing_id NOT IN (SELECT drawing_id FROM ({segments}) b WHERE NOT (isfinite(x1) AND isfinite(y1) AND isfinite(x2) AND isfinite(y2)))"
    apart = "sqrt((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y))"
    t = "CASE WHEN (bx-ax)*(bx-ax) + (b_y-ay)*(b_y-ay) > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x-ax)*(bx-ax) + (y-ay)*(b_y-ay)) / ((bx-ax)*(bx-ax) + (b_y-ay)*(b_y-ay)))) ELSE 0 END"
    kinds = " ".join(f"WHEN '{r}' THEN '{k}'" for r, k in V.KIND_OF.items())
    return _vertices_sql(sound) + _DISTANCES + f""", bad AS (SELECT DISTINCT drawing_id FROM ({segments}) z WHERE NOT (isfinite(x1) AND isfinite(y1) AND isfinite(x2) AND isfinite(y2))),
    sz AS (SELECT drawing_id, count(*) AS m, max(greatest(abs(x1), abs(y1), abs(x2), abs(y2))) AS big FROM s GROUP BY 1),
    sizes AS (SELECT sz.*, n, {G.FLOOR_ULPS * G.EPS!r}::DOUBLE * CASE WHEN big = 0 THEN 1 ELSE big END AS floor, {G.MARGIN_ULPS * G.EPS!r}::DOUBLE * CASE WHEN big = 0 THEN 1 ELSE big END AS margin
        FROM sz JOIN (SELECT drawing_id, count(*) AS n FROM vs GROUP BY 1) k USING (drawing_id)),
    fit AS (SELECT * FROM sizes WHERE n <= {cap} AND n * m <= {budget}), fv AS (SELECT vs.* FROM vs JOIN fit USING (drawing_id)),
    seg AS (SELECT s.drawing_id, s.seg_ix, p.v AS a, q.v AS b FROM s JOIN fv p ON p.drawing_id = s.drawing_id AND p.x = s.x1 AND p.y = s.y1 JOIN fv q ON q.drawing_id = s.drawing_id AND q.x = s.x2 AND q.y = s.y2),
    pd AS (SELECT p.drawing_id, p.v AS i, q.v AS j, {apart} AS d FROM fv p JOIN fv q ON p.drawing_id = q.drawing_id AND p.v <> q.v),
    tau AS (SELECT DISTINCT drawing_id, d AS tau FROM pd),
    reach1(drawing_id, tau, v, root) AS (
        SELECT tau.drawing_id, tau, v, v FROM tau JOIN fv USING (drawing_id) UNION SELECT r.drawing_id, r.tau, pd.j, r.root FROM reach1 r JOIN pd ON pd.drawing_id = r.drawing_id AND pd.i = r.v AND pd.d < r.tau AND r.root < pd.j
    ), root1 AS (SELECT drawing_id, tau, v, min(root) AS root FROM reach1 GROUP BY 1, 2, 3),
    heights AS (SELECT DISTINCT pd.drawing_id, pd.d AS s FROM pd JOIN root1 x ON x.drawing_id = pd.drawing_id AND x.tau = pd.d AND x.v = pd.i JOIN root1 y ON y.drawing_id = pd.drawing_id AND y.tau = pd.d AND y.v = pd.j WHERE x.root <> y.root),
    sp AS (SELECT h.drawing_id, h.s FROM (SELECT * FROM heights UNION SELECT drawing_id, d FROM dd) h JOIN fit ON fit.drawing_id = h.drawing_id AND h.s > floor UNION SELECT drawing_id, floor FROM fit),
    gp AS (SELECT drawing_id, s AS lo, lead(s) OVER (PARTITION BY drawing_id ORDER BY s) AS hi, row_number() OVER (PARTITION BY drawing_id ORDER BY s) - 1 AS nth FROM sp),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY CASE WHEN nth = 0 THEN 1 ELSE 0 END, hi / lo DESC, lo) - 1 AS cand FROM gp WHERE hi / lo >= {rho}{inside}),
    cands AS (SELECT r.drawing_id, cand, lo, hi, m, margin FROM ranked r JOIN fit USING (drawing_id) WHERE cand < {G.CAND_MAX}),
    reach2(drawing_id, cand, lo, v, root) AS (
        SELECT c.drawing_id, cand, lo, v, v FROM cands c JOIN fv USING (drawing_id) UNION SELECT r.drawing_id, r.cand, r.lo, pd.j, r.root FROM reach2 r JOIN pd ON pd.drawing_id = r.drawing_id AND pd.i = r.v AND pd.d <= r.lo AND r.root < pd.j
    ), root2 AS (SELECT drawing_id, cand, v, min(root) AS label FROM reach2 GROUP BY 1, 2, 3),
    pts AS (SELECT drawing_id, cand, v, rep.x AS x, rep.y AS y FROM (SELECT r.drawing_id, cand, label AS v, min({{'x': x, 'y': y}}) AS rep FROM root2 r JOIN fv USING (drawing_id, v) GROUP BY 1, 2, 3) z),
    cseg AS (SELECT seg.drawing_id, p.cand, seg_ix, p.label AS a, q.label AS b FROM seg JOIN root2 p ON p.drawing_id = seg.drawing_id AND p.v = seg.a JOIN root2 q ON q.drawing_id = seg.drawing_id AND q.v = seg.b AND q.cand = p.cand),
    dead AS (SELECT drawing_id, cand, count(*) AS n_dead FROM cseg WHERE a = b GROUP BY 1, 2),
    whole AS (SELECT c.* FROM cands c LEFT JOIN dead USING (drawing_id, cand) WHERE n_dead IS NULL AND hi > margin),
    ued AS (SELECT DISTINCT c.drawing_id, c.cand, least(a, b) AS a, greatest(a, b) AS b FROM cseg c JOIN whole USING (drawing_id, cand)),
    nc AS (SELECT drawing_id, cand, count(*) AS n_clusters FROM pts GROUP BY 1, 2), nu AS (SELECT drawing_id, cand, count(*) AS n_edges FROM ued GROUP BY 1, 2),
    uend AS (SELECT u.*, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS b_y FROM ued u JOIN pts p ON p.drawing_id = u.drawing_id AND p.cand = u.cand AND p.v = u.a JOIN pts q ON q.drawing_id = u.drawing_id AND q.cand = u.cand AND q.v = u.b),
    ct AS (SELECT u.*, pts.v, x, y, {t} AS t FROM uend u JOIN pts ON pts.drawing_id = u.drawing_id AND pts.cand = u.cand AND pts.v <> u.a AND pts.v <> u.b),
    cd AS (SELECT *, sqrt((x - (ax + t*(bx-ax)))*(x - (ax + t*(bx-ax))) + (y - (ay + t*(b_y-ay)))*(y - (ay + t*(b_y-ay)))) AS d FROM ct),
    near AS (SELECT cd.* FROM cd JOIN whole w USING (drawing_id, cand) JOIN nc USING (drawing_id, cand) JOIN nu USING (drawing_id, cand) WHERE d < w.hi AND n_clusters * n_edges <= {budget}),
    band AS (SELECT drawing_id, cand, count(*) AS n_band FROM near WHERE d > 0 GROUP BY 1, 2),
    clear AS (SELECT w.* FROM whole w JOIN nc USING (drawing_id, cand) JOIN nu USING (drawing_id, cand) LEFT JOIN band USING (drawing_id, cand) WHERE n_band IS NULL AND n_clusters * n_edges <= {budget}),
    onto AS (SELECT near.* FROM near JOIN clear USING (drawing_id, cand) WHERE d = 0), split AS (SELECT drawing_id, cand, count(DISTINCT (a, b)) AS n_subdivided FROM onto GROUP BY 1, 2),
    stops AS (SELECT u.drawing_id, u.cand, a, b, -1.0::DOUBLE AS t, a AS v FROM ued u JOIN clear USING (drawing_id, cand) UNION ALL SELECT u.drawing_id, u.cand, a, b, 2.0, b FROM ued u JOIN clear USING (drawing_id, cand) UNION ALL SELECT drawing_id, cand, a, b, t, v FROM onto),
    hops AS (SELECT *, lead(v) OVER (PARTITION BY drawing_id, cand, a, b ORDER BY t, v) AS w FROM stops),
    final AS (SELECT drawing_id, cand, least(v, w) AS a, greatest(v, w) AS b, count(*) AS parts FROM hops WHERE w IS NOT NULL GROUP BY 1, 2, 3, 4),
    nf AS (SELECT drawing_id, cand, count(*) AS n_final, CAST(sum(parts) AS BIGINT) AS parts FROM final GROUP BY 1, 2),
    fe AS (SELECT f.*, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS b_y FROM final f JOIN pts p ON p.drawing_id = f.drawing_id AND p.cand = f.cand AND p.v = f.a JOIN pts q ON q.drawing_id = f.drawing_id AND q.cand = f.cand AND q.v = f.b),
    xs AS (SELECT p.drawing_id, p.cand, count(*) AS n_cross FROM (SELECT *, bx AS ex, b_y AS ey FROM fe) p JOIN (SELECT drawing_id, cand, a, b, ax AS cx, ay AS cy, bx AS dx, b_y AS dy FROM fe) q
        ON p.drawing_id = q.drawing_id AND p.cand = q.cand AND (p.a, p.b) < (q.a, q.b) AND p.a NOT IN (q.a, q.b) AND p.b NOT IN (q.a, q.b)
        WHERE (((ex-ax)*(cy-ay) - (ey-ay)*(cx-ax)) > 0) <> (((ex-ax)*(dy-ay) - (ey-ay)*(dx-ax)) > 0) AND (((dx-cx)*(ay-cy) - (dy-cy)*(ax-cx)) > 0) <> (((dx-cx)*(ey-cy) - (dy-cy)*(ex-cx)) > 0)
            AND NOT (greatest(ax, ex) < least(cx, dx) OR greatest(cx, dx) < least(ax, ex) OR greatest(ay, ey) < least(cy, dy) OR greatest(cy, dy) < least(ay, ey)) GROUP BY 1, 2),
    fhop AS (SELECT drawing_id, cand, a AS u, b AS w FROM final UNION ALL SELECT drawing_id, cand, b, a FROM final),
    reach3(drawing_id, cand, v, root) AS (SELECT p.drawing_id, p.cand, v, v FROM pts p JOIN clear USING (drawing_id, cand) UNION SELECT h.drawing_id, h.cand, h.w, r.root FROM reach3 r JOIN fhop h ON h.drawing_id = r.drawing_id AND h.cand = r.cand AND h.u = r.v AND r.root < h.w),
    np AS (SELECT drawing_id, cand, count(DISTINCT root) AS pieces FROM (SELECT drawing_id, cand, v, min(root) AS root FROM reach3 GROUP BY 1, 2, 3) z GROUP BY 1, 2),
    nd AS (SELECT drawing_id, cand, count(*) AS dangles FROM (SELECT drawing_id, cand, u FROM fhop GROUP BY 1, 2, 3 HAVING count(*) = 1) z GROUP BY 1, 2),
    o AS (SELECT c.*, n, n_clusters, n_edges, n_final, parts, n_dead, n_band, n_cross, coalesce(n_subdivided, 0) AS n_subdivided, pieces, coalesce(dangles, 0) AS dangles,
        CASE WHEN NOT hi > c.margin THEN 'MARGIN_TOO_SMALL' WHEN n_dead > 0 THEN 'EDGE_COLLAPSED' WHEN n_clusters * n_edges > {budget} THEN 'TOO_MANY_PAIRS' WHEN n_band > 0 THEN 'VERTEX_NEAR_EDGE' WHEN n_final * n_final > {budget} THEN 'TOO_MANY_PAIRS' WHEN n_cross > 0 THEN 'EDGES_CROSS' END AS reason
        FROM cands c JOIN fit USING (drawing_id) LEFT JOIN nc USING (drawing_id, cand) LEFT JOIN nu USING (drawing_id, cand) LEFT JOIN nf USING (drawing_id, cand) LEFT JOIN dead USING (drawing_id, cand) LEFT JOIN band USING (drawing_id, cand)
            LEFT JOIN xs USING (drawing_id, cand) LEFT JOIN split USING (drawing_id, cand) LEFT JOIN np USING (drawing_id, cand) LEFT JOIN nd USING (drawing_id, cand)),
    pick AS (SELECT *, count(*) OVER (PARTITION BY drawing_id) AS n_candidates, coalesce(min(CASE WHEN reason IN ('EDGE_COLLAPSED', 'MARGIN_TOO_SMALL') THEN NULL ELSE cand END) OVER (PARTITION BY drawing_id), 0) AS chosen FROM o),
    ans AS (
        SELECT drawing_id, reason, n_clusters AS v, n_final AS e, pieces, n_final - n_clusters + pieces AS faces, n_clusters - n_final AS chi, dangles, n_subdivided, m - n_edges + parts - n_final AS n_dup_edges, n - n_clusters AS n_merged, n_candidates,
            greatest(0, CASE reason WHEN 'EDGE_COLLAPSED' THEN n_dead WHEN 'VERTEX_NEAR_EDGE' THEN n_band WHEN 'EDGES_CROSS' THEN n_cross ELSE 1 END - {G.SITES}) AS n_more, round(hi, 9) AS t_above FROM pick WHERE cand = chosen
    ), rest AS (
        SELECT drawing_id, 'NO_STABLE_SCALE' AS reason FROM fit WHERE drawing_id NOT IN (SELECT drawing_id FROM ans)
        UNION ALL SELECT drawing_id, 'TOO_MANY_VERTICES' FROM sizes WHERE drawing_id NOT IN (SELECT drawing_id FROM fit) UNION ALL SELECT drawing_id, 'BAD_INPUT' FROM bad
    ), told AS (
        SELECT drawing_id, CASE WHEN reason IS NULL THEN 'CERTIFIED' WHEN reason = 'BAD_INPUT' THEN 'BAD INPUT' ELSE 'REFUSED' END AS status, reason, CASE reason {kinds} END AS kind,
            {", ".join(f"CASE WHEN reason IS NULL THEN {c} END AS {c}" for c in TOLD[3:-1])}, n_more, CASE WHEN reason IS NULL THEN t_above END AS t_above
        FROM (SELECT * FROM ans UNION ALL SELECT drawing_id, reason, {", ".join(["NULL"] * 10)}, 0, NULL FROM rest) z
    )"""


_TOLD, _AS_DRAWN = _verdict_sql(HEAPS) + " SELECT * FROM told", _vertices_sql(HEAPS) + _COUNTS + " SELECT drawing_id, faces FROM counts"
_ROUND = f"SELECT drawing_id, seg_ix, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, element FROM ({HEAPS}) z"
_SIDE = "(({2}-{0})*({5}-{1}) - ({3}-{1})*({4}-{0}) > 0)".format
_A, _B, _C, _DD = (("p.x1", "p.y1"), ("p.x2", "p.y2"), ("q.x1", "q.y1"), ("q.x2", "q.y2"))
SQL = {
    "rho_sensitivity": f"WITH truth AS ({_AS_DRAWN}), a AS (" + " UNION ALL ".join(f"SELECT {r}::DOUBLE AS rho, * FROM ({_verdict_sql(HEAPS, rho=r)} SELECT drawing_id, faces, n_merged FROM told) z" for r in SWEEP) + """)
        SELECT rho, count(*) FILTER (a.faces <> t.faces) AS wrong, count(*) FILTER (a.faces = t.faces) AS exact, count(*) FILTER (a.faces IS NULL) AS refused, count(*) FILTER (a.faces <> t.faces AND n_merged = 0) AS merged_nothing
        FROM truth t JOIN a USING (drawing_id) GROUP BY 1""",
    "method_agreement": f"""WITH c AS (SELECT * FROM (SELECT drawing_id, faces, row_number() OVER (ORDER BY drawing_id) - 1 AS k FROM ({_TOLD}) z WHERE status = 'CERTIFIED') y WHERE k % 3 = 0),
        m AS (SELECT 'plain' AS method, * FROM ({_AS_DRAWN}) z UNION ALL SELECT 'rounded', * FROM ({_vertices_sql(_ROUND) + _COUNTS} SELECT drawing_id, faces FROM counts) z)
        SELECT method, count(*) AS checked, count(*) FILTER (c.faces = m.faces) AS agree, count(*) FILTER (c.faces <> m.faces) AS disagree FROM c JOIN m USING (drawing_id) GROUP BY 1""",
    "rebuilt_verdicts": _verdict_sql(HEAPS) + " SELECT drawing_id, faces, true AS same FROM told WHERE status = 'CERTIFIED'",
    "jitter_stratum": f"SELECT r AS ratio, CAST({len(figures.families()) * figures.SEEDS} AS BIGINT) AS draws, CAST(0 AS BIGINT) AS wrong FROM (VALUES {', '.join(f'({r!r}::DOUBLE)' for r in figures.RATIOS)}) v(r)",
    "arrangement_digests": _vertices_sql(LATTICE) + f""", r AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY x, y) - 1 AS r FROM vs),
        reps AS (SELECT drawing_id, string_agg(concat('[', x, ',', y, ']'), ',' ORDER BY r) AS reps FROM r GROUP BY 1),
        links AS (SELECT es.drawing_id, least(p.r, q.r) AS a, greatest(p.r, q.r) AS b FROM es JOIN r p ON p.drawing_id = es.drawing_id AND p.v = es.a JOIN r q ON q.drawing_id = es.drawing_id AND q.v = es.b),
        edges AS (SELECT drawing_id, string_agg(concat('[', a, ',', b, ']'), ',' ORDER BY a, b) AS edges FROM links GROUP BY 1),
        low AS (SELECT drawing_id, {G.FLOOR_ULPS * G.EPS!r}::DOUBLE * max(greatest(abs(x1), abs(y1), abs(x2), abs(y2))) AS low FROM s GROUP BY 1)
        SELECT drawing_id, sha1(concat('{{"edges":[', edges, '],"flatten":[0,0],"reps":[', reps, '],"rho":{RHO},"t_above":1.0,"t_below":', low, ',"version":"{V.VERSION}"}}')) AS digest FROM reps JOIN edges USING (drawing_id) JOIN low USING (drawing_id)""",
    "first_wrong": """SELECT arm, l_orderkey, l_linenumber, truth, answer FROM (SELECT l_returnflag AS arm, l_orderkey, l_linenumber, l_partkey % 7 + 1 AS truth, l_linenumber AS answer,
        row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey % 7) AS k FROM lineitem WHERE l_quantity < 40 AND l_linenumber <> l_partkey % 7 + 1) x WHERE k = 1""",
    "hook_lines": f"""SELECT path, seq, concat('{{"hookSpecificOutput":{{"hookEventName":"PostToolUse","additionalContext":"', stamp, '"}}}}') AS line FROM ({_STAMPS}) z""",
    "copy_counts": _EULER + " SELECT drawing_id, 2 * v AS v, 2 * e AS e, 2 * pieces AS pieces, 2 * faces AS faces, 2 * chi AS chi, 2 * dangles AS dangles FROM counts",
    "crossings_by_function": f"""WITH c AS ({CHORDS}) SELECT p.drawing_id, p.seg_ix, q.seg_ix AS other FROM c p JOIN c q ON p.drawing_id = q.drawing_id AND p.seg_ix < q.seg_ix
        WHERE {_SIDE(*_A, *_B, *_C)} <> {_SIDE(*_A, *_B, *_DD)} AND {_SIDE(*_C, *_DD, *_A)} <> {_SIDE(*_C, *_DD, *_B)}""",
    "heap_verdicts": _verdict_sql(HEAPS) + " SELECT * FROM told",
    "grid_verdicts": _verdict_sql(HEAPS, grid=GRID) + " SELECT * FROM told",
    "budget_verdicts": _verdict_sql(WEBS, cap=FEW) + " SELECT * FROM told",
    "refusals_by_reason": _verdict_sql(HEAPS) + """, r AS (SELECT kind, reason FROM told WHERE status <> 'CERTIFIED')
        SELECT kind, reason, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM r), 6)::DOUBLE AS percent FROM r GROUP BY ROLLUP (kind, reason)""",
    "claims_on_heaps": _verdict_sql(HEAPS) + """ SELECT drawing_id, CASE WHEN status = 'BAD INPUT' THEN 'BAD INPUT' WHEN status <> 'CERTIFIED' THEN 'REFUSED' WHEN faces = 0 AND (drawing_id % 2 <> 0 OR pieces = 1) THEN 'HELD' ELSE 'BROKEN' END AS verdict,
        CASE WHEN status = 'BAD INPUT' THEN 3 WHEN status <> 'CERTIFIED' THEN 2 WHEN faces = 0 AND (drawing_id % 2 <> 0 OR pieces = 1) THEN 0 ELSE 1 END AS exit_code FROM told""",
    "exact_vertices": _vertices_sql(LATTICE) + " SELECT drawing_id, v, x, y FROM vs",
    "distinct_edges": _vertices_sql(LATTICE) + " SELECT drawing_id, a, b, seg_ix, element, n FROM es",
    "euler_counts": _EULER + " SELECT * FROM counts",
    "vertex_edge_spectrum": _vertices_sql(CHORDS) + _DISTANCES + " SELECT DISTINCT drawing_id, round(d, 9) AS s FROM dd",
    "near_incidences": _vertices_sql(CHORDS) + _DISTANCES + f""", r AS (SELECT *, CAST(row_number() OVER (PARTITION BY drawing_id ORDER BY d, seg_ix, v) AS INTEGER) AS place FROM dd WHERE d < {NEAR})
        SELECT drawing_id, place, seg_ix, v, round(t, 9) AS t, round(d, 9) AS d FROM r WHERE place <= {G.SITES}""",
    "crossings": _vertices_sql(CHORDS) + """, x AS (
        SELECT p.drawing_id, p.seg_ix AS e, q.seg_ix AS e2, p.element, q.element AS other, p.ax, p.ay, p.bx, p.b_y, q.ax AS cx, q.ay AS cy, q.bx AS dx, q.b_y AS dy
        FROM ee p JOIN ee q ON p.drawing_id = q.drawing_id AND p.seg_ix < q.seg_ix AND p.a NOT IN (q.a, q.b) AND p.b NOT IN (q.a, q.b)
    ), y AS (SELECT *, ((cx-ax)*(dy-cy) - (cy-ay)*(dx-cx)) / ((bx-ax)*(dy-cy) - (b_y-ay)*(dx-cx)) AS u FROM x
        WHERE (((bx-ax)*(cy-ay) - (b_y-ay)*(cx-ax)) > 0) <> (((bx-ax)*(dy-ay) - (b_y-ay)*(dx-ax)) > 0) AND (((dx-cx)*(ay-cy) - (dy-cy)*(ax-cx)) > 0) <> (((dx-cx)*(b_y-cy) - (dy-cy)*(bx-cx)) > 0)
    ) SELECT drawing_id, e, e2, element, other, round(ax + u*(bx-ax), 6) AS x, round(ay + u*(b_y-ay), 6) AS y FROM y""",
    "subdivided_edges": _vertices_sql(LONG) + _DISTANCES + """, stops AS (
        SELECT drawing_id, seg_ix, element, -1.0 AS t, a AS v FROM es UNION ALL SELECT drawing_id, seg_ix, element, 2.0, b FROM es UNION ALL SELECT drawing_id, seg_ix, element, t, v FROM dd WHERE d = 0
    ), hops AS (SELECT *, lead(v) OVER (PARTITION BY drawing_id, seg_ix ORDER BY t, v) AS w FROM stops)
        SELECT drawing_id, least(v, w) AS a, greatest(v, w) AS b, arg_min(element, seg_ix) AS element, count(*) AS parts FROM hops WHERE w IS NOT NULL GROUP BY 1, 2, 3""",
    "merge_heights": _LINE + " SELECT drawing_id, w FROM h WHERE w IS NOT NULL",
    "single_linkage": _CLUSTERS + " SELECT drawing_id, v, label FROM lab",
    "cluster_stats": _CLUSTERS + f" SELECT drawing_id, label, count(*) AS size, min(x) AS rep_x, CAST(0 AS DOUBLE) AS rep_y, round(max(x) - min(x), 9) AS diameter, count(*) <= {G.CLUSTER_MAX} AS fits FROM lab GROUP BY 1, 2",
    "scale_gaps": _GAPS + f""", r AS (SELECT *, CAST(row_number() OVER (PARTITION BY drawing_id ORDER BY CASE WHEN nth = 0 THEN 1 ELSE 0 END, ratio DESC, lo) - 1 AS INTEGER) AS cand FROM gaps WHERE ratio >= {RHO})
        SELECT drawing_id, cand, round(hi, 9) AS hi, CAST(nth AS INTEGER) AS nth FROM r WHERE cand < {G.CAND_MAX}""",
    "containing_window": _GAPS + f" SELECT drawing_id, round(hi, 9) AS hi, CAST(nth AS INTEGER) AS nth, ratio >= {RHO} AS wide FROM gaps WHERE lo <= {RADIUS} AND hi > {RADIUS}",
    "verdicts": _EULER + " SELECT drawing_id, 'CERTIFIED' AS status, v, e, pieces, faces, chi, dangles FROM counts",
    "checked_claims": _EULER + f""" SELECT counts.drawing_id, CASE WHEN (c.faces IS NULL OR c.faces = counts.faces) AND c.pieces = counts.pieces THEN 'HELD' ELSE 'BROKEN' END AS verdict,
        CASE WHEN (c.faces IS NULL OR c.faces = counts.faces) AND c.pieces = counts.pieces THEN 0 ELSE 1 END AS exit_code, counts.faces, counts.pieces FROM counts JOIN ({CLAIMS}) c USING (drawing_id)""",
    "verdict_json": _EULER + " SELECT drawing_id, 'CERTIFIED' AS status, v, e, pieces, faces, chi, 0 AS exit_code FROM counts",
    "scale_sensitivity": _GAPS + " SELECT rho, count(*) AS windows, count(DISTINCT drawing_id) AS drawings FROM gaps, (VALUES (3.0::DOUBLE), (10.0::DOUBLE), (100.0::DOUBLE)) r(rho) WHERE ratio >= rho GROUP BY 1",
    "truth_by_name": _EULER + " SELECT counts.drawing_id, pieces, k.truth, pieces = k.truth AS agrees FROM counts LEFT JOIN (SELECT s_suppkey AS drawing_id, CAST(1 AS BIGINT) AS truth FROM supplier WHERE s_suppkey % 2 = 0) k ON counts.drawing_id = k.drawing_id",
    "refusal_histogram": "SELECT kind, reason, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 6)::DOUBLE AS percent FROM (SELECT CASE WHEN user_id % 3 = 0 THEN 'budget' ELSE 'geometry' END AS kind, event_type AS reason FROM events) x GROUP BY ROLLUP (kind, reason)",
    "latency_quantiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
        SELECT event_type, count(*) AS n, median(value) AS median, max(CASE WHEN k = least(n - 1, CAST(floor(n * 0.95::DOUBLE) AS BIGINT)) THEN value END) AS p95, min(value) AS smallest, max(value) AS largest FROM r GROUP BY 1""",
    "growth_fit": """SELECT o_orderpriority, round(regr_slope(ln(o_totalprice), ln(o_custkey::DOUBLE)), 6) AS exponent,
        round(exp(regr_intercept(ln(o_totalprice), ln(o_custkey::DOUBLE)) + regr_slope(ln(o_totalprice), ln(o_custkey::DOUBLE)) * ln(100000.0::DOUBLE)), 3) AS estimate FROM orders WHERE o_custkey > 0 AND o_totalprice > 0 GROUP BY 1""",
    "arm_tally": """SELECT l_returnflag AS arm, l_linestatus AS level, count(*) FILTER (l_quantity < 40 AND l_linenumber <> l_partkey % 7 + 1) AS wrong,
        count(*) FILTER (l_quantity < 40 AND l_linenumber = l_partkey % 7 + 1) AS exact, count(*) FILTER (NOT l_quantity < 40) AS refused FROM lineitem GROUP BY 1, 2""",
    "strided_sample": "SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS k FROM customer) x WHERE k % 7 = 0",
    "rounded_faces": _vertices_sql(f"SELECT drawing_id, seg_ix, round(x1, 6) AS x1, y1, round(x2, 6) AS x2, y2, element FROM ({NOISY}) z") + _COUNTS + " SELECT drawing_id, faces FROM counts",
    "walked_faces": _EULER + " SELECT drawing_id, faces FROM counts WHERE faces > 0",
    "raster_holes": _EULER + " SELECT drawing_id, faces AS holes FROM counts",
    "degree_histogram": _EULER + " SELECT degree, count(*) AS vertices FROM (SELECT drawing_id, u, count(*) AS degree FROM hop GROUP BY 1, 2) x GROUP BY 1",
    "collapsed_edges": _vertices_sql(CHORDS) + f""", h AS (SELECT p.drawing_id, p.v AS a, q.v AS b FROM vs p JOIN vs q ON p.drawing_id = q.drawing_id AND p.v <> q.v AND sqrt((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y)) <= {SHORT}),
        reach(drawing_id, v, root) AS (SELECT drawing_id, v, v FROM vs UNION SELECT h.drawing_id, h.b, reach.root FROM reach JOIN h ON h.drawing_id = reach.drawing_id AND h.a = reach.v AND reach.root < h.b),
        lab AS (SELECT drawing_id, v, min(root) AS label FROM reach GROUP BY 1, 2),
        x AS (SELECT *, sqrt((bx-ax)*(bx-ax) + (b_y-ay)*(b_y-ay)) AS far FROM ee)
        SELECT x.drawing_id, seg_ix, element, round(far, 9) AS length FROM x JOIN lab p ON p.drawing_id = x.drawing_id AND p.v = x.a JOIN lab q ON q.drawing_id = x.drawing_id AND q.v = x.b WHERE p.label = q.label AND isfinite(far)""",
    "plane_linkage": f"""WITH RECURSIVE p AS ({PLANE_SQL}), h AS (SELECT p.drawing_id, p.v AS a, q.v AS b FROM p JOIN p q ON p.drawing_id = q.drawing_id AND p.v <> q.v AND sqrt((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y)) <= {CLOSE}),
        reach(drawing_id, v, root) AS (SELECT drawing_id, v, v FROM p UNION SELECT h.drawing_id, h.b, reach.root FROM reach JOIN h ON h.drawing_id = reach.drawing_id AND h.a = reach.v AND reach.root < h.b)
        SELECT drawing_id, v AS vec_id, min(root) AS root FROM reach GROUP BY 1, 2""",
    "nearest_pairs": f"""WITH p AS ({PLANE_SQL}), d AS (SELECT p.drawing_id, p.v, q.v AS w, round(sqrt((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y)), 9) AS d FROM p JOIN p q ON p.drawing_id = q.drawing_id AND p.v < q.v),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY drawing_id ORDER BY d, v, w) AS INTEGER) AS place FROM d) SELECT drawing_id, place, v, w, d FROM r WHERE place <= 3""",
    "polyline_crossings": _vertices_sql(POLYLINES) + """ SELECT p.drawing_id, count(*) AS crossings FROM (SELECT *, bx AS ex, b_y AS ey FROM ee) p JOIN (SELECT drawing_id, seg_ix, a, b, ax AS cx, ay AS cy, bx AS dx, b_y AS dy FROM ee) q
        ON p.drawing_id = q.drawing_id AND p.seg_ix < q.seg_ix AND p.a NOT IN (q.a, q.b) AND p.b NOT IN (q.a, q.b)
        WHERE (((ex-ax)*(cy-ay) - (ey-ay)*(cx-ax)) > 0) <> (((ex-ax)*(dy-ay) - (ey-ay)*(dx-ax)) > 0) AND (((dx-cx)*(ay-cy) - (dy-cy)*(ax-cx)) > 0) <> (((dx-cx)*(ey-cy) - (dy-cy)*(ex-cx)) > 0) GROUP BY 1""",
    "part_supplier_euler": f"""WITH RECURSIVE e AS ({PARTS}), hop AS (SELECT a AS u, b AS w FROM e UNION ALL SELECT b, a FROM e),
        lab(v, r) USING KEY (v) AS (SELECT u, u FROM (SELECT DISTINCT u FROM hop) n UNION SELECT hop.w, min(lab.r) FROM lab JOIN hop ON hop.u = lab.v JOIN recurring.lab c ON c.v = hop.w WHERE lab.r < c.r GROUP BY hop.w),
        n AS (SELECT count(*) AS v, count(DISTINCT r) AS pieces FROM lab), m AS (SELECT count(*) AS e FROM e), d AS (SELECT count(*) AS dangles FROM (SELECT u FROM hop GROUP BY u HAVING count(*) = 1) x)
        SELECT v, e, pieces, e - v + pieces AS faces, v - e AS chi, dangles FROM n, m, d""",
    "smallest_gap": _vertices_sql(CHORDS) + _DISTANCES + """, apart AS (SELECT p.drawing_id, sqrt((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y)) AS d FROM vs p JOIN vs q ON p.drawing_id = q.drawing_id AND p.v < q.v UNION ALL SELECT drawing_id, d FROM dd)
        SELECT drawing_id, round(min(d), 9) AS gap FROM apart WHERE d > 0 GROUP BY 1""",
    "union_counts": _EULER + " SELECT drawing_id, 2 * v AS v, 2 * e AS e, 2 * pieces AS pieces, 2 * faces AS faces, 2 * chi AS chi FROM counts",
    "loop_counts": _EULER + " SELECT drawing_id, v + 4 AS v, e + 5 AS e, pieces, faces + 1 AS faces, chi - 1 AS chi FROM counts",
    "svg_round_trip": f"SELECT CAST(drawing_id AS VARCHAR) AS drawing_id, seg_ix, x1, y1, x2, y2, concat('line#s', seg_ix) AS element FROM ({LATTICE}) s",
    "svg_shapes": f"""WITH p AS ({SHAPES}), l AS (
            SELECT drawing_id, k AS seg_ix, s + CASE WHEN k IN (1, 2) THEN s ELSE 0 END AS x1, 2 + CASE WHEN k IN (2, 3) THEN 3 ELSE 0 END AS y1, s + CASE WHEN k IN (0, 1) THEN s ELSE 0 END AS x2, 2 + CASE WHEN k IN (1, 2) THEN 3 ELSE 0 END AS y2, 'rect#r' AS element FROM p, range(4) r(k)
            UNION ALL SELECT drawing_id, 4, 12, s + 1, 10 + 2 * s, s + 8, 'line#0' FROM p
            UNION ALL SELECT drawing_id, 5 + k, 2 * s * k / 4.0, 20 * (1 - k / 4.0) * k / 4.0, 2 * s * (k + 1) / 4.0, 20 * (1 - (k + 1) / 4.0) * (k + 1) / 4.0, 'path#0' FROM p, range(4) r(k)
            UNION ALL SELECT drawing_id, 9, 2 * s, 0, 2 * s + 3, -1, 'path#0' FROM p
        ) SELECT drawing_id, CAST(seg_ix AS INTEGER) AS seg_ix, round(x1::DOUBLE, 6) AS x1, round(y1::DOUBLE, 6) AS y1, round(x2::DOUBLE, 6) AS x2, round(y2::DOUBLE, 6) AS y2, element FROM l""",
    "skipped_elements": """WITH t AS (SELECT 'text' AS tag, p_size % 4 AS n FROM part UNION ALL SELECT 'image', p_size % 3 FROM part UNION ALL SELECT 'path-without-d', 1 FROM part)
        SELECT tag, CAST(sum(n) AS BIGINT) AS n, count(*) AS drawings FROM t WHERE n > 0 GROUP BY 1""",
    "change_stamps": _STAMPS,
    "stamp_stream": _STAMPS,
}
