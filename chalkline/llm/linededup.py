"""Removal of repeated runs of lines, with DataFrame operations only.

Lines become ids, and the sequences of ids a suffix array, by prefix doubling: ranks by the first 2^j lines of a suffix give
ranks by the first 2^(j+1), since a suffix is two such halves. A rank is the number of smaller suffixes, so refining it only
needs how many suffixes of the same rank have a smaller second half; equal halves are counted before they are shuffled, and
the running counts of one rank are taken in two steps, so that a very frequent line is no single task.

A run is deleted where it has occurred before, in the order of doc_id and line, if it has at least min_words words. The
shortest runs from and up to each line that have so many words are looked up in the array: suffixes that share one form an
interval in which the longest common prefix is at least that run, and all of the interval but its first suffix are later
copies. These shortest runs cover every longer one, so their union is the union of the maximal repeated runs. Depth beyond
the longest of them cannot change what is deleted, and doubling ends there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, stored

MIN_WORDS = 50
BINS = 256  # of the second ranks below one first rank
KEY = ["doc_id", "th"]
LACKING = -(1 << 63)  # stands for a null doc_id, so that it comes first and meets itself in joins
WORD = r"[^\x20\x09-\x0D]+"


def _id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LACKING)).alias("doc_id")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, h1, h2, w): every line with two hashes and its number of words."""
    line = F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    rows = docs.where("text is not null").select(_id("doc_id"), F.xxhash64("text").alias("th"), line)
    return rows.select(*KEY, "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), F.regexp_count("line", F.lit(WORD)).alias("w"))


def _islands(lines: DataFrame, n_lines: int, min_words: int) -> DataFrame:
    """Lines of every stretch of repeated lines that has enough words: (doc_id, th, start, pos, h1, h2, w, before, total).

    Only repeated lines can be in a repeated run. before: words of the stretch before the line.
    """
    # Written before it is joined: a join of two plain exchanges is one that adaptive execution can split at a hot line.
    often = stored(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "often", n_lines // 2)
    in_doc = Window.partitionBy(*KEY).orderBy("pos")
    shared = lines.join(often, ["h1", "h2"]).withColumn("start", F.col("pos") - F.row_number().over(in_doc))
    stretch = Window.partitionBy(*KEY, "start")
    before = F.coalesce(F.sum("w").over(stretch.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    summed = shared.withColumn("before", before).withColumn("total", F.sum("w").over(stretch).cast("int"))
    return summed.where(F.col("total") >= min_words)


def _runs(rows: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, th, pos, end, length): the shortest runs with enough words from each line on, and up to each line.

    end is the line after the run. Both come from one pass over the lines in the order of the words before them, in which
    a line that asks finds the next line by words, downwards for the end and upwards for the start.
    """
    own = [*KEY, "start"]
    here = rows.select(*own, "pos", F.col("before").alias("at"), F.lit(0).alias("asks"))
    last = rows.groupBy(*own).agg((F.max("pos") + 1).alias("pos"), F.max("total").alias("at"), F.lit(0).alias("asks"))
    found = F.last(F.when(F.col("asks") == 0, F.col("pos")), ignorenulls=True)
    down = Window.partitionBy(*own).orderBy(F.desc("at"), "asks", F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*own).orderBy("at", "asks", "pos").rowsBetween(Window.unboundedPreceding, 0)
    from_here = rows.select(*own, "pos", (F.col("before") + min_words).alias("at"), F.lit(1).alias("asks"))
    to_here = rows.select(*own, "pos", (F.col("before") + F.col("w") - min_words).cast("int").alias("at"), F.lit(1).alias("asks"))
    onward = here.unionByName(last).unionByName(from_here).withColumn("end", found.over(down)).where("asks = 1").select(*KEY, "pos", "end")
    back = here.unionByName(to_here).withColumn("first", found.over(up)).where("asks = 1").select(*KEY, F.col("first").alias("pos"), (F.col("pos") + 1).alias("end"))
    return onward.unionByName(back).where("pos is not null and end is not null").distinct().withColumn("length", F.col("end") - F.col("pos"))


def _running(counts: DataFrame, group: list[str], order: list[Column], bin_: Column) -> DataFrame:
    """counts(.., n) with below: the sum of n over the rows of the same group that come before in order, by way of bins."""
    cells = counts.withColumn("bin", bin_)
    by_bin = Window.partitionBy(*group).orderBy("bin") if group else Window.orderBy("bin")
    skipped = cells.groupBy(*group, "bin").agg(F.sum("n").alias("m")).withColumn("skip", F.coalesce(F.sum("m").over(by_bin.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*group, "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells.withColumn("inside", inside).join(skipped, [*group, "bin"]).withColumn("below", (F.col("inside") + F.col("skip")).cast("long")).drop("inside", "skip", "bin", "n")


def _first_ranks(rows: DataFrame) -> DataFrame:
    """(.., r): 1 plus the number of lines with a smaller id."""
    ids = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    placed = _running(ids, [], [F.col("h1"), F.col("h2")], F.shiftright("h1", 52)).withColumn("r", F.col("below") + 1).drop("below")
    return rows.join(placed, ["h1", "h2"])


def _doubled(ranks: DataFrame, k: int, n_rows: int) -> DataFrame:
    """ranks(doc_id, th, pos, r) by the first k lines, by the first 2k lines; past the end of a stretch is rank 0."""
    second = ranks.select(*KEY, (F.col("pos") - k).alias("pos"), F.col("r").alias("s"))
    both = ranks.join(second, [*KEY, "pos"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    pairs = both.groupBy("r", "s").agg(F.count("*").alias("n"))
    bin_ = F.floor(F.col("s") * BINS / F.lit(n_rows + 1)).cast("int")
    placed = _running(pairs, ["r"], [F.col("s")], bin_)
    return both.join(placed, ["r", "s"]).select(*KEY, "pos", (F.col("r") + F.col("below")).alias("r"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, pos): every line that lies in a later copy of a run of at least min_words words. th: hash of the text."""
    return _repeated(docs, min_words).withColumn("doc_id", F.nullif("doc_id", F.lit(LACKING)))


def _repeated(docs: DataFrame, min_words: int, finish: bool = False) -> DataFrame:
    """repeated_lines() with LACKING for null ids. finish: go on doubling until no rank changes, which deletes nothing more."""
    lines = stored(_lines(docs).distinct(), "lines")
    n_lines = lines.count()
    rows = stored(_islands(lines, n_lines, min_words), "islands", n_lines)
    n_rows = rows.count()
    runs = stored(_runs(rows, min_words), "runs", 2 * n_rows)
    longest = runs.agg(F.max("length")).first()[0] or 0
    ranks = stored(_first_ranks(rows).select(*KEY, "pos", "r"), "ranks", n_rows)
    named, k, was = None, 1, -1
    while k <= longest or finish:
        mine = runs.where((F.col("length") >= k) & (F.col("length") < 2 * k))
        head = mine.join(ranks.withColumnRenamed("r", "a"), [*KEY, "pos"])
        tail = ranks.select(*KEY, (F.col("pos") + k).alias("end"), F.col("r").alias("b"))
        part = stored(head.join(tail, [*KEY, "end"]).select(*KEY, "pos", "end", "length", "a", "b"), "intervals", 2 * n_rows)
        named = part if named is None else named.unionByName(part)
        if finish and k > longest:
            now = ranks.select("r").distinct().count()
            if now == was:
                break
            was = now
        if 2 * k <= longest or finish:
            old, ranks = ranks, stored(_doubled(ranks, k, n_rows), "ranks", n_rows)
            dropped(old)
        k *= 2
    if named is None:
        return lines.where("false").select(*KEY, "pos")
    place = F.struct(*KEY, "pos")
    intervals = stored(named.groupBy("length", "a", "b").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("length", "a", "b", "first"), "intervals", n_rows)
    later = named.join(intervals, ["length", "a", "b"]).where(place > F.col("first"))
    return later.select(*KEY, F.explode(F.sequence("pos", F.col("end") - 1)).alias("pos")).distinct()


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with shortened text, and n_lines and n_deleted, in every row.

    Runs may overlap and may lie in one document; the first copy, by doc_id (nulls first) and line, stays. Rows that repeat
    an id and a text, null ids too, are one document and get the same result. A null text stays null, with 0 lines; a text
    that is all later copies becomes empty, an empty one stays so, and an empty table too. Lines end at line feeds only.
    Columns n_lines and n_deleted are replaced; all others stay, whatever their names.
    """
    # Merged at every size, so that the plan does not change as the marks grow.
    gone = stored(_repeated(docs, min_words).groupBy(*KEY).agg(F.collect_set("pos").alias("_gone")).withColumnRenamed("doc_id", "id"), "gone")
    # The rows travel as one struct, so that no column of theirs clashes.
    own = docs.select(F.struct(*docs.columns).alias("d")).select("d", F.xxhash64("d.text").alias("th"), _id("d.doc_id").alias("id"))
    joined = own.join(gone.hint("merge"), ["id", "th"], "left")
    lines = F.split("d.text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    whole = F.col("_gone").isNull()
    text = F.when(whole, F.col("d.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n"))
    n_lines = F.when(F.col("d.text").isNull(), 0).otherwise(F.size(lines))
    n_deleted = F.when(whole, 0).otherwise(F.size("_gone"))
    others = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in others], n_lines.cast("long").alias("n_lines"), n_deleted.cast("long").alias("n_deleted"))


SQL = f"""
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
        FROM documents WHERE text IS NOT NULL
    ), c AS (
        SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM l
    ), b AS (
        SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM c
    ), p AS (
        SELECT s.doc_id, s.pos, t.pos AS stop FROM b s JOIN b t ON s.doc_id = t.doc_id AND t.pos >= s.pos AND t.upto - s.upto + s.w >= {MIN_WORDS}
    ), e AS (
        SELECT doc_id, pos, min(stop) AS stop FROM p GROUP BY doc_id, pos UNION SELECT doc_id, max(pos), stop FROM p GROUP BY doc_id, stop
    ), r AS (
        SELECT e.doc_id, e.pos, e.stop, string_agg(b.line, chr(10) ORDER BY b.pos) AS run
        FROM e JOIN b ON e.doc_id = b.doc_id AND b.pos BETWEEN e.pos AND e.stop GROUP BY ALL
    ), f AS (
        SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM r
    ), gone AS (
        SELECT DISTINCT b.doc_id, b.pos FROM f JOIN b ON f.nth > 1 AND b.doc_id = f.doc_id AND b.pos BETWEEN f.pos AND f.stop
    ), kept AS (
        SELECT b.doc_id, count(*) AS n_lines, count(gone.pos) AS n_deleted, string_agg(b.line, chr(10) ORDER BY b.pos) FILTER (gone.pos IS NULL) AS text
        FROM b LEFT JOIN gone ON b.doc_id = gone.doc_id AND b.pos = gone.pos GROUP BY b.doc_id
    )
    SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted,
        CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
    FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
