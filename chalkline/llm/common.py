"""What the corpus operators share: tables, the shared scratch folder and text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chalkline.plans.scratch import dropped, shared_dir, stored, workspace

__all__ = ["BATCH", "SPARE", "by_chance", "class_of", "dropped", "fold", "kept", "labelled", "shared_dir", "stored", "table", "workspace"]

BATCH = 256  # rows that a Python operator returns at a time

_KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What this worker keeps of one operator's tasks for its next ones; what it kept of other operators goes."""
    if operator not in _KEPT:
        _KEPT.clear()
        _KEPT[operator] = {}
    return _KEPT[operator]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the held-out split of the contracts. A null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def class_of(labels: DataFrame, label: str, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, y) of the labelled ids outside the held-out fold; where an id has several labels, the largest counts."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    return own.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))


SPARE = 4  # so many times the rows of a sample are let through, by a hash of their ids, to the sort that picks it


def by_chance(rate: Column, *columns: str) -> Column:
    """About this share of the rows, told by a hash of some columns."""
    return F.pmod(F.xxhash64(F.lit("chance"), *columns), F.lit(1 << 30)) < rate * (1 << 30)


ID_BITS, MOST_BITS = 16, 1 << 28  # bits for each id of a map, and of a map at most


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids, and few others: those whose hash has a bit in a map of the ids' hashes.

    The map is broadcast, two bytes an id and MOST_BITS at most, so that few texts are shuffled to meet their ids.
    """
    if docs.schema["doc_id"].dataType != ids.schema["doc_id"].dataType:
        return docs
    size = min(MOST_BITS, 1 << max(15, (ID_BITS * ids.count()).bit_length()))
    bit = F.pmod(F.xxhash64(F.lit("likely"), "doc_id"), F.lit(size))
    maps = ids.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("_bits"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    met = docs.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(maps), "_bucket")
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(docs.columns)


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int | None, *, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, y, text) of a bounded sample of the labelled rows outside the held-out fold; of all of them without max_rows.

    For each label the ids, max_rows at most, whose hash is smallest, each with one row, that of the smallest hash of its
    text. The sample of ids has at most 2 * max_rows rows of two numbers, and so it is broadcast; no more than its texts are
    shuffled, by id. Where classes are large, most ids are left out by chance before they are sorted.
    """
    ids = class_of(labels, label, folds, held_out)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    if max_rows is None:
        return likely(docs.select("doc_id", "text"), ids).join(ids, "doc_id").select("doc_id", "y", "text").withColumn("place", first).where(F.col("place") == 1).drop("place")
    size = {r.y: r["count"] for r in ids.groupBy("y").count().collect()}
    order = F.xxhash64(F.col("doc_id"))
    parts = [ids.where((F.col("y") == y) & by_chance(F.lit(min(1.0, SPARE * max_rows / max(1, size.get(y, 0)))), "doc_id")).orderBy(order, "doc_id").limit(max_rows) for y in (0, 1)]
    met = docs.select("doc_id", "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id").select("doc_id", "y", "text")
    return met.withColumn("place", first).where(F.col("place") == 1).drop("place")
