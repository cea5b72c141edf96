"""A training-corpus pipeline over the documents table: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from chalkline.llm import bpe, decontam, linededup, simhash, toxicity
from chalkline.llm.common import shared_dir, table, workspace
from chalkline.plans.scratch import delete

TOXIC = 0.5  # documents that score as much go


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC or more go. Null texts and ids are scored like others."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where(F.col("toxic_score") < TOXIC).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go; a document that is nothing but later copies goes too. n_chars follows the text."""
    left = linededup.without_repeats(docs).where("n_deleted = 0 or n_deleted < n_lines")
    n_chars = F.when(F.col("n_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link the one of the smallest id stays; null ids stay. Links are SimHash fingerprints that differ in 4
    or fewer bits, as in op1_simhash, confirmed by the 5-word shingles; beside them, 5-word shingles of similarity 0.8."""
    return simhash.deduplicated(docs, k=5, similarity=0.8, radius=4)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; null and wordless texts stay."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, counted and hashed, and the hash of what they decode to; a null text counts as empty."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]

#: No SQL says what the trained and hashed stages do; tests/llm/test_pipeline.py holds the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's table is deleted when the next one is written, and so are the tables
    between the steps of a stage; the last table is the result and stays."""
    top, docs, old = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{top}/{name}"
        with workspace(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if old:
            delete(spark, old)
        old, docs = path, spark.read.parquet(path)
    return docs
