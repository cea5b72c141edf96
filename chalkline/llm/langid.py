"""Language identification by sparse multinomial logistic regression over TF-IDF character n-grams.

The n-grams of one to three characters of a text in lower case, padded by a space at either end, are hashed; a weight is
(1 + log count) times the inverse document frequency over all documents outside the held-out fold, and a text has unit
length. The model is trained with follow-the-regularised-leader and elastic-net penalties, which leave most weights at zero;
a temperature, fitted on rows held back from training, calibrates its chances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPARE, by_chance, fold

BITS = 16
SIZE = 1 << BITS
MAX_ROWS, MAX_SAMPLE, LEAST_ROWS = 2000, 40_000, 20  # rows that the model is fitted on: of each language, and in all, but so many of each
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
ROUNDS, FIT_PARTS = 4, 4
UNKNOWN = "und"
CHUNK = 1 << 18  # characters hashed at a time


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of the whole text."""
    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    counts = np.zeros(SIZE, np.int64)
    for i in range(0, len(code), CHUNK):
        x = code[i : i + CHUNK + 2].astype(np.uint32)
        for n in (1, 2, 3):
            if len(x) < n:
                continue
            h = np.full(len(x) - n + 1, 0x811C9DC5 + n, np.uint32)
            for j in range(n):
                h = (h ^ x[j : len(x) - n + 1 + j]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            h = h[: CHUNK]
            counts += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=SIZE)
    at = np.flatnonzero(counts)
    return at, counts[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # by feature and language; the last row is the constant
    temperature: float

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = _features(text)
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / (np.sqrt(x @ x) or 1.0)

    def chances(self, text: str) -> np.ndarray:
        at, x = self.vector(text)
        return _softmax((x @ self.weights[at] + self.weights[-1]) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = self.chances(text)
        return self.languages[int(p.argmax())], float(p.max())


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n): in how many texts of this task a feature is; feature -1 counts the texts."""
    counts, texts = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for t in batch.column(0):
            if (text := t.as_py()) is not None:
                counts[_features(text)[0]] += 1
                texts += 1
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at]), pa.int32()), pa.array(np.concatenate([[texts], counts[at]]), pa.int64())], ["feature", "n"])


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """FTRL-proximal: per-coordinate steps; L1 keeps a weight at zero until its sum of gradients exceeds it, L2 shrinks it."""
    z, n = np.zeros((SIZE + 1, n_classes), np.float32), np.zeros((SIZE + 1, n_classes), np.float32)

    def weights(at) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    random, eye = np.random.default_rng(0), np.eye(n_classes)
    for _ in range(rounds):
        for i in random.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, SIZE), np.append(x, 1.0)
            w = weights(at)
            g = x[:, None] * (_softmax(x @ w) - eye[y[i]])[None, :]
            n_new = n[at] + g * g
            z[at] += g - (np.sqrt(n_new) - np.sqrt(n[at])) / ALPHA * w
            n[at] = n_new
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm."""
    loss = lambda t: -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()
    a, b, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, max_sample: int = MAX_SAMPLE, *, folds: int = 4, held_out: int = 2) -> Model:
    """The model of docs(doc_id, text, lang, ...) outside the held-out fold, of which nothing is read.

    Document frequencies come from all other texts. Every language they name is a class, and of each rows that a hash of the
    id picks fit the weights in one task: max_rows of each, or fewer where max_sample is less than that for all languages,
    but LEAST_ROWS of each. The task holds half a megabyte for each language. Null languages and texts without a letter, and
    null ids, are no training rows; rows that repeat an id and a text are one. Without any
    rows, as in an empty table, the model knows no language and answers `und`.
    """
    spark = docs.sparkSession
    own = docs.where(fold(F.col("doc_id"), folds) != held_out)
    idf, texts = np.zeros(SIZE), 0
    for r in own.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        if r["feature"] < 0:
            texts = r["n"]
        else:
            idf[r["feature"]] = r["n"]
    idf = np.log((1 + texts) / (1 + idf)) + 1
    known = own.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], idf, np.zeros((SIZE + 1, 0)), 1.0)
    least = max(LEAST_ROWS, min(max_rows, max_sample // len(languages)))
    # Most rows of a frequent language are left out by chance before the rest are sorted. The table of rates is as long as the model is wide.
    rates = spark.createDataFrame([(lang, min(1.0, SPARE * least / n)) for lang, n in sizes.items()], "lang string, rate double")
    numbered = known.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("th"))
    tried = numbered.join(F.broadcast(rates), "lang").where(by_chance(F.col("rate"), "doc_id", "th")).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "th"))
    picked = tried.withColumn("place", place).where(F.col("place") <= least).select("doc_id", "lang", "th")
    met = known.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.xxhash64("text").alias("th")).join(F.broadcast(picked), ["doc_id", "lang", "th"])
    rows = met.dropDuplicates(["doc_id", "lang", "th"])
    sent = spark.sparkContext.broadcast(idf)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as their vectors, so that what the fit gathers doesn't grow with the length of texts."""
        model = Model(languages, sent.value, np.zeros(0), 1.0)
        for batch in batches:
            kept = batch.filter(pa.array([has_letter(t.as_py()) for t in batch.column(3)], pa.bool_()))
            both = [model.vector(t.as_py()) for t in kept.column(3)]
            packed = [pa.array([v[i].astype(kind).tobytes() for v in both], pa.binary()) for i, kind in enumerate(("<i4", "<f8"))]
            yield pa.RecordBatch.from_arrays([*kept.columns[:3], *packed], ["doc_id", "lang", "part", "at", "x"])

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        x = [(np.frombuffer(at, "<i4"), np.frombuffer(v, "<f8")) for at, v in zip(pdf["at"], pdf["x"], strict=True)]
        place = {lang: i for i, lang in enumerate(languages)}
        y = np.array([place[v] for v in pdf["lang"]], np.int64)
        held = pdf["part"].to_numpy() == 0
        own = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
        w = train([x[i] for i in own], y[own], len(languages))
        logits = np.array([v @ w[at] + w[-1] for (at, v), h in zip(x, held, strict=True) if h]).reshape(-1, len(languages))
        return pd.DataFrame({"weights": [w.astype("<f4").tobytes()], "t": [temperature(logits, y[held]) if len(logits) else 1.0]})

    parted = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(FIT_PARTS)).cast("int")).select("doc_id", "lang", "part", "text")
    found = parted.mapInArrow(featured, "doc_id long, lang string, part int, at binary, x binary").withColumn("one", F.lit(1)).groupBy("one").applyInPandas(task, "weights binary, t double").first()
    if not found:
        return Model([], idf, np.zeros((SIZE + 1, 0)), 1.0)
    return Model(languages, idf, np.frombuffer(found.weights, "<f4").reshape(SIZE + 1, -1).astype(np.float64), found.t)


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [model.value.predict(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row: the likeliest learned language and its calibrated chance.

    A null text, and one without a letter, is `und` with score 0; so is every text under a model without languages. Null
    ids and repeated rows have a row each; an empty table has none. Ties go to the language that is first by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _predict(it, sent), "doc_id long, lang_pred string, score double")
