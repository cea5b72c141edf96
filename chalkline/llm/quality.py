"""Quality by naive Bayes support vectors.

A text's features are indicators of hashed n-grams: words, and runs of one to three word shapes (letters by case, digits,
marks; a word that repeats the one before has a shape of its own). Each indicator is scaled by the log ratio of its counts
in the two classes, smoothed by one; a linear hinge-loss model over the scaled indicators, of unit length for each text, is
fitted by dual coordinate descent. A logistic curve over the margin, fitted on rows the model hasn't seen, gives the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import labelled

BITS = 18
SIZE = 1 << BITS
MAX_ROWS = 3000  # labelled rows of each class that the model is fitted on
C, ROUNDS = 1.0, 20  # of the hinge loss; passes over the rows
SHARE = 0.25  # how far the fitted weights move away from the class ratios, as is usual for this model
FIT_PARTS = 4
LONG_SHAPE = 12  # marks; a longer shape is told by its kinds of characters and the magnitude of its length
_SHAPES = ((re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[0-9]+"), "0"))


class _Words(dict):
    """(hash of the word, hash of its shape), kept for a bounded number of words."""

    def __missing__(self, word: str) -> tuple[int, int]:
        shape = word
        for pattern, mark in _SHAPES:
            shape = pattern.sub(mark, shape)
        if len(shape) > LONG_SHAPE:  # what kinds of characters there are, and about how many
            shape = f"{''.join(sorted(set(shape)))}{len(shape).bit_length()}"
        found = zlib.crc32(word.encode("utf-8", "replace")), zlib.crc32(shape.encode("utf-8", "replace"))
        if len(self) > 200_000:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


_WORDS = _Words()


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


def indicators(text: str | None) -> np.ndarray:
    """The features of the whole text, ascending; none for a text without words."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64)
    both = np.fromiter((x for w in words for x in _WORDS[w]), np.uint64, 2 * len(words)).reshape(-1, 2)
    word, shape = both[:, 0], both[:, 1].copy()
    shape[1:][word[1:] == word[:-1]] = 1
    two = shape[:-1] * np.uint64(31) + shape[1:]
    three = two[:-1] * np.uint64(31) + shape[2:] if len(shape) > 2 else two[:0]
    seen = np.zeros(SIZE, bool)
    for salt, x in enumerate((word, shape, two, three), 1):
        seen[_mixed(x, salt).astype(np.int64)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    weights: np.ndarray
    curve: tuple[float, float]

    def margin(self, text: str | None) -> float:
        at = indicators(text)
        return float(self.weights[at].sum() / np.sqrt(len(at))) if len(at) else 0.0

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] * self.margin(text) + self.curve[1], -40, 40))))


def log_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.ones((2, SIZE))
    for at, label in zip(rows, y, strict=True):
        counts[label, at] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = C, rounds: int = ROUNDS) -> np.ndarray:
    """Weights over the scaled indicators by dual coordinate descent for the hinge loss; the classes weigh the same."""
    sign = np.where(y == 1, 1.0, -1.0)
    each = {s: cost * len(y) / (2 * max(1, int((sign == s).sum()))) for s in (1.0, -1.0)}
    x = [ratio[at] / np.sqrt(max(1, len(at))) for at in rows]
    norm = np.array([float(v @ v) for v in x])
    alpha, w, random = np.zeros(len(y)), np.zeros(SIZE), np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(y)):
            if norm[i] <= 0:
                continue
            gradient = sign[i] * float(w[rows[i]] @ x[i]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), each[sign[i]])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * sign[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * margin * margin).sum() + 1e-2, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, [((y - p) * margin).sum() - 1e-2 * a, (y - p).sum()]), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their features, so that what the fit gathers doesn't grow with the length of texts."""
    for batch in batches:
        found = [indicators(t.as_py()).astype("<i4").tobytes() for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], ["doc_id", "y", "part", "features"])


def _fit_rows(pdf: pd.DataFrame) -> tuple[np.ndarray, tuple[float, float]]:
    rows = [np.frombuffer(x, "<i4") for x in pdf["features"]]
    y, own = pdf["y"].to_numpy(), pdf["part"].to_numpy() != 0
    if len(set(y[own])) < 2:
        one = float(y.mean()) if len(y) else 0.0
        return np.zeros(SIZE), (1.0, float(np.clip(np.log((one + 1e-9) / (1 - one + 1e-9)), -20, 20)))
    train = [r for r, o in zip(rows, own, strict=True) if o]
    ratio = log_ratios(train, y[own])
    fine = dual_descent(train, y[own], ratio)
    full = ratio * ((1 - SHARE) * np.abs(fine).mean() + SHARE * fine)
    scale = np.abs([full[r].sum() / np.sqrt(max(1, len(r))) for r in train]).mean() or 1.0
    full = full / scale
    held = [i for i in range(len(y)) if not own[i]]
    if len(set(y[held])) < 2:
        return full, (2.0, 0.0)
    return full, _curve(np.array([full[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) for i in held]), y[held].astype(float))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The model of docs(doc_id, text, ...) and labels(doc_id, quality, ...) outside the held-out fold.

    At most max_rows labelled rows of each class take part, in one task, which also bounds the memory of the fit; the
    driver gets the weights. Without rows of both classes all texts score by the share of label 1, 0 if there are none.
    """
    rows = labelled(docs, labels, "quality", max_rows).withColumn("part", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(FIT_PARTS)).cast("int"))

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        weights, (a, b) = _fit_rows(pdf.sort_values("doc_id"))
        return pd.DataFrame({"weights": [weights.astype("<f4").tobytes()], "a": [a], "b": [b]})

    rows = rows.select(F.col("doc_id").cast("long"), "y", "part", "text").mapInArrow(_featured, "doc_id long, y int, part int, features binary")
    found = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(task, "weights binary, a double, b double").first()
    return Model(np.frombuffer(found.weights, "<f4").astype(np.float64), (found.a, found.b)) if found else Model(np.zeros(SIZE), (1.0, -20.0))


def _score(batches: Iterator[pa.RecordBatch], model, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [model.value.score(t.as_py()) for t in batch.column(at)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "quality_score"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with quality_score, from 0 to 1, in every row, in place of a column of that name.

    A null or empty text has the score of a text without features. Null ids and repeated rows are scored like others; an
    empty table stays empty.
    """
    docs = docs.drop("quality_score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _score(it, sent, at), StructType([*docs.schema.fields]).add("quality_score", DoubleType()))
