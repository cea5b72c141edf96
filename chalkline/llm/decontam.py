"""Benchmark decontamination by latent semantic retrieval, then subsequence and answer checks.

Words are hashed into features; a passage is a run of WINDOW words, and its TF-IDF weights take document frequencies from
the whole corpus. A distributed randomised SVD of the benchmark's passages gives a latent space: each task multiplies its
passages with the current basis and back, so that only features times rank numbers leave it. (An SVD of the corpus' own
passages was tried: its leading directions are common words, and 94 of 100 unrelated passages had a cosine above 0.8 with
some item. The benchmark's passages span what has to be found.) An item of more than two windows is cut into passages of a
window, so that a window of a copy is like one of them however long the item is. Benchmarks of any size are taken in groups
of GROUP such passages, each with its own space. Passages have unit length there, so that short ones weigh as much as long
ones, and the space keeps the leading directions, as many as it takes for every passage to keep the share KEEP of its length.

Every overlapping window of every document is projected into each space, in one pass over the corpus for SPACES of them;
windows with a cosine of at least CANDIDATE to a passage are candidates: the product of their places in the space over the
length of the window's whole vector, scaled so that a passage's own cosine is 1. What confirms a candidate: the longest common subsequence of the item and the
words around the window covers EXACT of the item; or PARAPHRASE of it, and the words around hold most words of the item's
answer as well.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
SIZE = 1 << BITS
WINDOW, STRIDE = 32, 16  # words; a window is two strides
CHUNK = 1 << 12  # words projected at a time, a multiple of STRIDE
GROUP, POWERS = 256, 2  # passages of the benchmark with one space
SPACES = 16  # of a pass over the corpus; a space has at most GROUP times a passage's features times GROUP numbers of four bytes
KEEP = 0.7  # share of its length that every passage keeps in its space
CANDIDATE, EXACT, PARAPHRASE, ANSWER = 0.3, 0.6, 0.5, 0.8
_CUT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; every ASCII character other than letters and digits parts them."""
    return (text or "").lower().encode("utf-8", "replace").translate(_CUT).split()


def features_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) >> (32 - BITS)


def passages_of(words: list[bytes]) -> list[list[bytes]]:
    """What of an item is searched for: the item, or its runs of WINDOW words, the last of which ends with it."""
    if len(words) <= 2 * WINDOW:
        return [words]
    return [words[i : i + WINDOW] for i in [*range(0, len(words) - WINDOW, WINDOW), len(words) - WINDOW]]


def answer_of(text: str | None) -> list[bytes]:
    """The words of an item's answer: of its last sentence that has any, if the benchmark names no answer."""
    return next((w for s in reversed(_SENTENCE.split(text or "")) if (w := words_of(s))), [])


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a machine word of a at a time."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@dataclass
class Space:
    """A group of items in a latent space."""

    items: list[tuple[int, list[bytes], list[bytes]]]  # id, words, words of the answer
    row: np.ndarray  # by feature: its row of weight; features outside the items share the last one, which is zero
    weight: np.ndarray  # by feature and passage: idf times the product of their latent directions
    item: np.ndarray  # by passage: the place of its item
    rank: int

    def candidates(self, feature: np.ndarray, norm: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(item, first word, cosine) of the windows of a text; norm: the length of each."""
        for start in range(0, max(1, len(feature) - STRIDE), CHUNK):
            part = feature[start : start + CHUNK + STRIDE]
            lacking = -len(part) % STRIDE  # the last block is filled up with features that weigh nothing
            row = np.concatenate([self.row[part], np.full(lacking, len(self.weight) - 1)])
            block = self.weight[row].reshape(-1, STRIDE, self.weight.shape[1]).sum(axis=1)
            if len(block) > 1:
                block = block[:-1] + block[1:]
            score = block / norm[start // STRIDE : start // STRIDE + len(block), None]
            for w, i in np.argwhere(score >= CANDIDATE).tolist():
                yield int(self.item[i]), start + w * STRIDE, float(score[w, i])

    def matches(self, words: list[bytes], feature: np.ndarray, norm: np.ndarray) -> list[tuple[int, float, float, bool]]:
        """(item_id, cosine, share of the subsequence, answer found) of every confirmed item, at its best place.

        The best place is the confirmed one of the largest cosine, so places are tried from the largest on.
        """
        places: dict[tuple[int, int], float] = {}
        for i, at, cosine in self.candidates(feature, norm):
            places[i, at] = max(cosine, places.get((i, at), 0.0))
        best: dict[int, tuple[float, float, bool]] = {}
        for (i, at), cosine in sorted(places.items(), key=lambda x: (-x[1], x[0])):
            if i in best:
                continue
            _, item, answer = self.items[i]
            around = words[max(0, at - len(item)) : at + WINDOW + len(item)]
            held = set(around)
            if sum(w in held for w in item) < PARAPHRASE * len(item):
                continue  # no subsequence can be as long
            share = common_subsequence(item, around) / len(item)
            found = bool(answer) and sum(w in held for w in answer) >= ANSWER * len(answer)
            if share >= EXACT or share >= PARAPHRASE and found:
                best[i] = (min(1.0, cosine), share, found)
        return [(self.items[i][0], *x) for i, x in sorted(best.items())]


def window_norms(feature: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The length of the TF-IDF vector of each window: a word that a window holds n times counts n squared times."""
    n = max(1, -(-(len(feature) - STRIDE) // STRIDE))
    padded = np.full((n + 1) * STRIDE, SIZE, np.int64)
    padded[: len(feature)] = feature
    out, weight = np.empty(n), np.append(np.square(idf), 0.0)
    for s in range(0, n, CHUNK):
        rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[s * STRIDE : (min(n, s + CHUNK) - 1) * STRIDE + 1 : STRIDE]
        rows = np.sort(rows, axis=1)
        first = np.ones(rows.shape, bool)
        first[:, 1:] = rows[:, 1:] != rows[:, :-1]
        at = np.flatnonzero(first)
        times = np.diff(np.append(at, rows.size))
        out[s : s + len(rows)] = np.bincount(at // WINDOW, times * times * weight[rows.ravel()[at]], minlength=len(rows))
    return np.sqrt(np.maximum(out, 1e-12))


@dataclass
class Index:
    """Spaces that one pass over the corpus looks into."""

    idf: np.ndarray
    spaces: list[Space]

    def matches(self, text: str | None) -> list[tuple[int, float, float, bool]]:
        words = words_of(text)
        if not words:
            return []
        feature = features_of(words)
        norm = window_norms(feature, self.idf)
        return [m for space in self.spaces for m in space.matches(words, feature, norm)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, texts = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for t in batch.column(0):
            counts[np.unique(features_of(words_of(t.as_py())))] += 1
            texts += 1
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at]), pa.int32()), pa.array(np.concatenate([[texts], counts[at]]), pa.int64())], ["feature", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """By feature, log of all documents over those that hold it."""
    found, texts = np.zeros(SIZE), 0
    for r in docs.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        if r["feature"] < 0:
            texts = r["n"]
        else:
            found[r["feature"]] = r["n"]
    return np.log((texts + 2) / (found + 1))


def randomised_svd(passages: DataFrame, idf, columns: np.ndarray, rank: int, powers: int = POWERS) -> np.ndarray:
    """The leading right singular vectors, by column, of the TF-IDF matrix of passages(text), whose rows have unit length.

    columns: the features that have a column. Each round is a pass in which every task returns its part of A'(AQ), which
    has as many numbers as columns times rank; the parts are added up on the executors, in slices.
    """
    spark = passages.sparkSession
    place = np.full(SIZE, -1)
    place[columns] = np.arange(len(columns))
    rank = min(rank, len(columns))
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((len(columns), rank)))[0]
    for _ in range(powers + 1):
        sent = spark.sparkContext.broadcast((idf, place, q))

        def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, where, basis = sent.value
            out = np.zeros(basis.shape)
            for batch in batches:
                for t in batch.column(0):
                    x = features_of(words_of(t.as_py()))
                    at, n = np.unique(where[x], return_counts=True)
                    at, n = at[at >= 0], n[at >= 0]
                    a = n * weight[columns[at]]
                    a = a / max(np.sqrt(a @ a), 1e-12)
                    out[at] += a[:, None] * (a @ basis[at])[None, :]
            rows = np.flatnonzero(out.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(list(out[rows]), pa.list_(pa.float64()))], ["at", "v"])

        z = np.zeros(q.shape)
        summed = passages.select("text").mapInArrow(multiplied, "at int, v array<double>").select("at", F.posexplode("v").alias("j", "x")).groupBy("at", "j").agg(F.sum("x").alias("x")).toArrow()
        z[summed["at"].to_numpy(), summed["j"].to_numpy()] = summed["x"].to_numpy()
        q = np.linalg.qr(z + 1e-12 * q)[0]
    return q


def _space(items: list, passages: DataFrame, idf: np.ndarray) -> Space:
    cut = [(i, features_of(x)) for i, (_, words, _) in enumerate(items) for x in passages_of(words)]
    columns = np.unique(np.concatenate([x for _, x in cut]))
    basis = randomised_svd(passages, idf, columns, len(cut))
    row = np.full(SIZE, len(columns))
    row[columns] = np.arange(len(columns))
    own = np.zeros((len(cut), len(columns)))
    for p, (_, x) in enumerate(cut):
        np.add.at(own[p], row[x], idf[x])
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    left, value, right = np.linalg.svd(own @ basis, full_matrices=False)  # at most GROUP by GROUP
    kept = np.sqrt(np.cumsum(np.square(left * value), axis=1)).min(axis=0)  # by rank: the least length that a passage keeps
    rank = int(min(np.searchsorted(kept, KEEP) + 1, len(value)))
    basis = basis @ right[:rank].T
    latent = own @ basis
    latent /= np.maximum(np.square(latent).sum(axis=1, keepdims=True), 1e-12)  # so that a passage's own vector has cosine 1
    weight = np.vstack([basis * idf[columns][:, None], np.zeros(rank)]) @ latent.T
    return Space(items, row.astype(np.int32), weight.astype(np.float32), np.array([i for i, _ in cut]), rank)


def _match(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("subsequence", pa.float64()), ("answer_found", pa.bool_())])
    for batch in batches:
        out = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in index.value.matches(t.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)


def _indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """Broadcast indexes that together hold every item."""
    spark, answer = docs.sparkSession, "answer" in benchmark.columns
    asked = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text", *["answer"] * answer)
    idf, spaces, group, held = None, [], [], 0

    def space(rows: list) -> Space:
        items = [(r.item_id, words_of(r.text), words_of(r.answer) if answer and r.answer else answer_of(r.text)) for r in rows]
        cut = [(b" ".join(x).decode("utf-8", "replace"),) for _, words, _ in items for x in passages_of(words)]
        return _space(items, spark.createDataFrame(cut, "text string"), idf)

    for r in asked.orderBy("item_id").toLocalIterator():
        if not (n := len(passages_of(words)) if (words := words_of(r.text)) else 0):
            continue
        idf = inverse_frequencies(docs) if idf is None else idf
        if group and held + n > GROUP:
            spaces.append(space(group))
            group, held = [], 0
            if len(spaces) == SPACES:
                yield spark.sparkContext.broadcast(Index(idf, spaces))
                spaces = []
        group.append(r)
        held += n
    if group:
        yield spark.sparkContext.broadcast(Index(idf, [*spaces, space(group)]))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, subsequence, answer_found): every item that a document holds, at its best place.

    docs(doc_id, text), benchmark(item_id, text, and answer if there is one). Null and wordless texts and items hold and
    are nothing; an item that repeats an id is an item by itself. An empty benchmark gives no rows. Null ids and repeated
    documents give rows like others; other columns are not read. The benchmark passes through the driver item by item, and
    the corpus is read once for the document frequencies and once for each SPACES * GROUP passages.
    """
    kind = "doc_id long, item_id long, cosine double, subsequence double, answer_found boolean"
    out = docs.sparkSession.createDataFrame([], kind)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    for sent in _indexes(docs, benchmark):
        out = out.union(docs.mapInArrow(lambda it, sent=sent: _match(it, sent), kind))
    return out


def _clean(batches: Iterator[pa.RecordBatch], index, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([not index.value.matches(t.as_py()) for t in batch.column(at)], pa.bool_()))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold an item; rows are judged one by one, with null ids as with others.

    Null and wordless texts stay, all columns stay as they are, and an empty benchmark leaves docs whole.
    """
    out, at = docs, docs.columns.index("text")
    for sent in _indexes(docs, benchmark):
        out = out.mapInArrow(lambda it, sent=sent: _clean(it, sent, at), docs.schema)
    return out
