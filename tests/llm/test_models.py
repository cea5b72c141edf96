"""The trained operators against models written out in plain Python, and what they may not read."""

import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chalkline.llm import bpe, langid, quality, toxicity
from chalkline.llm.common import BATCH, fold, kept, likely


def _corpus(seed, n=240):
    draw = random.Random(seed)
    word = [f"w{chr(97 + i)}" for i in range(26)]
    docs, labels = [], []
    for i in range(n):
        y = int(draw.random() < 0.4)
        own = [draw.choice(word[: 6 + draw.randrange(20)]) for _ in range(draw.randrange(5, 40))] + ["vile", "rude"] * (y and draw.random() < 0.9)
        draw.shuffle(own)
        docs.append((i, " ".join([*own, "rare" + "abcdefghij"[i % 10] * (i % 7)])))
        if i % 6:
            labels.append((i, y, y))
    return docs, labels


@pytest.mark.parametrize("seed", [0, 1])
def test_toxicity_is_two_kneser_ney_models(spark, monkeypatch, seed):
    monkeypatch.setattr(toxicity, "D_PAIR", (2.0, 0.01))
    monkeypatch.setattr(toxicity, "D_WORD", (1.5, 0.001))
    rows, marks = _corpus(seed)
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    known = docs.join(labels, "doc_id").where(fold(F.col("doc_id"), 5) != 0).where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(toxicity.FIT_PARTS)) != 0)
    texts = {y: [toxicity.tokens(r.text) for r in known.where(F.col("toxic") == y).collect()] for y in (0, 1)}
    shared = Counter(w for _, t in rows for w in toxicity.tokens(t))
    pairs = {y: Counter(p for t in texts[y] for p in set(zip(["", *t], t, strict=False))) for y in texts}
    kinds = {y: Counter(w for _, w in pairs[y]) for y in texts}
    least = max(1.5, 0.001 * min(map(len, texts.values())))
    free = max(sum(min(k, least) for k in kinds[y].values()) / sum(kinds[y].values()) for y in texts)

    def discount(y):
        low, high = 0.0, float(max(kinds[y].values()))
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(k, mid) for k in kinds[y].values()) < free * sum(kinds[y].values()) else (low, mid)
        return high

    def chance(y):
        d, dp, total = discount(y), max(2.0, 0.01 * len(texts[y])), sum(kinds[y].values())
        context, left = Counter(), Counter()
        for (v, _), n in pairs[y].items():
            context[v] += n
            left[v] += min(n, dp)
        one = lambda w: max(kinds[y][w] - d, 0) / total + free * shared[w] / sum(shared.values())
        return lambda v, w: max(pairs[y][v, w] - dp, 0) / context[v] + left[v] / context[v] * one(w) if context[v] else one(w)

    p = [chance(0), chance(1)]
    for y in (0, 1):
        for v in ["", "wa", "vile", "never seen", *list(shared)[:8]]:
            assert sum(p[y](v, w) for w in shared) == pytest.approx(1.0, abs=1e-9)
    half = toxicity.POOLED / 2
    for _, text in rows[::7]:
        words = toxicity.tokens(text)
        want = []
        for v, w in zip(["", *words], words, strict=False):
            a, b = p[0](v, w), p[1](v, w)
            want.append(math.log((1 - half) * b + half * a) - math.log((1 - half) * a + half * b))
        assert np.allclose(model.gains(words), want, atol=1e-9)
    assert len(model.pair) and model.gains(["unheard", "of"])[1] == 0


def test_held_out_texts_change_no_other_language(spark):
    draw = random.Random(4)
    say = {"xx": "abcdef", "yy": "ghijkl", "zz": "abcghi"}
    rows = [(i, " ".join("".join(draw.choice(say[lang]) for _ in range(5)) for _ in range(12)), lang) for i, lang in enumerate(draw.choice(list(say)) for _ in range(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = docs.withColumn("text", F.when(fold(F.col("doc_id"), 4) == 2, F.concat(F.lit("qqq "), F.reverse("text"))).otherwise(F.col("text"))).withColumn("lang", F.when(fold(F.col("doc_id"), 4) == 2, "new").otherwise(F.col("lang")))
    one, two = langid.fit(docs), langid.fit(other)
    assert one.languages == two.languages == ["xx", "yy", "zz"] and np.array_equal(one.weights, two.weights) and np.array_equal(one.idf, two.idf) and one.temperature == two.temperature
    got = langid.predicted(docs, one).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_many_languages_are_all_classes(spark):
    rows = [(i, f"text {chr(0x400 + i % 600)} {chr(0x400 + i % 600)}{chr(0x400 + i % 600)}", f"l{i % 600:03}") for i in range(2400)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 600


@pytest.mark.parametrize("extra", [-3, -2, -1, 0, 1])
def test_every_n_gram_counts_at_the_end_of_a_chunk(monkeypatch, extra):
    monkeypatch.setattr(langid, "CHUNK", 64)
    text = "".join(random.Random(extra).choice("abc déf") for _ in range(3 * 64 + extra))
    padded = f" {text} "
    assert langid._features(text)[1].sum() == sum(len(padded) - n + 1 for n in (1, 2, 3))
    at, n = langid._features(text)
    monkeypatch.setattr(langid, "CHUNK", 1 << 18)
    whole = langid._features(text)
    assert np.array_equal(at, whole[0]) and np.array_equal(n, whole[1])


def test_gradient_steps_are_the_written_out_ones():
    draw = np.random.default_rng(3)
    rows = [(np.sort(draw.choice(50, 6, replace=False)), draw.normal(0, 0.4, 6)) for _ in range(40)]
    y = draw.integers(0, 3, 40)
    z, n = np.zeros((51, 3)), np.zeros((51, 3))
    order = np.random.default_rng(0)
    for _ in range(2):
        for i in order.permutation(40):
            x = np.zeros(51)
            x[rows[i][0]], x[50] = rows[i][1], 1.0
            w = np.where(np.abs(z) <= langid.L1, 0, -(z - np.sign(z) * langid.L1) / ((langid.BETA + np.sqrt(n)) / langid.ALPHA + langid.L2))
            e = np.exp(x @ w - (x @ w).max())
            g = np.outer(x, e / e.sum() - np.eye(3)[y[i]])
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / langid.ALPHA * w
            n += g * g
    want = np.where(np.abs(z) <= langid.L1, 0, -(z - np.sign(z) * langid.L1) / ((langid.BETA + np.sqrt(n)) / langid.ALPHA + langid.L2))
    got = langid.train([(at, x) for at, x in rows], y, 3, rounds=2)
    assert np.allclose(got[:50], want[:50], atol=1e-4) and np.allclose(got[-1], want[50], atol=1e-4)


def test_quality_reads_whole_words_and_no_held_out_label(spark):
    long = "a1" * 40
    assert not np.array_equal(quality.indicators(long), quality.indicators(long[:12]))
    rows, marks = _corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    flipped = labels.withColumn("quality", F.when(fold(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.array_equal(one.weights, two.weights) and one.curve == two.curve


def test_toxicity_counts_every_labelled_row(spark, monkeypatch):
    """The model's counts come from all labelled rows, also from more than the 6,000 of a class that a sample had."""
    docs = spark.range(17000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    seen, own = {}, toxicity.stored

    def stored(df, label, rows=None):
        out = own(df, label, rows)
        seen[label] = out.count()
        return out

    monkeypatch.setattr(toxicity, "stored", stored)
    toxicity.fit(docs, labels)
    assert seen["toxic"] == docs.where(fold(F.col("doc_id"), 5) != 0).count() > 12000


def test_toxicity_counts_in_turns(spark, monkeypatch):
    """Word pairs are written a part at a time, each part deleted before the next: no table holds them all."""
    rows, marks = _corpus(3)
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    sizes, live, own, gone = [], [], toxicity.stored, toxicity.dropped

    def stored(df, label, rows=None):
        out = own(df, label, rows)
        if label == "pairs":
            assert not live
            live.append(out._chalkline_path)
            sizes.append(out.count())
        return out

    monkeypatch.setattr(toxicity, "stored", stored)
    monkeypatch.setattr(toxicity, "dropped", lambda df: (live.remove(df._chalkline_path), gone(df)))
    toxicity.fit(docs, labels)
    assert not live and len(sizes) == toxicity.TURNS and max(sizes) < 0.8 * sum(sizes)


def test_few_texts_move_to_meet_their_labels(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    ids = spark.range(0, 20_000, 40).select(F.col("id").alias("doc_id"))
    met = likely(docs, ids)
    assert met.columns == docs.columns and met.join(ids, "doc_id").count() == 500 and met.count() < 5_000
    assert likely(docs, ids.limit(0)).count() == 0
    assert likely(docs, ids.select(F.col("doc_id").cast("string"))).count() == 20_000  # hashes of another type can't be compared
    nulls = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert likely(nulls, ids).join(ids, "doc_id").count() == 0


def test_the_shuffles_of_a_stored_table_go_with_its_writing(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffles():
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    before, was = shuffles(), spark.conf.get(name)
    toxicity.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    end = time.time() + 20
    while shuffles() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffles() - before and spark.conf.get(name) == was


class _Sent:
    def __init__(self, value):
        self.value = value


def test_toxicity_returns_a_few_texts_at_a_time():
    model = toxicity.Model({"vile": 2}, np.array([0.0, 0.0, 3.0]), np.zeros(3), np.empty(0, np.int64), np.empty(0), np.array([1.0, 1.0, 1.0, -2.0]))
    texts = [None, "", *["a vile text", "a text"] * 500]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    parts = list(toxicity._score(iter([rows, rows.slice(0, 0)]), _Sent(model), 1))
    assert max(p.num_rows for p in parts) <= BATCH
    out = pa.Table.from_batches(parts).to_pydict()
    assert out == {"doc_id": list(range(len(texts))), "text": texts, "toxic_score": [model.score(t) for t in texts]}


def test_a_worker_lets_go_of_the_pieces_when_another_operator_begins():
    ranks = _Sent(bpe.Vocabulary({bytes([i]): i for i in range(256)}, "bytes"))
    codec = bpe._codec(ranks, r"\w+")
    assert bpe._codec(ranks, r"\w+") is codec and bpe._codec(ranks, r"\S+") is not codec and len(kept("bpe")) == 1
    list(toxicity._count_shared(iter([])))
    assert not kept("bpe")
