"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from chalkline.llm import bpe, decontam, langid, linededup, pii, quality, sharding, simhash, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id long, n int, w int, shard int, score double, toxic_score double, quality_score double, id long, th long, d int, grp string, y int, part int, ids string, n_lines long"
LABELS = "doc_id long, quality int, toxic int, text string, y int"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _rows():
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    texts = [(None, "no id here at all"), (1, None), (2, ""), (3, " \t\n "), (4, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f"), (6, long), (7, "\U0001f600 é\n\n\nx"), (8, "one"), (None, None)]
    texts += [(10 + i, f"plain words number {i} and more of the same kind") for i in range(6)] + [(20 + i, f"!! ## bad idiot {i}") for i in range(6)]
    return [(i, t, "en" if i and i % 2 else None, None, None, *[None] * 16) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(10 + i, 1, 0, "clash", 5) for i in range(6)] + [(20 + i, 0, 1, "clash", 5) for i in range(6)] + [(20, 1, 0, None, None), (None, 1, 1, None, None), (99, None, None, None, None)]
    return spark.createDataFrame(rows, LABELS)


def test_simhash(docs, none):
    rows = simhash.near_copies(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and {by[i].component_id for i in (1, 2, 3)} == {1}
    assert by[4].component_id == by[5].component_id == 4
    assert all(r.component_id == 1 for r in rows if r.doc_id is None and r.fp == 0)
    assert simhash.near_copies(none).count() == 0


def test_near_copies_filter(docs, none):
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert ids.count(4) == 1 and 5 not in ids and 6 in ids and len([i for i in ids if i in (1, 2, 3)]) == 1
    assert kept.where("doc_id is null").count() == 2
    assert simhash.deduplicated(none).count() == 0


def test_texts_of_one_id_are_documents_of_their_own(spark):
    words = lambda a: " ".join(f"{a}{i}" for i in range(60))
    rows = [(1, words("a"), 1), (1, words("b"), 2), (1, words("b"), 2), (2, words("b") + " more", 3), (3, words("c"), 4)]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    assert sorted(tuple(r) for r in kept) == sorted([rows[0], rows[1], rows[4]])


def test_lines_of_null_ids_come_first_and_go(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, f"first\n{passage}"), (None, f"first\n{passage}"), (None, f"second\n{passage}"), (1, f"third\n{passage}"), (2, passage)]
    got = sorted((r.doc_id is not None, r.doc_id, r.text) for r in linededup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    texts = [t for _, _, t in got]
    kept = [t for t in texts if passage in t]
    assert len(set(kept)) == 1 and kept[0].split("\n")[0] in ("first", "second") and len(kept) == (2 if kept[0].startswith("first") else 1)
    assert {t for known, i, t in got if known} == {"third", ""}
    marks = linededup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert any(r.doc_id is None for r in marks) and {r.doc_id for r in marks} == {None, 1, 2}


def test_a_workspace_deletes_its_own_tables_only(spark, docs):
    from chalkline.llm.common import stored, workspace

    before = simhash.near_copies(docs)
    with workspace(spark) as own:
        gone, kept = stored(docs.select("doc_id"), "gone"), own.keep(stored(docs.select("doc_id"), "kept"))
    assert before.count() == kept.count() == docs.count()
    with pytest.raises(Exception, match="(?i)path|not exist|not found"):
        gone.count()


def test_pii(docs, none):
    out = pii.digest(pii.personal_data(docs))
    assert out.count() == docs.count() and pii.personal_data(none).count() == 0


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, "a b c d e f"), (1, "plain words number 3 and more"), (2, None), (3, ""), (None, "zzz")], "item_id long, text string")
    hits = decontam.contaminated(docs, bench).collect()
    assert {(h.doc_id, h.item_id) for h in hits} >= {(4, 1), (5, 1), (13, 1)}
    assert sum(h.doc_id == 4 for h in hits) == 2
    left = decontam.decontaminated(docs, bench)
    assert left.columns == docs.columns and 6 in {r.doc_id for r in left.select("doc_id").collect()}
    assert decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0
    assert decontam.decontaminated(docs, bench.limit(0)).count() == docs.count()


def test_sharding(docs, none):
    rows = sharding.kd_shards(docs, 5).collect()
    assert len(rows) == docs.count()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.kd_shards(none, 5).count() == 0


def test_language(docs, none):
    got = {r.doc_id: r for r in langid.predicted(docs, langid.fit(docs)).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[8].lang_pred == "en"
    assert langid.predicted(docs, langid.fit(none)).where("lang_pred <> 'und'").count() == 0


def test_lines(docs, none):
    out = linededup.without_repeats(docs, min_words=4)
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    got = {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()}
    assert {(1, None), (2, ""), (3, " \t\n "), (4, "a b c d e f"), (5, ""), (8, "one")} <= got
    assert linededup.without_repeats(none).count() == 0


@pytest.mark.parametrize(("module", "column"), [(quality, "quality_score"), (toxicity, "toxic_score")])
def test_scores(docs, none, labels, module, column):
    out = module.scored(docs, module.fit(docs, labels))
    assert out.count() == docs.count() and out.where(f"{column} is null or {column} < 0 or {column} > 1").count() == 0
    assert module.scored(docs, module.fit(docs, labels.limit(0))).where(f"{column} < 0.5").count() == docs.count()
    assert module.scored(none, module.fit(none, labels)).count() == 0


def test_top_k(spark):
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []), (7, [1.0, 0.5]), (7, [1.0, 0.5]), (None, [1.0, 1.0]), (40, [1e12, -1e12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit(1)).withColumn("score", F.lit(2))
    got = [tuple(r) for r in topk.nearest(df, F.col("vec_id") % 20 == 0, k=3).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(0, 1, 40, 64 * 64 * 10**12 - 32 * 64 * 10**12), (0, 2, 5, 4096)[:1] + (2, 7, 64 * 64 + 32 * 32), (0, 3, 7, 64 * 64 + 32 * 32)]
    assert topk.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_very_large_components(spark):
    df = spark.createDataFrame([(0, [1e18, 1.0]), (20, [1e18, -1.0]), (3, [-1e300, 2.0]), (4, [3.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.nearest(df, F.col("vec_id") % 20 == 0, k=3).collect()}
    assert got[0, 20] == got[20, 0] == 2**63 - 1 and got[0, 3] == -(2**63 - 1) and got[0, 4] == 2**63 - 1


def test_encoding(docs, none):
    out = bpe.round_trip(docs, PATH, public_tokenizers.PATTERN)
    assert out.count() == docs.count() and out.where("n_tokens = 0").count() == 3
    assert out.join(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h")), "doc_id").where("h <> decoded_sha256").count() == 0
    assert bpe.round_trip(none, PATH, public_tokenizers.PATTERN).count() == 0
