"""Toxicity, language identification and quality: held-out accuracy, exact inner steps, defined results."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilebook.llm import langid, quality, toxicity
from profilebook.llm.common import bounded_sample
from tests.llm.test_native import table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def data(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(8), spark.read.parquet(f"{SF}/labels.parquet")


def accuracy(got, labels, label):
    rows = got.filter("held_out").join(labels.select(F.col("doc_id").alias("l_id"), label), F.col("doc_id") == F.col("l_id")).collect()
    right = {y: [r["predicted"] == y for r in rows if r[label] == y] for y in (0, 1)}
    return [np.mean(right[y]) for y in (0, 1)]


def test_toxicity_held_out(data):
    docs, labels = data
    got = toxicity.toxicity_scores(docs, labels).cache()
    clean, toxic = accuracy(got, labels, "toxic")
    assert got.count() == docs.count() and clean > 0.98 and toxic > 0.9
    assert got.filter("score < 0 or score > 1 or score is null").isEmpty()


def test_quality_held_out(data):
    docs, labels = data
    low, high = accuracy(quality.quality_scores(docs, labels), labels, "quality")
    assert low > 0.95 and high > 0.98


def test_language_held_out(data):
    docs, _ = data
    got = langid.languages(docs).filter("held_out").join(docs.select(F.col("doc_id").alias("l_id"), "lang"), F.col("doc_id") == F.col("l_id"))
    assert got.filter("lang = lang_pred").count() / got.count() > 0.98


def test_folding():
    t = toxicity.Folding()
    assert toxicity.fold_text("1D10T, іdіот! L0$er", t) == toxicity.fold_text("idiot idiot loser", t)
    assert toxicity.fold_text("Pa​the­tic", t) == " pathetic "
    assert toxicity.fold_text("", t) == "  "


def test_exceptions_cancel_matches():
    lex = toxicity.Lexicon({" scun": 5.0}, [" scunthorpe ", " old scunny "], [])
    a = lex.automaton()
    assert toxicity.evidence(" scunthorpe ", a)[0] == 0.0 and toxicity.evidence(" old scunny ", a)[0] == 0.0
    assert toxicity.evidence(" scunny ", a)[0] == 5.0


def test_toxicity_without_labels_and_nulls(spark):
    docs = table(spark, [(1, "a text"), (2, None), (None, ""), (3, "x" * 200_000)]).withColumn("score", F.lit(9)).withColumn("y", F.lit(1))
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    for f in (toxicity.toxicity_scores, quality.quality_scores):
        got = f(docs, none)
        assert got.count() == 4 and got.filter("score is null or score < 0 or score > 1").isEmpty()
        assert f(table(spark, []), none).collect() == []


def test_language_defined_results(spark):
    docs = spark.createDataFrame([(i, f"the cat {i} sat on the mat and then went away", "en", "s", 1) for i in range(40)] +
                                 [(100 + i, f"der hund {i} lag auf der matte und ging dann weg", "de", "s", 1) for i in range(40)] +
                                 [(200, None, "en", "s", 0), (201, "123 456 !!", None, "s", 0), (None, "", None, None, None), (202, "the mat and der hund", None, None, 1), (203, "7 " * 50_000 + "the cat", None, None, 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long").withColumn("lang_pred", F.lit("x"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.languages(docs).collect()}
    assert got[200] == got[201] == got[None] == ("und", 0.0) and got[203][0] == "en"
    assert all(got[i][0] == "en" and got[100 + i][0] == "de" for i in range(40))
    model = langid.train(docs)
    words = {w["word"]: w["lang"] for w in langid.label_words(docs.filter("doc_id = 202"), model).first()["words"]}
    assert words["the"] == "en" and words["hund"] == "de"
    kept = {r["id"] for r in langid.known(docs).select(F.col("doc.doc_id").alias("id")).collect()}
    assert 200 not in kept and 201 not in kept and set(range(40)) <= kept
    assert langid.languages(docs.filter("false")).collect() == []
    assert {r["lang_pred"] for r in langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_forward_backward_is_exact():
    """Posteriors and expected transitions against the sum over all state sequences."""
    rng = np.random.RandomState(2)
    k, counts = 3, np.array([1, 5, 7])
    e, t = rng.randn(counts.sum(), k), rng.randn(k, k)
    old, langid.BLOCK = langid.BLOCK, 3
    try:
        got, _ = langid.posteriors(e, counts, t)
        at = 0
        for n in counts:
            total, marginal = 0.0, np.zeros((n, k))
            for path in itertools.product(range(k), repeat=int(n)):
                # The first word also has a transition from a uniform start.
                for start in range(k):
                    w = np.exp(sum(e[at + i, s] for i, s in enumerate(path)) + t[start, path[0]] + sum(t[a, b] for a, b in zip(path, path[1:])))
                    total += w
                    for i, s in enumerate(path):
                        marginal[i, s] += w
            assert np.allclose(got[at:at + n], marginal / total)
            at += n
    finally:
        langid.BLOCK = old


def test_gam_learns_an_interaction():
    rng = np.random.RandomState(0)
    x = rng.rand(4000, 3)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.95


def test_features_of_empty_and_long_texts():
    assert len(quality.features("")) == len(quality.FEATURES) == len(quality.features("a b " * 100_000))
    assert np.isfinite(quality.features("")).all()


def test_bounded_sample(spark):
    d = spark.range(10_000).toDF("doc_id")
    assert 500 < bounded_sample(d, "doc_id", 1000).count() <= 1000 and bounded_sample(d, "doc_id", 10_000).count() == 10_000
