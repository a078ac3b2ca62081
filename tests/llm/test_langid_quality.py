import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import common, langid, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def plain_grams(text, longest=3):
    text = " ".join(["", *text.lower().split(), ""])
    return {text[i : i + n] for n in range(1, longest + 1) for i in range(len(text) - n + 1)}


def test_buckets_are_the_distinct_grams():
    for text in ("", "a", "Ab  ba\nab", "é😀漢 " * 50, "the quick brown fox jumps over the lazy dog"):
        got = langid.gram_buckets(text, bits=24)
        assert len(got) == len(plain_grams(text)), text
    a, b = "the cat sat on the mat", "the dog sat on a log"
    shared = set(langid.gram_buckets(a, bits=24)) & set(langid.gram_buckets(b, bits=24))
    assert len(shared) == len(plain_grams(a) & plain_grams(b))


def sentences(spark):
    words = {"en": "the of and that with ing tion".split(), "de": "der und nicht ung heit schaft".split(), "fr": "les que des ment eau oux".split()}
    rng = np.random.default_rng(0)
    rows = [(lang, " ".join(rng.choice(words[lang], 12))) for lang in words for _ in range(40)]
    return spark.createDataFrame([(t, k) for k, t in rows], "text string, label string")


def test_decisions_are_those_of_kernel_ridge_regression(spark):
    """With every text a landmark the approximation is exact: compare with the dual solution of kernel ridge regression."""
    rows = sentences(spark)
    model = langid.fit(rows, landmarks=1000, rows=1000, ridge=1e-2, bits=22)
    seen = sorted({(r.text, r.label) for r in rows.collect()})
    grams = [plain_grams(t) for t, _ in seen]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    targets = np.where(np.array([[k == m for m in model.labels] for _, k in seen]), 1.0, -1.0)
    dual = np.linalg.solve(kernel + 1e-2 * len(seen) * np.eye(len(seen)), targets)
    fresh = ["the and tion of that", "und der schaft nicht", "les eau que ment ment", "the und les", "zzz qqq"]
    values = np.array([[len(plain_grams(t) & g) / np.sqrt(len(plain_grams(t)) * len(g)) for g in grams] for t in fresh]) @ dual
    labels, scores = model.decide(fresh)
    assert labels == [model.labels[i] for i in values.argmax(axis=1)]
    assert scores == pytest.approx(np.clip((values.max(axis=1) + 1) / 2, 0, 1), abs=2e-3)


def test_undecided_and_odd_tables(spark):
    rows = [(0, None), (1, ""), (2, "123 !!"), (3, "the that and"), (4, "x" * 300_000), (4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(sentences(spark))).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[3].lang_pred == "en" and 0 <= got[3].score <= 1
    empty = langid.fit(spark.createDataFrame([(None, "en"), ("12", "en"), ("a", None)], "text string, label string"))
    assert empty.labels == [] and empty.decide(["the"])[0] == ["und"]
    assert langid.identify(docs.limit(0), empty).count() == 0


@needs_data
def test_language_on_held_out_rows(spark):
    found = langid.op7_string_kernel_langid(spark, SMALL).join(common.read(spark, SMALL, "documents").select("doc_id", "lang"), "doc_id")
    held, right, n = found.where("held_out").agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.countDistinct("lang_pred")).first()
    assert held > 200 and right / held > 0.97 and n == 4


def test_pairs_cover_both_labels(spark):
    chosen = spark.createDataFrame([(i, int(i % 5 > 0), [float(i)]) for i in range(100)], "doc_id long, label int, features array<double>")
    met = quality.pairs(chosen, 3).collect()
    assert len(met) == 80 * 3
    assert {r.better[0] for r in met} == {float(i) for i in range(100) if i % 5} and {r.worse[0] for r in met} == {float(i) for i in range(0, 100, 5)}


def test_weights_are_the_logistic_optimum(spark):
    """The gradient of the pairwise loss with its ridge term is zero at the weights found."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["good", "fine", "Text!"], 30)) + "!" * int(rng.integers(0, 12)) * (i % 3), int(i % 3 < 2 or rng.random() < 0.3)) for i in range(150)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int")
    model = quality.fit(labels, docs, ridge=1e-2)
    chosen = quality.with_features(docs).join(labels, "doc_id")
    met = quality.pairs(chosen.select("doc_id", "label", "features")).collect()
    unit = quality.Ranking(np.eye(len(quality.FEATURES)), model.centre, model.scale, 0.0)
    gaps = unit.strengths(np.array([r.better for r in met])) - unit.strengths(np.array([r.worse for r in met]))
    gradient = gaps.T @ (1 / (1 + np.exp(gaps @ model.weights))) - 1e-2 * len(met) * model.weights
    assert np.abs(gradient).max() < 1e-2 * len(met) * 0.05


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (2, " \n"), (3, "w " * 100_000), (3, "again"), (4, "😀!!")], "doc_id long, text string").withColumn("features", F.lit(1))
    for labels in ([], [(1, 1)], [(1, None), (None, 0)], [(1, 1), (1, 0), (2, 0), (3, 1), (3, 1)]):
        model = quality.fit(spark.createDataFrame(labels, "doc_id long, label int"), docs)
        got = quality.score(docs, model).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


@needs_data
def test_quality_on_held_out_rows(spark):
    found = quality.op1_bradley_terry_quality(spark, SMALL).join(common.read(spark, SMALL, "labels"), "doc_id").where("held_out").toPandas()
    good, bad = found[found.quality == 1], found[found.quality == 0]
    assert len(good) > 40 and len(bad) > 5
    assert (good.predicted == 1).mean() > 0.95 and (bad.predicted == 0).mean() > 0.85
    assert np.mean([(s > bad.score).mean() for s in good.score]) > 0.97


def test_sample_keys_is_even_and_bounded(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("label"), (F.col("id") % 15_000).alias("key"))
    got = {r["label"]: r["count"] for r in common.sample_keys(rows, "label", "key", 300).groupBy("label").count().collect()}
    assert got == {"hot": 300, "cold": 300}
    assert common.sample_keys(rows.limit(0), "label", "key", 5).count() == 0


def test_quality_learns_from_all_labelled_rows(spark, monkeypatch):
    rng, seen, keep = np.random.default_rng(8), {}, quality.stored

    def counted(df, name):
        seen[name] = keep(df, name)
        return seen[name]

    monkeypatch.setattr(quality, "stored", counted)
    rows = [(i, " ".join(rng.choice(["good", "fine", "Text!"], 4)), int(i % 10 > 0)) for i in range(8000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = quality.fit(spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int"), docs)
    assert seen["quality_docs"].count() == 8000
    strengths = model.strengths(np.array([quality.features(r[1]) for r in rows]))
    want = np.quantile(strengths, [0.1 * 0.97, 0.1 + 0.03 * 0.9]).mean()
    assert model.threshold == pytest.approx(want, abs=1e-9)


def test_values_at_ranks_are_exact(spark):
    values = np.random.default_rng(9).normal(size=5000).round(3) * 10.0 ** np.arange(5000).__mod__(9)
    got = quality.at_ranks(spark.createDataFrame([(float(v),) for v in values], "s double"), [0, 17, 2500, 4999])
    assert got == [np.sort(values)[k] for k in (0, 17, 2500, 4999)]


def test_quality_deals_out_no_texts(spark, monkeypatch):
    """No join of what is fitted or scored has a text on either side, so none is shuffled where labels are too many to broadcast."""
    keep, dealt, names = quality.stored, [], []

    def walk(node):
        kids = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            dealt.extend(k.output().apply(i).name() for k in kids for i in range(k.output().size()))
        for k in kids:
            walk(k)

    def watched(df, name):
        names.append(name)
        walk(df._jdf.queryExecution().optimizedPlan())
        return keep(df, name)

    monkeypatch.setattr(quality, "stored", watched)
    docs = spark.createDataFrame([(i, "good " * (i % 7 + 1)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(40)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "read", lambda spark, sf_dir, table: docs if table == "documents" else labels)
    found = quality.op1_bradley_terry_quality(spark, "")
    walk(found._jdf.queryExecution().optimizedPlan())
    assert "doc_id" in dealt and "features" in dealt and "text" not in dealt and "quality_docs" in names
    model = quality.fit(labels.withColumnRenamed("quality", "label").where(~quality.held_out(F.col("doc_id"))), docs)
    want = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert {r.doc_id: r.score for r in found.collect()} == pytest.approx(want, abs=1e-12)
