from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgauge.llm import toxicity
from callgauge.llm.common import table


def test_ordinal_fit_recovers_ordered_grades():
    rng = np.random.default_rng(1)
    n, d = 3000, 6
    x = (rng.random((n, d)) < 0.4).astype(float)
    eta = x @ np.array([3.0, -3.0, 2.0, 0.0, 1.0, 0.0])
    noise = rng.logistic(size=n)
    grades = np.searchsorted([0.0, 2.0, 4.0], eta + noise)
    rows, columns = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(rows, columns, x[rows, columns], grades, d, 4, steps=600)
    assert np.all(np.diff(theta) > 0)
    assert np.allclose(w, [3, -3, 2, 0, 1, 0], atol=0.4)
    assert np.allclose(theta, [0, 2, 4], atol=0.4)


def test_expected_severity_is_the_mean_grade():
    model = toxicity.Model({"bad": 2.0}, (1.0, 3.0))
    severity, grade, rejected = toxicity.predict(model, "Bad, bad!")
    eta = 2.0 * (1 + np.log(2))
    above = [1 / (1 + np.exp(-(eta - t))) for t in model.thresholds]
    shares = [1 - above[0], above[0] - above[1], above[1]]
    assert severity == pytest.approx(sum(k * s for k, s in enumerate(shares)))
    assert grade == int(np.argmax(shares)) and rejected


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, max_rows=3000)
    used = toxicity.sample_labels(labels, id_col="doc_id", label_col="toxic", max_rows=3000)
    score = toxicity.scorer(spark, model)
    held = (
        docs.join(labels, "doc_id")
        .join(used, F.col("doc_id") == F.col("id"), "left_anti")
        .select("toxic", score("text").alias("s"))
        .select("toxic", "s.*")
        .groupBy("toxic")
        .agg(F.count("*").alias("n"), F.sum(F.col("rejected").cast("int")).alias("r"))
    )
    found = {r.toxic: (r.r, r.n) for r in held.collect()}
    assert found[0][0] <= 0.002 * found[0][1]
    assert found[1][0] >= 0.9 * found[1][1]


def test_odd_inputs(spark):
    texts = "doc_id long, text string, severity int, toxic string"
    docs = spark.createDataFrame(
        [(i, "you idiot moron" if i % 2 else "a calm text", 1, "x") for i in range(40)]
        + [(None, None, 1, "x"), (50, "", 1, "x"), (51, "idiot " * 50000, 1, "x")],
        texts,
    )
    labels = spark.createDataFrame(
        [(i, i % 2, 9) for i in range(40)] + [(1, 0, 9), (None, 1, 9), (3, None, 9)],
        "doc_id long, toxic int, text int",
    )
    score = toxicity.scorer(spark, toxicity.fit(docs, labels))
    got = docs.select("doc_id", score("text").alias("s")).select("doc_id", "s.rejected").collect()
    found = {r.doc_id: r.rejected for r in got}
    assert found[1] and not found[2] and not found[50] and not found[None] and found[51]
    none = toxicity.fit(docs, labels.limit(0))
    assert none == toxicity.Model({}, ())
    row = docs.select(toxicity.scorer(spark, none)("text").alias("s")).select("s.*").first()
    assert tuple(row) == (0.0, 0, False)
    assert docs.limit(0).select(score("text")).collect() == []


def test_given_grades_are_used(spark):
    words = ["calm", "rude", "vile"]
    docs = spark.createDataFrame(
        [(i, f"{words[i % 3]} text") for i in range(60)], "doc_id long, text string"
    )
    labels = spark.createDataFrame([(i, i % 3) for i in range(60)], "doc_id long, toxic int")
    score = toxicity.scorer(spark, toxicity.fit(docs, labels))
    rows = docs.select("doc_id", score("text").alias("s")).select("doc_id", "s.*").collect()
    assert all(r.grade == r.doc_id % 3 for r in rows)


def test_rare_toxic_and_labels_without_documents(spark):
    docs = spark.createDataFrame(
        [(i, "you idiot moron" if i % 100 == 0 else "a calm text") for i in range(2000)],
        "doc_id long, text string",
    )
    labels = spark.createDataFrame(
        [(i, int(i % 100 == 0)) for i in range(2000)] + [(i, i % 2) for i in range(5000, 9000)],
        "doc_id long, toxic int",
    )
    used = toxicity.sample_labels(
        labels, id_col="doc_id", label_col="toxic", max_rows=100, docs=docs
    ).collect()
    assert sorted(r.toxic for r in used) == [0] * 90 + [1] * 10
    assert sum(r.counted for r in used) == pytest.approx(2000)
    score = toxicity.scorer(spark, toxicity.fit(docs, labels, max_rows=100))
    found = docs.select("doc_id", score("text")["rejected"].alias("r")).collect()
    assert all(r.r == (r.doc_id % 100 == 0) for r in found)


def test_repeated_ids_stay_within_the_bound(spark, monkeypatch):
    rows = [(i, "you idiot moron" if i % 2 else "a calm text") for i in range(40)]
    docs = spark.createDataFrame(rows + [(1, "you idiot moron")] * 3000 + [(2, None)] * 2000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    features = toxicity._features

    def counted(sample, index):
        found = features(sample, index)
        seen.append(len(found))
        return found

    monkeypatch.setattr(toxicity, "_features", counted)
    model = toxicity.fit(docs, labels, max_rows=30)
    assert seen == [30]
    assert toxicity.predict(model, "idiot moron")[2] and not toxicity.predict(model, "calm text")[2]
    assert toxicity.fit(docs.repartition(5), labels, max_rows=30) == model


def test_ordinal_fit_equals_a_plain_descent():
    """Thresholds and weights against the likelihood minimised with numeric gradients."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 2))
    noise = np.log(1 / rng.uniform(size=150) - 1)
    grades = np.digitize(x @ np.array([1.5, -0.8]) + noise, [-0.5, 1.2])

    def loss(params):
        w, cuts = params[:2], np.array([params[2], params[2] + math.exp(params[3])])
        below = 1 / (1 + np.exp(-(cuts[None, :] - (x @ w)[:, None])))
        edges = np.hstack([np.zeros((150, 1)), below, np.ones((150, 1))])
        share = edges[np.arange(150), grades + 1] - edges[np.arange(150), grades]
        return -np.log(share).mean() + 0.5e-4 * (w @ w)

    params, step = np.zeros(4), 1e-5
    for _ in range(6000):
        gradient = [(loss(params + step * e) - loss(params - step * e)) / (2 * step) for e in np.eye(4)]
        params = params - 0.5 * np.array(gradient)
    at, columns = np.repeat(np.arange(150), 2), np.tile(np.arange(2), 150)
    weights, thresholds = toxicity.fit_ordinal(at, columns, x.ravel(), grades, 2, 3)
    assert weights == pytest.approx(params[:2], abs=0.02)
    assert thresholds == pytest.approx([params[2], params[2] + math.exp(params[3])], abs=0.02)
