"""The ordinal classifier: held-out accuracy, calibration of its parts and odd inputs."""

import os

import numpy as np
import pytest

from sparkloom.llm import ordinal
from tests.llm.test_dedup import docs_of

DATA = "/root/testdata/sf0.1"


def test_probabilities_are_ordered():
    m = ordinal.OrdinalModel(np.zeros(ordinal.WIDTH), np.array([-1.0, 0.5]))
    t = m.tails(np.linspace(-3, 3, 7))
    assert (t[:, 0] >= t[:, 1]).all() and (np.diff(t, axis=0) > 0).all()


def test_features_do_not_depend_on_neighbours():
    texts = ["Ärger the the\ncat".encode(), b"", b" ", b"x" * 3000, b"!! ??", "漢字 1".encode()]
    flat, bounds = ordinal.features(texts)
    for i, t in enumerate(texts):
        alone, _ = ordinal.features([t])
        assert sorted(alone) == sorted(flat[bounds[i] : bounds[i + 1]])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    grades = ordinal.graded(labels)
    fitted = ordinal.train(docs, grades.where("doc_id % 4 != 1"))
    got = ordinal.classify(docs, fitted).join(grades.where("doc_id % 4 = 1"), "doc_id").toPandas()
    kept = got.groupby("grade").keep.mean()
    assert kept[0] < 0.05 and kept[1] < 0.25 and kept[2] > 0.97
    means = got.groupby("grade").expected_grade.mean()
    assert means[0] < means[1] < means[2]


def test_odd_inputs(spark):
    rows = [(1, None), (2, ""), (3, "word " * 40000), (None, "a b c"), (4, "a b c"), (4, "a b c")]
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 0), (4, 1, 1), (4, 1, 0), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    model = ordinal.train(docs, ordinal.graded(labels))
    assert ordinal.classify(docs, model).count() == 6
    assert ordinal.keep_good(docs, model, least=0.0).columns == docs.columns
    none = ordinal.train(docs, ordinal.graded(labels.where("false")))
    assert none is None and {r.keep for r in ordinal.classify(docs, none).collect()} == {True}
    assert ordinal.classify(docs_of(spark, []), model).count() == 0


def test_slopes_are_those_of_the_likelihood():
    import math

    def loss(score, cut, grade):
        below = [0.0] + [1 / (1 + math.exp(-(c - score))) for c in cut] + [1.0]
        return -math.log(below[grade + 1] - below[grade])

    rng, e = np.random.default_rng(1), 1e-6
    for _ in range(200):
        k = int(rng.integers(1, 5))
        cut, score, grade = np.sort(rng.normal(size=k) * 2) + np.arange(k) * 0.05, float(rng.normal()), int(rng.integers(0, k + 1))
        by_score, by_cut = ordinal.slopes(score, cut, grade)
        assert abs(by_score - (loss(score + e, cut, grade) - loss(score - e, cut, grade)) / (2 * e)) < 1e-4
        for j in range(k):
            up, down = cut.copy(), cut.copy()
            up[j] += e
            down[j] -= e
            assert abs(by_cut[j] - (loss(score, up, grade) - loss(score, down, grade)) / (2 * e)) < 1e-4


def test_fit_raises_the_likelihood_and_keeps_thresholds_apart():
    rng = np.random.default_rng(2)
    truth = rng.normal(size=40) * 1.5
    rows = [np.unique(rng.integers(0, 40, 6)) for _ in range(3000)]
    score = np.array([truth[r].sum() for r in rows])
    noisy = score + rng.logistic(size=len(rows))
    grades = (noisy > -1.5).astype(int) + (noisy > 0.5) + (noisy > 3)
    flat, bounds = np.concatenate(rows), np.r_[0, np.cumsum([len(r) for r in rows])]
    model = ordinal.fit(flat, bounds, grades, 3, l1=0.0)
    assert (np.diff(model.thresholds) > 0).all()
    fitted = np.add.reduceat(model.weights[flat], bounds[:-1])
    assert np.corrcoef(fitted, score)[0, 1] > 0.97

    def mean_loss(cut, s):
        below = np.c_[np.zeros(len(s)), 1 / (1 + np.exp(-(cut[None, :] - s[:, None]))), np.ones(len(s))]
        return -np.log(below[np.arange(len(s)), grades + 1] - below[np.arange(len(s)), grades]).mean()

    share = np.cumsum(np.bincount(grades) / len(grades))[:-1]
    assert mean_loss(model.thresholds, fitted) < 0.75 * mean_loss(np.log(share / (1 - share)), np.zeros(len(rows)))
    assert mean_loss(model.thresholds, fitted) < mean_loss(np.array([-1.5, 0.5, 3.0]), score) + 0.05


def test_training_text_is_bounded(spark):
    rows = [(i, f"word{i % 3} " * 200) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    for most in (1, 3000, 10**9):
        assert ordinal.classify(docs, ordinal.train(docs, ordinal.graded(labels), max_bytes=most)).count() == 40
    clash = docs.selectExpr("*", "1 AS p_tail", "2 AS p", "3 AS grade")
    assert ordinal.keep_good(clash, ordinal.train(clash, ordinal.graded(labels)), least=0.0).columns == clash.columns


def test_the_driver_gets_the_model_and_not_the_training_rows(spark):
    import tracemalloc

    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 10**6, 4000)) + (" good" if i % 2 else " poor")) for i in range(300)]
    grades = spark.createDataFrame([(i, 2 * (i % 2)) for i in range(300)], "doc_id long, grade int")
    docs = docs_of(spark, rows)
    tracemalloc.start()
    try:
        got = ordinal.train(docs, grades, l1=0.05)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    flat, bounds = ordinal.features([t.encode() for _, t in rows])
    want = ordinal.fit(flat, bounds, np.array([2 * (i % 2) for i, _ in rows]), 2, l1=0.05)
    assert np.count_nonzero(want.weights) and (got.weights == want.weights).all() and (got.thresholds == want.thresholds).all()
    assert peak < 3 * want.weights.nbytes < flat.nbytes * 3  # the weights, not what they were fitted on
