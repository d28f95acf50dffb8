"""The toxic-span field: gradients, long stretches, and learning from a table as from lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import toxicity


def labelled(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices([f"plain{k}" for k in range(200)], k=rng.randrange(3, 200))
        if i % 3 == 0:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["gruff", "vileness", "Vilest", "SNARK"]))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_gradient_of_the_windows():
    rng = np.random.default_rng(2)
    ids, marks = rng.integers(0, 4, (5, 7, 2)).astype(np.uint16), rng.integers(0, 2, (5, 7)).astype(float)
    many = np.array([7, 3, 1, 5, 7])
    there = (np.arange(7) < many[:, None]).astype(float)
    marks *= there
    theta = rng.normal(size=4 + 5)  # three features and none, bias, transitions
    theta[3] = 0

    def likelihood(theta):
        total, move = 0.0, theta[-4:].reshape(2, 2)
        for x, y, n in zip(ids, marks.astype(int), many):
            own = np.array([[0.0, theta[x[t]].sum() + theta[4]] for t in range(n)])
            paths = [[p >> t & 1 for t in range(n)] for p in range(2**n)]
            scores = [sum(own[t, p[t]] for t in range(n)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in paths]
            path = y[:n].tolist()
            total += scores[paths.index(path)] - np.log(np.exp(scores).sum())
        return total

    toxicity_featured, toxicity.FEATURED = toxicity.FEATURED, 2
    try:
        grad = toxicity._gradient(theta, ids, marks, there)
    finally:
        toxicity.FEATURED = toxicity_featured
    for k in [0, 1, 2, 4, 5, 6, 7, 8]:
        step = np.zeros(9)
        step[k] = 1e-5
        assert grad[k] == pytest.approx((likelihood(theta + step) - likelihood(theta - step)) / 2e-5, abs=1e-6)


def test_long_stretches_are_not_cut():
    model = toxicity.Model({"bad": 3.0}, -1.0, np.array([[0.9, -0.3], [-0.2, 1.4]]), (-1.0, 2.0, 1.0))
    kept, model.across = model.across, model.across[:3]
    short = [model.crossing(k) for k in range(40)]
    assert all(np.allclose(a, b) for a, b in zip(short, kept))
    model.across = kept
    places, got = model.marginals("bad " + "word " * 5000 + "bad")
    assert places.tolist() == [0, 5001] and np.isfinite(got).all()


def test_table_and_lists_teach_the_same(spark, monkeypatch):
    rows = labelled(240, 4)
    monkeypatch.setattr(toxicity, "BLOCK", 50)
    monkeypatch.setattr(toxicity, "COUNTED", 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.learn(docs, labels, F.lit(True))
    want = toxicity.fit([t for _, t, y in rows if y], [t for _, t, y in rows if not y])
    assert got.weights.keys() == want.weights.keys()
    for text in (t for _, t, _ in labelled(60, 5)):
        assert got.tag(text)[0] == pytest.approx(want.tag(text)[0], abs=1e-3) and got.tag(text)[1:] == want.tag(text)[1:]
    again = toxicity.learn(docs.repartition(7), labels, F.lit(True))
    assert again.weights == pytest.approx(got.weights) and again.fit == pytest.approx(got.fit)


def test_bounds_of_the_sample(spark):
    rows = labelled(90, 6)
    docs = spark.createDataFrame([(i % 30, t) for i, t, _ in rows] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)] * 3, "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True), vocabulary=3, windows=25)
    assert 0 < len(model.weights) <= 3
    assert toxicity.learn(docs, labels, F.lit(True), longest=2).weights == {}
