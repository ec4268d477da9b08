"""The pair term of the factorization machine."""

import numpy as np
import pytest

from lastrum.llm import quality, toxicity
from lastrum.llm.hashed import rows_of


def made(n, both, seed):
    """Rows in which terms 1 and 2 are neutral each by itself: only whether they stand together decides."""
    rng, rows = np.random.default_rng(seed), []
    for _ in range(n):
        a, b = rng.random(2) < 0.5
        ids = set(rng.integers(100, 3000, 60).tolist()) | ({1} if a else set()) | ({2} if b else set())
        rows.append((int((a == b) == both), np.array(sorted(ids), np.int32), None))
    return rows


@pytest.mark.parametrize("both", [True, False])
def test_pairs_without_effects_of_their_own_are_learnt(both):
    rows = made(4000, both, 1)
    model = toxicity.fit(rows_of(rows[:3000]))
    assert np.mean([(model.raw(i) >= 0) == g for g, i, _ in rows[3000:]]) > 0.9
    assert (model.factors[1] @ model.factors[2] > 0.5) == both


def test_no_pairs_by_chance():
    rng = np.random.default_rng(2)
    rows = [(int(rng.random() < 0.3), np.unique(rng.integers(0, 400, 60)).astype(np.int32), None) for _ in range(3000)]
    y = np.array([g for g, _, _ in rows])
    i, _, _ = toxicity.interactions(rows_of(rows), y - y.mean())
    assert len(i) == 0


def test_raw_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(3)
    model = toxicity.Model(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    for n in (0, 1, 2, 20):
        ids = rng.choice(50, n, replace=False)
        pairs = sum(model.factors[a] @ model.factors[b] for k, a in enumerate(ids) for b in ids[:k])
        assert model.raw(ids) == pytest.approx(0.3 + model.weights[ids].sum() + pairs)


def test_quality_rejects_all_below_the_level(spark):
    docs = spark.createDataFrame([(i, f"word{i} here") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    for at_least, n in ((0, 40), (2, 0)):
        assert quality.judge(docs, model, at_least).where("kept").count() == quality.select(docs, model, at_least).count() == n


def test_cumulative_likelihood_by_brute_force():
    """The fitted thresholds and weights are near the best that a search over a grid finds for one feature."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=600)
    grade = np.digitize(2 * x + rng.logistic(size=600), (-1.0, 1.0))
    rows = rows_of([(int(g), np.array([5], np.int32), np.array([v], np.float32)) for g, v in zip(grade, x)])
    model = quality.fit(rows, epochs=60)

    def loss(w, low, high):
        edges = np.array([-np.inf, low, high, np.inf])
        return -np.log(np.maximum(quality.sigmoid(edges[grade + 1] - w * x) - quality.sigmoid(edges[grade] - w * x), 1e-12)).mean()

    best = min(loss(w, low, high) for w in np.arange(1, 3.2, 0.2) for low in np.arange(-1.6, -0.3, 0.2) for high in np.arange(0.4, 1.7, 0.2))
    assert loss(model.weights[5], *model.thresholds) <= best + 0.01
