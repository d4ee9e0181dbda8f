"""The ordinal fit: its gradient, its end, and what must not change it."""

import numpy as np
import pytest

from acuity.llm import secrets, toxicity


def sample(seed=1, n=60, d=5):
    rng = np.random.default_rng(seed)
    x = rng.poisson(1.0, (n, d)) * 1.0
    grade = np.digitize(x @ np.array([1.0, 0.5, 0.0, 0.0, -1.0])[:d] + rng.normal(0, 0.5, n), [0.5, 1.5, 2.5])
    weight = np.where(grade > 0, 0.5, 2.0)
    return x, grade, weight / weight.sum()


def test_gradient():
    x, grade, weight = sample()
    rng = np.random.default_rng(2)
    par = rng.normal(0, 0.3, x.shape[1] + 3)
    f = lambda p: toxicity.loss(p, x, grade, weight, 3, 0.01)
    grad = f(par)[1]
    for k in range(len(par)):
        step = np.zeros(len(par))
        step[k] = 1e-6
        assert np.isclose(grad[k], (f(par + step)[0] - f(par - step)[0]) / 2e-6, atol=1e-6)


def test_loss_by_hand():
    x, grade, weight = sample(n=7)
    par = np.array([0.2, -0.1, 0.3, 0.0, 0.5, -0.4, 0.1, -0.2])
    cuts = [-0.4, -0.4 + np.exp(0.1), -0.4 + np.exp(0.1) + np.exp(-0.2)]
    total = 0.0
    for row, g, w in zip(x, grade, weight):
        tail = [1.0, *(1 / (1 + np.exp(c - row @ par[:5])) for c in cuts), 0.0]
        total -= w * np.log(tail[g] - tail[g + 1])
    assert np.isclose(toxicity.loss(par, x, grade, weight, 3, 0.0)[0], total)


def test_fit_ends_at_the_minimum():
    x, grade, weight = sample(n=300)
    f = lambda p: toxicity.loss(p, x, grade, weight, 3, 1e-5)
    w, cuts = toxicity.fit_ordinal(x, grade, weight)
    par = np.concatenate([w, cuts[:1], np.log(np.diff(cuts))])
    assert np.abs(f(par)[1]).max() < 1e-5 and w[0] > 0 > w[4] and list(cuts) == sorted(cuts)


def corpus(spark, order=1):
    rng = np.random.default_rng(1)
    plain, bad = [f"good{c}" for c in "abcdefgh"], ["vile", "nasty", "awful"]
    rows = []
    for i in range(400):
        words = [*rng.choice(plain, 20), *(rng.choice(bad, 1 + i % 9) if i % 4 == 0 else [])]
        rows.append((i, " ".join(words[::order]), "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, _above string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")


def test_verdicts_depend_on_counts_alone(spark, labels, monkeypatch):
    """Neither the order of words nor a nudge of the cuts between grades moves a verdict."""
    docs = corpus(spark)
    model = toxicity.train(docs, labels)
    rows = toxicity.grade_texts(docs, model).filter("doc_id >= 300").collect()
    assert all(r["toxic"] == (r["doc_id"] % 4 == 0) for r in rows)
    turned = toxicity.train(corpus(spark, order=-1), labels)
    assert model.weights == pytest.approx(turned.weights) and model.thresholds == pytest.approx(turned.thresholds)
    real = np.quantile
    for by in (1e-9, -1e-9):
        monkeypatch.setattr(np, "quantile", lambda *a, by=by: real(*a) + by)
        assert toxicity.train(docs, labels).weights == pytest.approx(model.weights)


def test_any_column_names(spark):
    rows = [(1, "vile token=abcdef1234 here", 26, "mine", "mine", "mine", "mine"), (2, "good", 4, "m", "m", "m", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _gap string, _hit string, _new string, _above string")
    masked = secrets.mask_secrets(docs)
    assert masked.columns == docs.columns
    assert [tuple(r)[3:] for r in masked.orderBy("doc_id").collect()] == [r[3:] for r in rows]
    for model in (toxicity.OrdinalModel({"vile": 9.0}, [1.0, 2.0, 3.0]), toxicity.OrdinalModel({}, [])):
        kept = toxicity.drop_toxic(docs, model)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == ({2} if model.thresholds else {1, 2})
    with pytest.raises(ValueError):
        toxicity.with_tails(docs, model)
