"""The line field against sums over all labellings, and on texts kept from training."""

import itertools
import zlib

import numpy as np
import pytest

from acuity.llm import quality


def by_hand(evidence, pairs):
    """Chances, log partition value and pair counts from every labelling of one chain."""
    total, good, both = 0.0, np.zeros(len(evidence)), np.zeros((2, 2))
    for labels in itertools.product((0, 1), repeat=len(evidence)):
        score = sum(e for e, y in zip(evidence, labels) if y) + sum(pairs[a, b] for a, b in zip(labels, labels[1:]))
        total += np.exp(score)
        good += np.exp(score) * np.array(labels)
        for a, b in zip(labels, labels[1:]):
            both[a, b] += np.exp(score)
    return good / total, np.log(total), both / total


def test_marginals_equal_sums_over_labellings():
    rng = np.random.default_rng(1)
    pairs = np.array([[0.0, -0.7], [0.4, 1.1]])
    sizes = np.array([1, 6, 2, 9, 1])
    evidence = rng.normal(0, 2, sizes.sum())
    chance, log_z, both = quality.marginals(evidence, sizes, pairs)
    parts = [by_hand(e, pairs) for e in np.split(evidence, np.cumsum(sizes)[:-1])]
    assert np.allclose(chance, np.concatenate([p[0] for p in parts]))
    assert np.isclose(log_z, sum(p[1] for p in parts)) and np.allclose(both, sum(p[2] for p in parts))
    far, _, _ = quality.marginals(np.r_[np.full(3_000, 900.0), np.full(3_000, -900.0)], np.array([6_000]), pairs)
    assert np.isfinite(far).all() and far[0] > 0.99 and far[-1] < 0.01


def test_gradient():
    rng = np.random.default_rng(2)
    sizes, good = np.array([3, 5, 1, 4]), np.array([1, 0, 1, 0])
    x = quality.design(rng.normal(0, 1, (13, 2)), sizes)
    par, weight = rng.normal(0, 0.5, x.shape[1] + 3), np.array([0.7, 1.3])
    _, grad = quality.objective(par, x, sizes, good, weight, 0.1)
    for k in range(len(par)):
        step = np.zeros(len(par))
        step[k] = 1e-5
        up, down = (quality.objective(par + s, x, sizes, good, weight, 0.1)[0] for s in (step, -step))
        assert np.isclose(grad[k], (up - down) / 2e-5, atol=1e-6)


def test_line_features():
    got = quality.line_features("Ab c! Ab\n\n99 ## é\nAb c! Ab".encode())
    at = dict(zip(quality.FEATURES, got.T.tolist()))
    assert np.allclose(at["length"], np.log1p([8, 1, 7, 8])) and at["empty"] == [0, 1, 0, 0]
    assert at["repeated"] == [1, 0, 0, 1] and np.allclose(at["digits"], [0, 0, 2 / 7, 0])
    assert np.allclose(at["letters"], [5 / 8, 0, 1 / 7, 5 / 8]) and np.allclose(at["capitals"], [2 / 5, 0, 0, 2 / 5])
    assert np.allclose(at["symbols"], [0, 0, 2 / 7, 0]) and np.allclose(at["distinct"], [2 / 3, 0, 1, 2 / 3])


def test_evidence_is_the_design_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    rows = rng.random((23, len(quality.FEATURES))).astype(np.float32)
    k = rows.shape[1]
    par = rng.normal(0, 1, 4 * k + 1)
    model = quality.LineModel(rows.mean(0), np.ones(k), par[:k], par[k : 2 * k], par[2 * k : 3 * k],
                              par[3 * k : 4 * k], par[-1], np.zeros((2, 2)))
    whole = quality.design(quality.standard(rows, model.mean, model.scale), np.array([23])) @ par
    for at_once in (1, 5, 100):
        monkeypatch.setattr(quality, "AT_ONCE", at_once)
        assert np.allclose(model.evidence(rows), whole)


def corpus(n):
    rng = np.random.default_rng(4)
    words = [a + b for a in ("the", "on", "wa", "li") for b in ("re", "ning", "st", "o")]
    out = []
    for i in range(n):
        lines = [" ".join(rng.choice(words, 12)).capitalize() + "." for _ in range(1 + i % 7)]
        if i % 3 == 0:
            lines = [" ".join(f"{w}###" for w in x.split()) if i % 2 else x.upper() + "!!" * 9 for x in lines]
        out.append("\n".join(lines))
    return out


def test_quality_of_texts_kept_from_training(spark):
    texts = corpus(400)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, good string, lengths int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0), (7, 9, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    rows = quality.score_texts(df, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    kept = [r for r in rows if r["held_out"]]
    assert len(kept) > 50 and all(r["predicted"] == int(r["doc_id"] % 3 > 0) == int(r["score"] >= 0.3) for r in kept)
    # labels of the fold kept out have no say
    turned = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 5 = 0, 1 - quality, quality) AS quality")
    again = quality.train(df, turned)
    assert np.array_equal(model.own, again.own) and np.array_equal(model.pairs, again.pairs)
    # chances per line
    mixed = spark.createDataFrame([(1, texts[6] + "\n" + texts[5])], "doc_id long, text string")
    chances = quality.line_chances(mixed, model).first()
    n = texts[6].count("\n") + 1
    assert max(chances["good"][:n]) < 0.5 < min(chances["good"][n:]) and sum(chances["lengths"]) + len(chances["good"]) - 1 == len(texts[6] + "\n" + texts[5])


def test_odd_texts(spark):
    odd = spark.createDataFrame(
        [(None, None), (1, None), (2, ""), (2, ""), (3, "\n" * 70_000), (4, "x" * 100_000), (5, " \t\r\n"), (6, "€😀\n日本")],
        "doc_id long, text string")
    for model in (None, quality.fit([np.ones((2, len(quality.FEATURES)), np.float32) * k for k in (0, 1)], np.array([0, 1]))):
        rows = quality.score_texts(odd, model).collect()
        assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
        assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
        assert quality.score_texts(odd.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.train(odd, labels) is None and quality.train(odd.limit(0), labels.limit(0)) is None
    assert {r["score"] for r in quality.score_texts(odd, None).collect()} == {0.5}


@pytest.mark.parametrize("copies", [1, 3])
def test_repeated_rows_and_labels(spark, copies):
    texts = corpus(60)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * copies, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] * copies, "doc_id long, quality int")
    model = quality.train(df, labels)
    assert quality.score_texts(df, model).count() == 60 * copies
    assert np.allclose(model.bias, quality.train(df.distinct(), labels.distinct()).bias)
