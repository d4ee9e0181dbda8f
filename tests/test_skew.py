"""The spread forms against the plain ones, with limits low enough to be reached."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from acuity.operators import skew

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 rows: a third on one key, many equal rows, another third copies of one row."""
    keys = np.concatenate([np.full(1000, 1), np.full(1000, 2), RNG.integers(3, 60, 1000)])
    values = np.concatenate(
        [RNG.integers(0, 400, 1000), np.full(1000, 7), RNG.integers(0, 50, 1000)]
    )
    pdf = pd.DataFrame({"k": keys, "v": values.astype(float)})
    return spark.createDataFrame(pdf).repartition(6)


@pytest.mark.parametrize("limit", [50, 10_000])
def test_places(hot, limit):
    out = skew.running_total(hot, ["k"], [F.col("v")], hot_rows=limit).toPandas()
    assert len(out) == 3000
    for _, group in out.groupby("k"):
        assert sorted(group["before"]) == list(range(len(group)))
        assert (group["total"] == len(group)).all()
        assert group.sort_values("before")["v"].is_monotonic_increasing


@pytest.mark.parametrize("limit", [50, 10_000])
def test_running_totals_without_key(hot, limit):
    counts = hot.groupBy("v").agg(F.count("*").alias("n"))
    out = skew.running_total(counts, [], [F.col("v")], F.col("n"), hot_rows=limit).toPandas()
    out = out.sort_values("v").reset_index(drop=True)
    assert (out["before"] == out["n"].cumsum() - out["n"]).all()
    assert (out["total"] == 3000).all()


@pytest.mark.parametrize("limit", [50, 10_000])
def test_null_is_a_key_like_any_other(spark, limit):
    df = spark.createDataFrame([(None, float(i)) for i in range(300)] + [(1, 2.0)], "k long, v double")
    out = skew.running_total(df, ["k"], [F.col("v")], hot_rows=limit).toPandas()
    assert len(out) == 301
    null = out[out["k"].isna()].sort_values("v")
    assert list(null["before"]) == list(range(300)) and (null["total"] == 300).all()
    half = skew.percentiles(df, ["k"], "v", [0.5], ["p"], parts=limit).toPandas()
    assert half.loc[half["k"].isna(), "p"].item() == 149.5 and len(half) == 2


@pytest.mark.parametrize("parts", [6, 10_000])
def test_percentiles(hot, parts):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    names = [f"p{i}" for i in range(len(probs))]
    out = skew.percentiles(hot, ["k"], "v", probs, names, parts=parts).toPandas()
    data = hot.toPandas()
    assert len(out) == data["k"].nunique()
    for row in out.itertuples():
        want = np.quantile(data.loc[data["k"] == row.k, "v"], probs)
        assert np.allclose([getattr(row, n) for n in names], want)


@pytest.mark.parametrize("parts", [1, 8_192])
def test_order_statistics_of_odd_values(spark, parts):
    inf = float("inf")
    groups = {
        "wide": [1e300, -1e300, 5e-324, 0.0, -0.0, 1.0, 1.0 + 2**-52, 2.0], "ends": [-inf, -inf, 1.0, 2.0, 3.0, inf],
        "one": [4.0], "same": [7.0] * 30, "two": [1.0, 2.0], "far": [-1.7e308, 1.7e308, 3.0], "inf": [inf, inf],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]], "k string, v double")
    probs = [0.0, 0.2, 0.5, 1.0]
    got = skew.order_statistics(df, ["k"], "v", probs, parts=parts).collect()
    assert {r["k"] for r in got} == set(groups) and len({(r["k"], r["rank"]) for r in got}) == len(got)
    for r in got:
        values = sorted(groups[r["k"]])
        assert (r["at"], r["rows"], r["least"], r["most"]) == (values[r["rank"]], len(values), values[0], values[-1])
    for k, values in groups.items():
        wanted = {int(f(p * (len(values) - 1))) for p in probs for f in (np.floor, np.ceil)}
        assert {r["rank"] for r in got if r["k"] == k} == wanted
    whole = skew.percentiles(df, ["k"], "v", [0.0, 1.0], ["lo", "hi"], parts=parts, keep=["rows"])
    assert {r["k"]: (r["lo"], r["hi"], r["rows"]) for r in whole.collect()} == {
        k: (min(v), max(v), len(v)) for k, v in groups.items()}
    assert skew.percentiles(df.limit(0), ["k"], "v", [0.5], ["p"]).isEmpty()


def test_selection_writes_as_much_for_any_number_of_rows(spark, monkeypatch):
    written = []
    real = skew.stage

    def counted(df, name="stage"):
        out = real(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(skew, "stage", counted)
    for n in (1_000, 100_000):
        written.clear()
        df = spark.range(n).select(F.lit("k").alias("k"), F.xxhash64("id").cast("double").alias("v"))
        got = skew.percentiles(df, ["k"], "v", [0.25, 0.5, 0.75], ["a", "b", "c"]).first()
        values = np.array([r[0] for r in df.select("v").collect()])
        assert np.allclose(list(got)[1:], np.quantile(values, [0.25, 0.5, 0.75]))
        assert max(written) <= 6 and len(written) <= 4


@pytest.mark.parametrize("shares", [1, 4])
def test_last_rows(hot, shares):
    out = skew.last_rows(hot, ["k"], [F.desc("v")], 5, shares=shares).toPandas()
    data = hot.toPandas()
    for k, group in data.groupby("k"):
        want = sorted(group["v"], reverse=True)[:5]
        got = out[out["k"] == k].sort_values("place")
        assert list(got["v"]) == want
        assert list(got["place"]) == list(range(1, len(want) + 1))


def _joined(left, right):
    return pd.merge(left, right, on="k", how="left")


@pytest.mark.parametrize("limit", [30, 10_000])
@pytest.mark.parametrize("unique", [False, True])
def test_left_join(spark, limit, unique):
    """Keys: 1 hot on both sides, 2 hot left only, 3 hot right only, 4 hot left without a
    match, 5 plain, 6 without a match, null."""
    left = [1] * 100 + [2] * 70 + [3] + [4] * 50 + [5] * 2 + [6] + [None] * 60
    right = [1, 2, 3, 5, 9] if unique else [1] * 45 + [2] + [3] * 90 + [5] * 3 + [9] * 80 + [None]
    lp = pd.DataFrame({"k": left, "a": np.arange(len(left))})
    rp = pd.DataFrame({"k": right, "b": np.arange(len(right))})
    ldf = spark.createDataFrame([(None if k is None or k != k else int(k), int(a))
                                 for k, a in lp.itertuples(index=False)], "k long, a long")
    rdf = spark.createDataFrame([(None if k is None or k != k else int(k), int(b))
                                 for k, b in rp.itertuples(index=False)], "k long, b long")
    shares = skew.key_shares(ldf, None if unique else rdf, "k", hot_rows=limit)
    assert (shares is None) == (limit == 10_000)
    out = skew.left_join(ldf, rdf, "k", shares)
    assert out.columns == ["k", "a", "b"]
    want = _joined(lp, rp.dropna(subset=["k"]))
    norm = lambda df: sorted(
        (-1 if pd.isna(k) else int(k), int(a), -1 if pd.isna(b) else int(b))
        for k, a, b in df[["k", "a", "b"]].itertuples(index=False)
    )
    assert norm(out.toPandas()) == norm(want)
