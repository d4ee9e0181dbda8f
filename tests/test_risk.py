import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from acuity.operators import risk
from acuity.schemas import STAY, TARGET

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def data():
    y = (RNG.random(500) < 0.2).astype(int)
    return pd.DataFrame(
        {
            STAY: np.arange(500), TARGET: y,
            "smooth": RNG.normal(y, 1.0), "tied": RNG.integers(0, 6, 500) + y * 1.0,
        }
    )


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data).repartition(4)


def test_encode(spark, rows):
    df = spark.createDataFrame(
        [(1, "Male", "b"), (2, "male", None), (3, None, "a"), (4, "Female", "zz")],
        f"{STAY} long, gender string, unittype string",
    )
    out = risk.encode(df)
    assert rows(out, STAY, "gender_enc", "unittype_enc") == [
        (1, 1.0, 1.0), (2, 1.0, 2.0), (3, 0.0, 0.0), (4, 0.0, 3.0),
    ]
    codes = risk.fit_unit_codes(df.filter(f"{STAY} < 4"))
    unseen = risk.encode(df, codes).filter(f"{STAY} = 4").first()
    assert unseen["unittype_enc"] == 3.0


@pytest.mark.parametrize("few", [1, 20, 10_000])
@pytest.mark.parametrize("fraction", [0.0, 0.2, 0.5, 1.0])
def test_split_takes_the_first_digests_of_each_class(spark, few, fraction):
    """Also with a key that a third of all rows have, and a class without a label."""
    rows = [(7 if i % 3 == 0 else i, [0, 1, 1, None][i % 4], i % 10) for i in range(400)]
    df = spark.createDataFrame(rows, f"{STAY} long, {TARGET} int, x int").repartition(5)
    got = Counter(tuple(r) for r in risk.stratified_split(df, fraction=fraction, few=few, hot_rows=30).collect())
    want = Counter()
    for y in (0, 1, None):
        mine = sorted((hashlib.md5(f"{k}|42".encode()).hexdigest(), k, x) for k, t, x in rows if t == y)
        quota = math.ceil(fraction * len(mine))
        want.update((k, y, x, i < quota) for i, (_, k, x) in enumerate(mine))
    assert got == want


def test_split_puts_few_rows_in_order(spark):
    df = spark.range(30_000).selectExpr(f"id AS {STAY}", f"int(id % 7 = 0) AS {TARGET}").withColumn(
        risk._MIX, F.md5(F.concat_ws("|", STAY, F.lit("42")).cast("binary")))
    cuts = {r["_class"]: r for r in risk.split_cuts(df, TARGET, 0.2, few=1).collect()}
    assert {k: r["bin"] for k, r in cuts.items()} == {0: 1, 1: 1}
    for k, r in cuts.items():
        below = df.filter((F.col(TARGET) == k) & (F.substring(risk._MIX, 1, len(r["cut"])) <= r["cut"])).count()
        assert below == math.ceil(0.2 * df.filter(F.col(TARGET) == k).count())
    assert risk.split_cuts(df.limit(0), TARGET, 0.2).isEmpty()


def test_present_features(table):
    assert risk.present_features(table, ["tied", "absent", "smooth"]) == ["tied", "smooth"]


@pytest.mark.parametrize("limit", [40, 10_000])
def test_medians(spark, limit):
    values = [(float(i), None if i % 3 else i / 7, None) for i in range(100)]
    df = spark.createDataFrame(values, "a double, b double, c double")
    got = risk.median_values(df, ["a", "b", "c"], parts=limit)
    assert got == {"a": 49.5, "b": pytest.approx(np.median([i / 7 for i in range(0, 100, 3)]))}
    filled = risk.impute(df, got)
    assert filled.filter("b is null").count() == 0 and filled.filter("c is null").count() == 100


def test_standardise(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0), (None, 5.0)], "a double, b double")
    got = risk.standardise(df, ["a", "b"]).toPandas()
    want = (np.array([1, 2, 6]) - 3) / np.std([1, 2, 6])
    assert np.allclose(sorted(got["a"].dropna()), want) and (got["b"] == 0).all()


@pytest.mark.parametrize("limit", [60, 10_000])
def test_split_sizes_and_stability(table, data, limit):
    out = risk.stratified_split(table, hot_rows=limit)
    got = out.toPandas()
    assert len(got) == 500
    for y, part in got.groupby(TARGET):
        assert part["is_test"].sum() == math.ceil(0.2 * (data[TARGET] == y).sum())
    again = risk.stratified_split(table.repartition(9), hot_rows=10_000)
    test = {r[STAY] for r in again.filter("is_test").collect()}
    assert test == set(got.loc[got["is_test"], STAY])
    other = risk.stratified_split(table, seed=1).filter("is_test").collect()
    assert test != {r[STAY] for r in other}


def test_split_with_copies(spark):
    df = spark.createDataFrame([(1, 0, 5.0)] * 300 + [(2, 1, 6.0)] * 50,
                               f"{STAY} long, {TARGET} int, x double")
    out = risk.stratified_split(df, hot_rows=20).toPandas()
    assert out.groupby(TARGET)["is_test"].sum().to_dict() == {0: 60, 1: 10} and len(out) == 350


def test_class_weights(table, data):
    got = {r[TARGET]: r for r in risk.class_weights(table).collect()}
    for y in (0, 1):
        n = (data[TARGET] == y).sum()
        assert got[y]["rows"] == n and got[y]["weight"] == pytest.approx(500 / (2 * n))
    assert sum(r["rows"] * r["weight"] for r in got.values()) == pytest.approx(500)
    total = table.withColumn("w", risk.weight_column(table)).agg({"w": "sum"}).first()[0]
    assert total == pytest.approx(500)


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("limit", [3, 10_000])
@pytest.mark.parametrize("score", ["smooth", "tied"])
def test_auc(table, data, score, limit):
    got = risk.roc_auc(table, score, hot_rows=limit if score == "tied" else max(limit, 50))
    want = brute_auc(data[TARGET].values, data[score].values)
    assert got.first()["auc"] == pytest.approx(want)
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol=score, labelCol=TARGET, numBins=0
    )
    assert evaluator.evaluate(table) == pytest.approx(want)


def test_auc_of_one_class(table):
    assert risk.roc_auc(table.filter(f"{TARGET} = 0"), "tied").first()["auc"] is None


def test_class_report(spark):
    pairs = [(0, 0)] * 50 + [(0, 1)] * 10 + [(1, 0)] * 5 + [(1, 1)] * 15 + [(2, 0)] * 4
    df = spark.createDataFrame(pairs, f"{TARGET} int, prediction int")
    got = {r["class"]: r for r in risk.class_report(df).collect()}
    assert got["0"]["precision"] == pytest.approx(50 / 59)
    assert got["1"]["precision"] == pytest.approx(0.6) and got["1"]["recall"] == pytest.approx(0.75)
    assert got["1"]["f1"] == pytest.approx(2 * 0.6 * 0.75 / 1.35)
    assert (got["2"]["precision"], got["2"]["recall"], got["2"]["f1"]) == (0, 0, 0)
    assert got["accuracy"]["f1"] == pytest.approx(65 / 84)
    recalls = [50 / 60, 0.75, 0.0]
    assert got["macro avg"]["recall"] == pytest.approx(sum(recalls) / 3)
    weighted = (recalls[0] * 60 + recalls[1] * 20) / 84
    assert got["weighted avg"]["recall"] == pytest.approx(weighted)
    assert {k: r["support"] for k, r in got.items()} == {
        "0": 60, "1": 20, "2": 4, "accuracy": 84, "macro avg": 84, "weighted avg": 84,
    }


def test_dataset_summary(table, data):
    got = risk.dataset_summary(table).first()
    assert got["rows"] == 500 and got["positive_rate"] == pytest.approx(data[TARGET].mean())


@pytest.mark.parametrize("column", ["smooth", "tied"])
def test_auc_bounds_hold_and_close(table, column):
    exact, width = risk.roc_auc(table, column).first()["auc"], []
    for bins in (1, 8, 100, 100_000):
        row = risk.auc_bounds(table, column, low=-3.0, high=7.0, bins=bins).first()
        assert row["lo"] <= exact <= row["hi"]
        width.append(row["hi"] - row["lo"])
    assert width == sorted(width, reverse=True) and width[0] == 1
    assert width[-1] < (0.01 if column == "smooth" else 0.3)
    none = risk.auc_bounds(table.filter(f"{TARGET} = 1"), column).first()
    assert none["lo"] is None and none["hi"] is None
