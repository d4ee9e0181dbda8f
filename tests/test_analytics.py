import numpy as np
import pytest
from pyspark.sql import functions as F

from acuity.operators import analytics, cohort
from acuity.schemas import STAY

SCHEMA = f"{STAY} long, age double, unittype string, apachescore double, hospital_mortality int"


@pytest.fixture(scope="module")
def patients(spark):
    return spark.createDataFrame(
        [(1, 18.0, "MICU", 50.0, 1), (2, 0.0, "MICU", None, 0), (3, 90.0, None, 70.0, 0),
         (4, None, "SICU", 30.0, 1), (5, 60.0, "SICU", 40.0, 0), (6, 45.0, None, 90.0, 0),
         (7, 59.0, "CCU", 10.0, 0)],
        SCHEMA,
    )


def test_stats(patients):
    got = analytics.cohort_stats(patients).first().asDict()
    assert got == {"total_patients": 7, "mortality_rate": 28.57, "avg_age": 45.3,
                   "avg_apache_score": 48.3}


def test_stats_of_nothing(patients):
    got = analytics.cohort_stats(patients.limit(0)).first().asDict()
    assert got == {"total_patients": 0, "mortality_rate": 0.0, "avg_age": 0.0,
                   "avg_apache_score": 0.0}
    assert analytics.patient_count(patients.limit(0)).first()["n"] == 0


def test_units(patients):
    got = [tuple(r) for r in analytics.unit_breakdown(patients).collect()]
    assert got == [(None, 2, 0.0, 80.0), ("MICU", 2, 50.0, 50.0), ("SICU", 2, 50.0, 35.0),
                   ("CCU", 1, 0.0, 10.0)]
    assert [r[0] for r in analytics.top_units(patients, 2).collect()] == [None, "MICU"]
    shares = [r["share"] for r in analytics.unit_share(patients).collect()]
    assert np.allclose(shares, [2 / 7, 2 / 7, 2 / 7, 1 / 7])


def test_mortality_by_age(patients):
    got = [tuple(r) for r in analytics.mortality_by_age(patients).collect()]
    assert got == [("<18", 1, 100.0), ("40-60", 3, 0.0), ("75+", 1, 0.0)]


def test_top_diagnoses(spark):
    names = ["b"] * 3 + ["a"] * 3 + ["c"] * 2 + ["d" * 60]
    df = spark.createDataFrame([(n,) for n in names], "diagnosisstring string")
    top = analytics.top_diagnoses(df, 3)
    assert [tuple(r) for r in top.collect()] == [("a", 3), ("b", 3), ("c", 2)]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
    label = analytics.with_axis_label(analytics.top_diagnoses(df)).collect()[-1]["label"]
    assert label == "d" * 50


def test_labs(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (1, "a", 3.0), (1, "b", None), (1, "b", None), (1, "b", 2.0), (2, "c", None)],
        f"{STAY} long, labname string, labresult double",
    )
    got = [tuple(r) for r in analytics.lab_summary(df).collect()]
    assert got == [(1, "a", 2.0, 1.0, 3.0, 2), (1, "b", 2.0, 2.0, 2.0, 1),
                   (2, "c", None, None, None, 0)]
    shown = cohort.with_headings(analytics.lab_summary(df), cohort.LAB_SUMMARY_HEADINGS, [STAY])
    assert shown.columns == [STAY, "Lab Test", "Mean", "Min", "Max", "Count"]
    frequent = analytics.frequent_labs(df, k=2, selected=1).orderBy(STAY, "place").collect()
    assert [tuple(r) for r in frequent] == [(1, "b", 3, 1, True), (1, "a", 2, 2, False),
                                            (2, "c", 1, 1, True)]


@pytest.mark.parametrize("limit", [20, 10_000])
def test_box_summary(spark, limit):
    rng = np.random.default_rng(1)
    data = {0: rng.normal(50, 10, 200).round(1), 1: rng.normal(80, 20, 90).round(1)}
    data[1][:2] = [300.0, -200.0]
    flat = [(1, None, None, float(v), k) for k, vs in data.items() for v in vs]
    df = spark.createDataFrame([*flat, (1, None, None, None, 1), (1, None, None, 5.0, None)], SCHEMA)
    got = {r["outcome"]: r for r in analytics.box_summary(df, parts=limit).collect()}
    for k, name in ((0, "Survived"), (1, "Expired")):
        q1, median, q3 = np.quantile(data[k], [0.25, 0.5, 0.75])
        reach = 1.5 * (q3 - q1)
        row = got[name]
        assert np.allclose([row["q1"], row["median"], row["q3"]], [q1, median, q3])
        assert row["lower_whisker"] == min(v for v in data[k] if v >= q1 - reach)
        assert row["upper_whisker"] == max(v for v in data[k] if v <= q3 + reach)
        assert (row["count"], row["min"], row["max"]) == (len(data[k]), min(data[k]), max(data[k]))
    near = {r["outcome"]: r for r in analytics.box_summary_approx(df).collect()}
    assert abs(near["Expired"]["median"] - got["Expired"]["median"]) < 2


def test_sketches_merge_and_stay_close(spark, tmp_path):
    """Sketches per unit, stored in two builds, answer for all rows; ranks keep to the bound."""
    rng = np.random.default_rng(5)
    rows = [(f"u{i % 7}", int(i % 3 == 0), float(x)) for i, x in enumerate(rng.lognormal(3, 1, 20_000))]
    df = spark.createDataFrame(rows + [("u0", 1, None), ("u0", None, 3.0)],
                               "unittype string, hospital_mortality int, apachescore double").repartition(5)
    path = str(tmp_path / "sketches")
    for half in (0, 1):
        part = df.filter(F.pmod(F.xxhash64("apachescore"), F.lit(2)) == half)
        analytics.severity_sketches(part).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() <= 2 * 7 * 2 and stored.select(F.max(F.length("sketch"))).first()[0] < 20_000
    boxes = analytics.box_of_sketches(stored)
    errors = {r["outcome"]: r["rank_error"] for r in analytics.rank_errors(boxes, df).collect()}
    assert errors.keys() == {"Expired", "Survived"} and max(errors.values()) < 0.02
    counts = {r["outcome"]: (r["count"], r["min"], r["max"]) for r in boxes.collect()}
    for outcome, y in (("Expired", 1), ("Survived", 0)):
        values = [x for _, f, x in rows if f == y]
        assert counts[outcome] == (len(values), min(values), max(values))
    off = boxes.withColumn("median", F.col("q3"))
    assert min(r["rank_error"] for r in analytics.rank_errors(off, df).collect()) > 0.2
    assert analytics.box_summary_approx(df.limit(0)).isEmpty()
