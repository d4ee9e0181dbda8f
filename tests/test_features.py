import statistics

from acuity import schemas
from acuity.operators import features, series
from acuity.schemas import STAY
from acuity.sources import storage


def vitals(spark, rows):
    """Rows of (stay, offset, heartrate, sao2)."""
    full = [(s, o, h, None, o2, None, None, None, None) for s, o, h, o2 in rows]
    return spark.createDataFrame(full, schemas.VITALS)


def test_vitals_per_stay(spark):
    df = vitals(spark, [(1, 0.0, 80.0, 95.0), (1, 5.0, 90.0, None), (1, 9.0, None, 91.0),
                        (2, 0.0, 70.0, None)])
    got = {r[STAY]: r for r in features.vitals_per_stay(df).collect()}
    assert got[1]["hr_mean"] == 85 and got[1]["hr_std"] == statistics.stdev([80, 90])
    assert got[1]["sao2_mean"] == 93 and got[1]["sao2_min"] == 91
    assert got[2]["hr_mean"] == 70 and got[2]["hr_std"] is None and got[2]["sao2_min"] is None
    assert got[1].asDict().keys() == {STAY, *schemas.VITAL_AGGREGATES}


def test_lab_means_ignore_case_and_other_labs(spark):
    df = spark.createDataFrame(
        [(1, "glucose", 100.0), (1, "Glucose", 200.0), (1, "GLUCOSE", None), (1, "alt", 5.0),
         (2, "WBC", 9.0), (3, "alt", 1.0)],
        f"{STAY} long, labname string, labresult double",
    )
    out = features.lab_means_per_stay(df)
    assert out.columns == [STAY, *sorted(f"lab_{n}" for n in schemas.KEY_LABS)]
    got = {r[STAY]: r for r in out.collect()}
    assert set(got) == {1, 2}
    assert got[1]["lab_glucose"] == 150 and got[1]["lab_wbc"] is None and got[2]["lab_wbc"] == 9


def tables(spark):
    patients = spark.createDataFrame([(1, 60.0), (2, 70.0), (3, 50.0)], f"{STAY} long, age double")
    apache = spark.createDataFrame(
        [(1, 40.0, 0.1), (1, 55.0, 0.3), (2, 80.0, None), (9, 1.0, 0.0)],
        f"{STAY} long, apachescore double, predictedhospitalmortality double",
    )
    signs = vitals(spark, [(1, 0.0, 80.0, 95.0), (3, 0.0, 60.0, 99.0), (8, 0.0, 1.0, 99.0)])
    labs = spark.createDataFrame(
        [(2, "sodium", 140.0)], f"{STAY} long, labname string, labresult double"
    )
    return patients, apache, signs, labs


def test_feature_table_repeats_stays_with_several_results(spark, rows):
    out = features.feature_table(*tables(spark))
    wanted = [STAY, "apachescore", "hr_mean", "lab_sodium"]
    assert rows(out, *wanted) == [
        (1, 40.0, 80.0, None), (1, 55.0, 80.0, None), (2, 80.0, None, 140.0),
        (3, None, 60.0, None),
    ]
    assert out.columns[:4] == [STAY, "age", "apachescore", "predictedhospitalmortality"]


def test_feature_table_spread_and_plain_agree(spark, rows):
    plain = rows(features.feature_table(*tables(spark)), STAY, "apachescore", "hr_mean")
    spread = rows(features.feature_table(*tables(spark), hot_rows=1), STAY, "apachescore", "hr_mean")
    assert spread == plain


def test_feature_table_dedupe(spark, rows):
    out = features.feature_table(*tables(spark), apache_dedupe=True)
    assert rows(out, STAY, "apachescore", "predictedhospitalmortality") == [
        (1, 55.0, 0.3), (2, 80.0, None), (3, None, None),
    ]


def test_write_back(spark, rows):
    patients = spark.createDataFrame(
        [(1, None, None), (1, 0.2, 0), (2, 0.9, 1), (3, None, None)],
        f"{STAY} long, ml_risk_score double, ml_prediction int",
    )
    scores = spark.createDataFrame(
        [(1, 0.3, 0), (1, 0.6, 1), (3, 0.1, 0), (7, 0.5, 1)],
        f"{STAY} long, risk_score double, prediction int",
    )
    out = features.write_back_scores(patients, scores)
    assert rows(out) == [(1, 0.6, 1), (1, 0.6, 1), (2, 0.9, 1), (3, 0.1, 0)]
    assert dict(out.dtypes)["ml_prediction"] == "int"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bucketed_tables_are_joined_in_place(spark, tmp_path):
    """Aggregates, joins and series by stay read the buckets side by side."""
    patients, apache, vitals, labs = (
        spark.createDataFrame([(i % 40, *more) for i in range(200)], f"{STAY} long, {schema}")
        for more, schema in (
            ((1,), "x int"), ((5.0, 0.5), "apachescore double, predictedhospitalmortality double"),
            ((1.0,) * 8, "observationoffset double, heartrate double, respiration double, sao2 double,"
                         "systemicsystolic double, systemicdiastolic double, temperature double, cvp double"),
            (("Sodium", 3.0), "labname string, labresult double"),
        )
    )
    patients = patients.distinct()
    sides = {}
    for name, df in (("patients", patients), ("apache", apache), ("vitals", vitals), ("labs", labs)):
        sides[name] = storage.save_bucketed(df, f"t_{name}", buckets=5, path=str(tmp_path / name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else tables as small as these are sent whole
    try:
        stored = features.feature_table(**sides, hot_rows=None)
        loose = features.feature_table(patients, apache, vitals, labs)
        assert exchanges(stored) == 0 < exchanges(loose)
        assert sorted(map(str, stored.collect())) == sorted(map(str, loose.collect()))
        tail = series.forecast(sides["vitals"], hot_rows=None)
        assert exchanges(tail) == 0 and tail.count() == series.forecast(vitals).count() == 40 * 5 * 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in sides:
            spark.sql(f"DROP TABLE t_{name}")
    assert storage.save_bucketed(apache, "t_hot", hot_rows=4) is None


def test_only_touched_ranges_are_rewritten(spark, rows, tmp_path):
    path = tmp_path / "ranged"
    patients = spark.createDataFrame(
        [(i, 0.1, None) for i in range(100)] + [(7, 0.2, 1)], f"{STAY} long, ml_risk_score double, ml_prediction int")
    storage.write_ranged(patients, str(path), width=10)
    when = lambda: {f: f.stat().st_mtime_ns for f in sorted(path.rglob("*.parquet"))}
    before = when()
    scores = spark.createDataFrame(
        [(7, 0.9, 1), (7, 0.8, 1), (55, 0.3, 0), (10_000, 0.5, 1), (None, 0.5, 1)],
        f"{STAY} long, risk_score double, prediction int")
    assert features.update_scores(spark, str(path), scores, width=10) == [0, 5, 1000]
    after = when()
    kept = {f for f in before if after.get(f) == before[f]}
    assert {f.parent.name for f in kept} == {f"{STAY}_range={k}" for k in range(10) if k not in (0, 5)}
    got = spark.read.parquet(str(path)).drop(f"{STAY}_range")
    assert rows(got) == rows(features.write_back_scores(patients, scores))
    assert features.update_scores(spark, str(path), scores.limit(0), width=10) == [] and when() == after
