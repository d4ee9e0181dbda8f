"""Every query against its SQL, on the smallest test tables."""

import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402
from acuity.functions import scalars as S  # noqa: E402
from acuity.operators import analytics, cohort, features, risk, series  # noqa: E402
from acuity.plans import adapters as A  # noqa: E402
from acuity.plans import catalog  # noqa: E402
from acuity.schemas import STAY, TARGET  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) or pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype("float64").fillna(-987654.25)
        else:
            df[c] = [("null" if pd.isna(v) else str(v)) for v in df[c]]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, str(FOLDER))
    want = duck.execute(entry.oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(normal(got.toPandas()), normal(want), check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, str(FOLDER)).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["unittype", "count", "mortality_pct", "avg_apache"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_session_time_zone_does_not_matter(spark, duck):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = entry.queries()["vitals_series"](spark, str(FOLDER)).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    want = duck.execute(entry.oracle_sql()["vitals_series"]).df()
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False)


def _hot_features(spark, folder):
    return features.feature_table(
        A.patients(spark, folder), A.apache(spark, folder), A.vitals(spark, folder),
        A.labs(spark, folder), hot_rows=4,
    )


def _hot_split(spark, folder):
    rows = A.scored_patients(spark, folder).select(STAY, TARGET, "apachescore")
    return risk.stratified_split(rows, few=1, hot_rows=100)


# The forms for hot keys, with limits so low that the test tables reach them.
HOT = {
    "feature_table": _hot_features,
    "stratified_split": _hot_split,
    "downsample": lambda s, f: series.downsample(A.vitals(s, f), 20, hot_rows=25),
    "apache_box": lambda s, f: analytics.box_summary(A.scored_patients(s, f), parts=3),
    "auc": lambda s, f: risk.roc_auc(A.scored_patients(s, f), "admissionweight", hot_rows=40),
    "auc_tied": lambda s, f: risk.roc_auc(A.scored_patients(s, f), "age", hot_rows=10),
    "patient_page": lambda s, f: cohort.page(
        A.scored_patients(s, f), 100, 200, near_rows=0, hot_rows=150
    ),
}


@pytest.mark.parametrize("name", sorted(HOT))
def test_hot_form_equals_sql(spark, duck, name):
    got = S.rounded(HOT[name](spark, str(FOLDER)), catalog.DIGITS, catalog.EXACT)
    want = duck.execute(entry.oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(normal(got.toPandas()), normal(want), check_dtype=False)
