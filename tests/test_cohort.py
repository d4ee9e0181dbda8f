import pytest

from acuity.operators import cohort
from acuity.schemas import STAY
from acuity.sources import storage

SCHEMA = f"{STAY} long, unittype string, gender string, apachescore double, ml_risk_score double"


@pytest.fixture(scope="module")
def patients(spark):
    return spark.createDataFrame(
        [(3, "MICU", "Female", 60.0, None), (1, "Cardiac_ICU", "Male", 10.0, 0.5),
         (2, "50% unit", "male", 59.9, 0.49), (4, None, "Unknown", None, None),
         (5, r"a\b", "Other", 61.0, 0.1)],
        SCHEMA,
    ).repartition(3)


def stays(df):
    return [r[STAY] for r in df.collect()]


def test_page(patients):
    assert stays(cohort.page(patients, 2, 0)) == [1, 2]
    assert stays(cohort.page(patients, 2, 1)) == [2, 3]
    assert stays(cohort.page(patients, 9, 4)) == [5]
    assert stays(cohort.page(patients, 0, 0)) == []
    with pytest.raises(ValueError):
        cohort.page(patients, -1)


@pytest.mark.parametrize("hot", [1, 2, 1000])
def test_far_page(patients, hot):
    got = cohort.page(patients, 2, 2, near_rows=0, hot_rows=hot)
    assert stays(got) == [3, 4] and got.columns == patients.columns


@pytest.mark.parametrize(
    "text,want",
    [("1", [1]), (" 2 ", [2]), ("+3", [3]), ("-3", []), ("1_0", []), (str(2**70), []),
     ("male", [1, 2, 3]), ("MICU", [3]), ("icu", [1, 3]), ("50%", [2]), ("c_i", [1]),
     ("a\\b", [5]), ("\\", [5]), ("%", [1, 2, 3, 4, 5]), ("", [1, 2, 3, 4, 5]), (None, [1, 2, 3, 4, 5])],
)
def test_search(patients, text, want):
    assert sorted(stays(cohort.search(patients, text))) == want


def test_high_risk_search(patients):
    assert stays(cohort.search_page(patients, high_risk_only=True)) == [1, 3, 5]
    assert stays(cohort.search_page(patients, "male", True, limit=1, offset=1)) == [3]
    with pytest.raises(ValueError):
        cohort.search_page(patients, limit=501)


@pytest.mark.parametrize("limit,offset,want", [(2, 0, 2), (2, 4, 1), (2, 9, 0), (100, 0, 5)])
def test_search_counts(patients, limit, offset, want):
    got = cohort.search_counts(patients, limit=limit, offset=offset).first()
    assert (got["page_rows"], got["total"]) == (want, 5)


def test_patient(patients):
    assert stays(cohort.patient(patients, 4)) == [4]
    with pytest.raises(LookupError):
        cohort.patient(patients, 40)
    assert stays(cohort.patient(patients, 40, must_exist=False)) == []


def test_display_rows(patients):
    got = {r[STAY]: r for r in cohort.display_rows(patients).collect()}
    assert got[1]["risk"] == "yellow" and got[3]["risk"] == "blank"
    assert "outcome" not in got[1].asDict() and "age" not in got[1].asDict()


def test_series_and_events(spark):
    labs = spark.createDataFrame(
        [(1, 60.0, "b", 2.0), (1, 0.0, "a", 1.0), (2, 0.0, "a", 5.0), (1, None, "a", 0.0)],
        f"{STAY} long, labresultoffset double, labname string, labresult double",
    )
    assert [r["labresult"] for r in cohort.labs_of(labs, 1).collect()] == [0.0, 1.0, 2.0]
    lines = cohort.lab_lines(labs, ["b"], [1, 2]).collect()
    assert [tuple(r) for r in lines] == [(1, "b", 1.0, 2.0)]
    vitals = labs.withColumnRenamed("labresultoffset", "observationoffset")
    assert [r[STAY] for r in cohort.vitals_of(vitals).collect()] == [1, 1, 1, 2]
    treatments = spark.createDataFrame(
        [(1, 5.0, "x"), (2, 6.0, "y")], f"{STAY} long, treatmentoffset double, treatmentstring string"
    )
    shown = cohort.with_headings(cohort.treatments_of(treatments, 2), cohort.TREATMENT_HEADINGS)
    assert shown.columns == ["Offset (min)", "Treatment"]
    assert [tuple(r) for r in shown.collect()] == [(6.0, "y")]


@pytest.mark.parametrize("limit", [1, 3, 50])
@pytest.mark.parametrize("reach", [1, 1_000])
def test_pages_by_cursor_are_the_pages_by_offset(spark, limit, reach):
    """Row by row also where rows repeat, keys are null, and gaps between stays are wide."""
    rows = [(s, u, None, 1.0, None) for s in (None, 1, 1, 2, 900, 901, 10**15) for u in (None, "a", "b", "b", "b")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    after, offset, seen = None, 0, []
    while True:
        got = cohort.page_after(df, after, limit, reach=reach).collect()
        assert got == cohort.page(df, limit, offset).collect()
        if not got:
            break
        after, offset = cohort.cursor(got, after), offset + len(got)
        seen += got
        if limit == 1 and offset == 12:  # enough of the small steps
            return
    assert len(seen) == len(rows) and cohort.cursor([], after) == after


def test_next_page_reads_few_rows(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(20_000).selectExpr(f"id AS {STAY}", "'u' AS unittype")
    storage.write_keyed(df, path, [STAY], files=40)
    stored = spark.read.parquet(path)
    page = cohort.page_after(stored, cohort.Cursor({STAY: 11_999, "unittype": "u"}, 1), 50)
    assert [r[STAY] for r in page.collect()] == list(range(12_000, 12_050))
    assert storage.rows_scanned(page) < 3_000
