import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from acuity import schemas
from acuity.operators import clean
from acuity.schemas import STAY
from acuity.sources import storage
from acuity.sources.raw import scan_csv, scan_table

NAN = float("nan")


def test_patients(spark):
    raw = spark.createDataFrame(
        [("1", "> 89", None, None, "Expired", "170.5"), (None, "n/a", "Male", "X", None, "tall")],
        f"{STAY} string, age string, gender string, ethnicity string, "
        "hospitaldischargestatus string, admissionheight string",
    )
    out = clean.clean_patients(raw)
    assert dict(out.dtypes) == {
        STAY: "bigint", "age": "double", "gender": "string", "ethnicity": "string",
        "admissionheight": "double", "hospitaldischargestatus": "string",
        "hospital_mortality": "int",
    }
    got = [r.asDict() for r in out.collect()]
    assert [(r[STAY], r["age"], r["gender"], r["ethnicity"], r["hospital_mortality"]) for r in got] \
        == [(1, 90.0, "Unknown", "Unknown", 1), (None, None, "Male", "X", 0)]
    assert [r["admissionheight"] for r in got] == [170.5, None]


@pytest.mark.parametrize(
    "name,value,kept",
    [("heartrate", 0.0, True), ("heartrate", 300.0, True), ("heartrate", 300.1, False),
     ("heartrate", -0.1, False), ("heartrate", None, True), ("heartrate", NAN, True),
     ("sao2", 49.9, False), ("sao2", 50.0, True), ("sao2", 100.0, True),
     ("temperature", 25.0, True), ("temperature", 45.0, True), ("temperature", 45.1, False),
     ("respiration", 1e6, True), ("heartrate", float("inf"), False)],
)
def test_vitals_ranges(spark, name, value, kept):
    values = {c: None for c in schemas.VITAL_SIGNS} | {name: value}
    raw = spark.createDataFrame([(7, 5.0, *values.values())], schemas.VITALS)
    out = clean.clean_vitals(raw).collect()
    assert len(out) == kept
    if kept and value is not None and value != value:
        assert out[0][name] is None


def test_text_and_double_vitals_agree(spark):
    raw = spark.createDataFrame([("3", "5", "80", None, "40", None, None, None, "x"),
                                 ("x", "5", "80", None, "99", None, None, None, "1")],
                                ", ".join(f"{c} string" for c in schemas.VITALS_COLUMNS))
    assert clean.clean_vitals(raw).count() == 0  # saturation 40 and a bad key


def test_labs_drop_missing_before_parsing(spark):
    raw = spark.createDataFrame(
        [("1", "0", "glucose", "1.5"), ("1", "1", "Glucose", "<5"), ("1", "2", "wbc", None),
         ("x", "3", "wbc", "2")],
        f"{STAY} string, labresultoffset string, labname string, labresult string",
    )
    got = clean.clean_labs(raw).orderBy("labresultoffset").collect()
    assert [(r[STAY], r["labname"], r["labresult"]) for r in got] == [
        (1, "glucose", 1.5), (1, "Glucose", None),
    ]
    numbers = spark.createDataFrame([(1, 2.0), (1, NAN), (2, None)], f"{STAY} long, labresult double")
    assert clean.clean_labs(numbers).count() == 1


def test_keys(spark, rows):
    raw = spark.createDataFrame([("12",), ("12.7",), ("x",), (None,)], f"{STAY} string")
    want = [(12,), (12,)]
    assert rows(clean.coerce_key(raw)) == want
    for cleaner in (clean.clean_diagnosis, clean.clean_treatment, clean.clean_apache):
        assert rows(cleaner(raw)) == want


def test_restrict_to_stays(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,)], f"{STAY} long")
    stays = spark.createDataFrame([(2,), (2,), (9,)], f"{STAY} long")
    assert rows(clean.restrict_to_stays(df, stays)) == [(2,), (2,)]
    assert rows(clean.restrict_to_stays(df, [1, 3])) == [(1,), (3,)]
    assert rows(clean.restrict_to_stays(df, 2)) == [(2,), (2,)]
    assert clean.restrict_to_stays(df, None) is df


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "vitals")
    spark.createDataFrame([(1, 5.0, *[70.0] * 7)], schemas.VITALS).write.parquet(path)
    stored = spark.read.parquet(path)
    plan = clean.clean_vitals(stored, 1)._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo({STAY},1)" in plan
    ranged = clean.drop_implausible(stored).select("heartrate")
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(heartrate,300.0)" in plan and "cvp" not in plan


def test_csv_scan(spark, tmp_path):
    # Columns in another order, an extra one, doubled quotes, a comma inside quotes.
    (tmp_path / "a.csv").write_text(
        'labname,extra,patientunitstayid,labresult\n'
        '"a ""b"", c",z,1,NA\n'
        'plain,z,2,""\n'
        'N/A,z,3,4.5\n'
    )
    out = scan_csv(spark, str(tmp_path / "a.csv"), [STAY, "labname", "labresult"])
    assert [tuple(r) for r in out.orderBy(STAY).collect()] == [
        ("1", 'a "b", c', None), ("2", "plain", None), ("3", None, "4.5"),
    ]
    with pytest.raises(AnalysisException):
        scan_csv(spark, str(tmp_path / "a.csv"), ["absent"])
    with pytest.raises(AnalysisException):
        scan_csv(spark, str(tmp_path / "absent.csv"), [STAY])


def test_csv_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "b.csv").write_text('k,v\n1,"x\ny"\n')
    out = scan_csv(spark, str(tmp_path / "b.csv"), ["k", "v"])
    assert [tuple(r) for r in out.collect()] == [("1", "x\ny")]


def test_gzip_spread(spark, tmp_path):
    import gzip

    header = ",".join(schemas.TREATMENT_COLUMNS)
    lines = [f"{i},{i},t{i}" for i in range(1000)]
    with gzip.open(tmp_path / schemas.RAW_FILES["treatment"], "wt") as f:
        f.write("\n".join([header, *lines]) + "\n")
    full = scan_table(spark, str(tmp_path), "treatment", partitions=8)
    assert full.count() == 1000
    sizes = full.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8
    by_default = scan_table(spark, str(tmp_path), "treatment")
    assert by_default.groupBy(F.spark_partition_id()).count().count() == 4


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 25, 600])
def test_lists_of_stays(spark, rows, n):
    """Short and long lists, with repeats, keep the same rows; short ones reach the scan."""
    df = spark.range(1000).selectExpr(f"id AS {STAY}").unionByName(
        spark.createDataFrame([(None,), (5,)], f"{STAY} long"))
    wanted = [3 * i for i in range(n)]
    got = [r[0] for r in rows(clean.restrict_to_stays(df, wanted + wanted[:2]))]
    assert got == sorted(w for w in wanted if w < 1000)


def test_a_list_skips_row_groups(spark, tmp_path):
    """Rows read against rows found, with Bloom filters in unsorted files, and in the sorted layout."""
    stays = [(i * 7919) % 20_000 for i in range(20_000)]  # every stay once, far from any order
    rows = spark.createDataFrame([(s, float(s)) for s in stays], f"{STAY} long, value double")
    arrived, keyed, plain = (str(tmp_path / n) for n in ("arrived", "keyed", "plain"))
    storage.with_bloom(rows.repartition(40).write, STAY, 500).parquet(arrived)
    rows.repartition(40).write.parquet(plain)
    storage.write_keyed(rows, keyed, [STAY], files=40)
    wanted = [11, 12, 13, *range(14_000, 14_020)]
    read = {}
    for name, path in (("arrived", arrived), ("keyed", keyed), ("plain", plain)):
        found = clean.restrict_to_stays(spark.read.parquet(path), wanted)
        assert "PushedFilters: [Or(" in found._jdf.queryExecution().executedPlan().toString().replace("...", "")
        assert sorted(r[STAY] for r in found.collect()) == sorted(wanted)
        read[name] = storage.rows_scanned(found)
    assert read["plain"] == 20_000 and read["keyed"] <= 2_000 and read["arrived"] < 15_000
    one = clean.restrict_to_stays(spark.read.parquet(arrived), [14_000])
    assert one.count() == 1 and one.collect() and storage.rows_scanned(one) < 3_000
