"""Every operator as a query over the test tables, for all stays at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acuity import schemas
from acuity.functions import scalars as S
from acuity.operators import analytics, clean, cohort, features, forest, model, risk, series
from acuity.plans import adapters as A
from acuity.plans import build
from acuity.schemas import STAY, TARGET
from acuity.sources import cache, raw, storage

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

# A small amount on both sides moves exact halves, which engines round differently, off the edge.
DIGITS, NUDGE = 9, 3e-11
# Times are left as they are: each is one division, the same everywhere.
EXACT = ["observationoffset", "time_h"]


def query(build: Query) -> Query:
    """Register a query under its function name, its doubles rounded for comparison."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return S.rounded(build(spark, folder), DIGITS, EXACT, NUDGE)

    CATALOG[build.__name__] = run
    return build


# Cleaning, sources and layout.


@query
def clean_patients(spark, folder):
    return A.patients(spark, folder)


@query
def clean_vitals(spark, folder):
    return A.vitals(spark, folder)


@query
def clean_labs(spark, folder):
    return A.labs(spark, folder)


@query
def clean_keys(spark, folder):
    return A.diagnosis(spark, folder)


@query
def clean_apache(spark, folder):
    return A.apache(spark, folder)


@query
def vitals_for_stays(spark, folder):
    stays = A.patients(spark, folder).filter(F.col("hospital_mortality") == 1)
    return clean.clean_vitals(A.raw_vitals(spark, folder), stays)


@query
def labs_for_stays(spark, folder):
    stays = A.patients(spark, folder).filter(F.col("hospital_mortality") == 1)
    return clean.clean_labs(A.raw_labs(spark, folder), stays)


@query
def finite_output(spark, folder):
    orders = A.table(spark, folder, "orders")
    value = (
        F.when(F.col("o_orderstatus") == "P", float("nan"))
        .when(F.col("o_orderpriority") == "1-URGENT", float("inf"))
        .when(F.col("o_orderpriority") == "2-HIGH", float("-inf"))
        .otherwise(F.col("o_totalprice"))
    )
    return S.finite(orders.select("o_orderkey", value.alias("value")))


@query
def csv_ingest(spark, folder):
    path = storage.scratch_path(spark, "csv")
    A.raw_labs(spark, folder).write.option("header", True).option("compression", "gzip").csv(path)
    columns = [STAY, "labresultoffset", "labname", "labresult"]
    return clean.clean_labs(raw.scan_csv(spark, path, columns))


@query
def keyed_layout(spark, folder):
    path = storage.scratch_path(spark, "keyed")
    storage.write_keyed(A.vitals(spark, folder), path, [STAY, "observationoffset"])
    return spark.read.parquet(path)


@query
def cached_labs(spark, folder):
    """Labs read through the cache twice; the second time nothing may be built."""
    source, path = (storage.scratch_path(spark, name) for name in ("csv", "cache"))
    A.raw_labs(spark, folder).write.option("header", True).csv(source)
    columns = [STAY, "labresultoffset", "labname", "labresult"]

    def again():
        raise RuntimeError("the source has not changed")

    cache.read_through(
        spark, path, lambda: clean.clean_labs(raw.scan_csv(spark, source, columns)), sources=[source])
    return cache.read_through(spark, path, again, sources=[source])


@query
def batch_build(spark, folder):
    """Serving patients of the whole build, from gzip CSV files of all six tables on."""
    source, out = (storage.scratch_path(spark, name) for name in ("raw", "build"))
    for name, make in A.RAW.items():
        rows = make(spark, folder)
        absent = [c for c in schemas.RAW_COLUMNS[name] if c not in rows.columns]
        rows.withColumns({c: F.lit(None).cast("string") for c in absent}).write.option(
            "header", True).option("compression", "gzip").csv(f"{source}/{schemas.RAW_FILES[name]}")
    build.run(spark, source, out, train=False)
    columns = storage.serving_projection(A.feature_table(spark, folder), "patients").columns
    return storage.load_serving(spark, "patients", f"{out}/serving").select(columns)


# Joins, aggregates and features.


@query
def vitals_agg(spark, folder):
    return features.vitals_per_stay(A.vitals(spark, folder))


@query
def lab_pivot(spark, folder):
    return features.lab_means_per_stay(A.labs(spark, folder))


@query
def key_lab_rows(spark, folder):
    return features.key_labs(A.labs(spark, folder))


@query
def patients_apache(spark, folder):
    return A.scored_patients(spark, folder)


@query
def apache_deduped(spark, folder):
    return features.dedupe_apache(A.apache(spark, folder))


@query
def feature_table(spark, folder):
    return A.feature_table(spark, folder)


def _bucketed(spark, tables: dict[str, DataFrame], buckets=16):
    """The tables stored in buckets by stay, and None; or, with a hot stay, as they are, and its limit."""
    stored = {
        name: storage.save_bucketed(df, storage.scratch_table(name), buckets=buckets,
                                    path=storage.scratch_path(spark, name))
        for name, df in tables.items()
    }
    return (tables, storage.HOT_ROWS) if None in stored.values() else (stored, None)


@query
def feature_table_bucketed(spark, folder):
    """The feature table from clean tables that are stored in buckets by stay."""
    tables, hot_rows = _bucketed(spark, {n: f(spark, folder) for n, f in (
        ("patients", A.patients), ("apache", A.apache), ("vitals", A.vitals), ("labs", A.labs))})
    return features.feature_table(**tables, hot_rows=hot_rows)


@query
def forecast_bucketed(spark, folder):
    """The forecast from vitals that are stored in buckets by stay."""
    tables, hot_rows = _bucketed(spark, {"vitals": A.vitals(spark, folder)})
    out = series.forecast(tables["vitals"], hot_rows=hot_rows)
    return out.select(STAY, "vital", "step", "observationoffset", "value")


@query
def patient_summary(spark, folder):
    return storage.serving_projection(A.feature_table(spark, folder), "patients")


# Cohort analytics.


@query
def cohort_stats(spark, folder):
    return analytics.cohort_stats(A.scored_patients(spark, folder))


@query
def patient_count(spark, folder):
    return analytics.patient_count(A.scored_patients(spark, folder))


@query
def unit_breakdown(spark, folder):
    return analytics.unit_breakdown(A.scored_patients(spark, folder))


@query
def unit_top10(spark, folder):
    return analytics.top_units(A.scored_patients(spark, folder))


@query
def unit_share(spark, folder):
    return analytics.unit_share(A.scored_patients(spark, folder))


@query
def mortality_by_age(spark, folder):
    return analytics.mortality_by_age(A.scored_patients(spark, folder))


@query
def top_diagnoses(spark, folder):
    return analytics.top_diagnoses(A.diagnosis(spark, folder))


@query
def diagnosis_labels(spark, folder):
    ranked = analytics.top_diagnoses(A.diagnosis(spark, folder))
    return analytics.with_axis_label(ranked, length=7)


@query
def lab_summary(spark, folder):
    return analytics.lab_summary(A.labs(spark, folder))


@query
def lab_top_k(spark, folder):
    return analytics.frequent_labs(A.labs(spark, folder))


@query
def apache_box(spark, folder):
    return analytics.box_summary(A.scored_patients(spark, folder))


@query
def box_by_sketch(spark, folder):
    """Quartiles merged from stored sketches per unit: exact count and bounds, ranks within 2 %."""
    rows = A.scored_patients(spark, folder)
    stored = storage.stage(analytics.severity_sketches(rows), "sketches")
    boxes = storage.stage(analytics.box_of_sketches(stored), "boxes")
    errors = analytics.rank_errors(boxes, rows)
    return boxes.join(errors, "outcome").select(
        "outcome", "count", "min", "max", (F.col("rank_error") <= 0.02).alias("ranks_close"))


# Search and lookups.


@query
def patient_page(spark, folder):
    return cohort.page(A.scored_patients(spark, folder), limit=100, offset=200)


@query
def patient_page_after(spark, folder):
    """The page behind ``patient_page``, from that page's last row alone."""
    path = storage.scratch_path(spark, "keyed")
    storage.write_keyed(A.scored_patients(spark, folder), path, [STAY])
    stored = spark.read.parquet(path)
    before = cohort.page(stored, limit=100, offset=200).collect()
    return cohort.page_after(stored, cohort.cursor(before), limit=100)


@query
def search_text(spark, folder):
    return cohort.search_page(A.scored_patients(spark, folder), "Build", limit=500, offset=50)


@query
def search_id(spark, folder):
    return cohort.search_page(A.scored_patients(spark, folder), " 42 ")


@query
def search_totals(spark, folder):
    return cohort.search_counts(A.scored_patients(spark, folder), "male", high_risk_only=True)


@query
def high_risk(spark, folder):
    return cohort.search(A.scored_patients(spark, folder), high_risk_only=True)


@query
def patient_lookup(spark, folder):
    stays = A.vitals(spark, folder)
    return clean.restrict_to_stays(A.scored_patients(spark, folder), stays)


@query
def vitals_series(spark, folder):
    return cohort.vitals_of(A.vitals(spark, folder))


@query
def labs_series(spark, folder):
    return cohort.labs_of(A.labs(spark, folder))


#: A caller's list of stays.
_LIST = [37 * k for k in range(1, 201)]


@query
def vitals_of_list(spark, folder):
    """A list of stays from the layout that is sorted by stay."""
    path = storage.scratch_path(spark, "keyed")
    storage.write_keyed(A.vitals(spark, folder), path, [STAY, "observationoffset"])
    return cohort.vitals_of(spark.read.parquet(path), _LIST)


@query
def labs_of_list(spark, folder):
    """The same list from a table in order of arrival, with a Bloom filter on the stay."""
    path = storage.scratch_path(spark, "arrived")
    storage.with_bloom(A.labs(spark, folder).write, STAY).parquet(path)
    return cohort.labs_of(spark.read.parquet(path), _LIST)


@query
def stay_diagnoses(spark, folder):
    found = cohort.diagnoses_of(A.diagnosis(spark, folder), A.vitals(spark, folder))
    return cohort.with_headings(found, cohort.DIAGNOSIS_HEADINGS, [STAY])


@query
def stay_treatments(spark, folder):
    found = cohort.treatments_of(A.treatment(spark, folder), A.vitals(spark, folder))
    return cohort.with_headings(found, cohort.TREATMENT_HEADINGS, [STAY])


@query
def lab_line(spark, folder):
    return cohort.lab_lines(A.labs(spark, folder), ["glucose", "Sodium"])


@query
def display_rows(spark, folder):
    return cohort.display_rows(A.scored_patients(spark, folder))


# Series.


@query
def vital_long(spark, folder):
    return series.long_form(A.vitals(spark, folder))


@query
def downsample(spark, folder):
    return series.downsample(A.vitals(spark, folder), max_points=20)


def _tail(spark, folder, *columns):
    return series.tail_statistics(A.vitals(spark, folder)).select(STAY, "vital", *columns)


@query
def ewm_last(spark, folder):
    return _tail(spark, folder, "ewm")


@query
def tail_std(spark, folder):
    return _tail(spark, folder, "std10")


@query
def trend(spark, folder):
    return _tail(spark, folder, "trend")


@query
def forecast(spark, folder):
    out = series.forecast(A.vitals(spark, folder))
    return out.select(STAY, "vital", "step", "observationoffset", "value")


@query
def forecast_noise(spark, folder):
    out = series.forecast(A.vitals(spark, folder), steps=12, seed=7)
    return out.select(STAY, "vital", "step", "observationoffset", "value")


@query
def forecast_band(spark, folder):
    out = series.forecast(A.vitals(spark, folder))
    return out.select(STAY, "vital", "step", "lower", "upper")


@query
def future_offsets(spark, folder):
    return series.future_offsets(A.vitals(spark, folder))


@query
def history_tail(spark, folder):
    return series.history(A.vitals(spark, folder))


@query
def forecast_line(spark, folder):
    return series.forecast_line(A.vitals(spark, folder))


# Risk.


@query
def encode_features(spark, folder):
    out = risk.encode(A.patients(spark, folder))
    return out.select(STAY, "gender_enc", "unittype_enc")


@query
def risk_label(spark, folder):
    return A.patients(spark, folder).select(
        STAY, "ml_risk_score", S.risk_label(F.col("ml_risk_score")).alias("risk_label")
    )


@query
def risk_band(spark, folder):
    return A.patients(spark, folder).select(
        STAY, "ml_risk_score", S.risk_band(F.col("ml_risk_score")).alias("risk_band")
    )


_NUMBERS = ["age", "admissionheight", "admissionweight", "apachescore", "predictedhospitalmortality"]


@query
def median_impute(spark, folder):
    rows = A.scored_patients(spark, folder).select(STAY, *_NUMBERS)
    return risk.impute(rows, risk.median_values(rows, _NUMBERS))


@query
def standardise(spark, folder):
    rows = A.scored_patients(spark, folder).select(STAY, *_NUMBERS)
    return risk.standardise(rows, _NUMBERS)


@query
def class_weights(spark, folder):
    return risk.class_weights(A.scored_patients(spark, folder))


@query
def auc(spark, folder):
    return risk.roc_auc(A.scored_patients(spark, folder), "admissionweight")


@query
def auc_tied(spark, folder):
    return risk.roc_auc(A.scored_patients(spark, folder), "age")


@query
def auc_bounds(spark, folder):
    """Bounds from a histogram, and whether the exact value lies between them."""
    rows = A.scored_patients(spark, folder)
    exact = risk.roc_auc(rows, "admissionweight").first()["auc"]
    bounds = risk.auc_bounds(rows, "admissionweight", low=45.0, high=100.0, bins=500)
    return bounds.withColumn("holds", F.lit(exact).between(F.col("lo"), F.col("hi")))


@query
def class_report(spark, folder):
    said = (F.col("admissionweight") < 56.0).cast("int").alias("prediction")
    return risk.class_report(A.scored_patients(spark, folder).select(TARGET, said))


@query
def positive_rate(spark, folder):
    return risk.dataset_summary(A.scored_patients(spark, folder))


@query
def stratified_split(spark, folder):
    rows = A.scored_patients(spark, folder).select(STAY, TARGET, "apachescore")
    return risk.stratified_split(rows)


def _stored_model(spark, table, **forest) -> tuple[model.RiskModel, DataFrame]:
    """A model trained on ``table``, stored, and read back with its node table."""
    path = storage.scratch_path(spark, "model")
    model.save(spark, model.train(table, **forest).model, path)
    return model.load(spark, path), model.load_nodes(spark, path)


@query
def rf_score(spark, folder):
    """Every row with the score of the stored forest, its label and its class."""
    table = storage.stage(A.feature_table(spark, folder), "features")
    fitted, _ = _stored_model(spark, table)
    return model.score(table, fitted, digits=None).select(
        STAY, "apachescore", "risk_score", "risk_label", "prediction"
    )


@query
def rf_importance(spark, folder):
    """Importances, from the gains in the stored forest's nodes."""
    return forest.importances(_stored_model(spark, A.feature_table(spark, folder))[1])


# A single tree with two levels has an answer that SQL can find by itself. Its features have so few
# values that every middle between two neighbours is tried as a threshold.
_TREE_FEATURES = ["age", "admissionheight", "admissionweight", "gender_enc", "unittype_enc"]
_TREE = dict(
    features=_TREE_FEATURES, numTrees=1, maxDepth=2, maxBins=128, featureSubsetStrategy="all",
    bootstrap=False,
)


def _tree_rows(spark, folder):
    """Features in whole kilograms; who is tall and over 40, or severely ill, is the class to find."""
    worse = ((F.col("admissionheight") > 170) & (F.col("age") > 40)) | (F.col("apachescore") > 80)
    return storage.stage(A.feature_table(spark, folder).select(
        STAY, "age", "gender", "unittype", "admissionheight", "apachescore",
        F.floor("admissionweight").cast("double").alias("admissionweight"),
        F.coalesce(worse, F.lit(False)).cast("int").alias(TARGET),
    ), "tree-rows")


@query
def tree_score(spark, folder):
    """Training, storage and scoring of one tree: split, medians, codes, weights, forest, nodes."""
    rows = _tree_rows(spark, folder)
    fitted, nodes = _stored_model(spark, rows, **_TREE)
    return model.score_by_nodes(rows, fitted, nodes).select(STAY, "apachescore", "risk_score")


@query
def tree_importance(spark, folder):
    return forest.importances(_stored_model(spark, _tree_rows(spark, folder), **_TREE)[1])


@query
def score_writeback(spark, folder):
    """Scores by formula for every third stay, two for some, written onto the patients."""
    patients = A.patients(spark, folder).select(
        STAY, "ml_risk_score", F.lit(None).cast("int").alias("ml_prediction")
    )
    third = patients.filter(F.col(STAY) % 3 == 0)
    first = third.select(STAY, ((F.col(STAY) * 13) % 1000 / 1000.0).alias("risk_score"))
    second = third.filter(F.col(STAY) % 2 == 0).select(
        STAY, ((F.col(STAY) * 29) % 1000 / 1000.0).alias("risk_score")
    )
    scores = first.unionByName(second).withColumn(
        "prediction", (F.col("risk_score") > 0.5).cast("int")
    )
    return features.write_back_scores(patients, scores)


@query
def score_update(spark, folder):
    """New scores for the stays of some ranges, written into the stored table, read back whole."""
    path, width = storage.scratch_path(spark, "ranged"), 100
    patients = A.patients(spark, folder).select(
        STAY, "ml_risk_score", F.lit(None).cast("int").alias("ml_prediction"))
    storage.write_ranged(patients, path, width=width)
    wanted = (F.floor(F.col(STAY) / width) % 3 == 1) & (F.col(STAY) % 4 == 0)
    scores = patients.filter(wanted).select(
        STAY, (F.col(STAY) * 13 % 1000 / 1000.0).alias("risk_score")
    ).withColumn("prediction", (F.col("risk_score") > 0.5).cast("int"))
    features.update_scores(spark, path, scores, width=width)
    return spark.read.parquet(path).drop(f"{STAY}_range")


HEADLINE = [
    "clean_patients", "clean_vitals", "clean_labs", "vitals_agg", "lab_pivot", "feature_table",
    "cohort_stats", "unit_breakdown", "mortality_by_age", "top_diagnoses", "lab_summary",
    "lab_top_k", "apache_box", "patient_page", "search_text", "vitals_series", "downsample",
    "forecast", "forecast_line", "history_tail", "median_impute", "auc", "stratified_split",
]
