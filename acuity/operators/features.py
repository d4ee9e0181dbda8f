"""Per-stay aggregates and the feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acuity import schemas
from acuity.operators.skew import HOT_ROWS, key_shares, left_join
from acuity.sources.storage import ranges_of, stage, write_ranged
from acuity.schemas import STAY


def vitals_per_stay(vitals: DataFrame, key: str = STAY) -> DataFrame:
    """Means, sample deviation and minimum per stay; nulls are skipped.

    The deviation of a single reading is null.
    """
    return vitals.groupBy(key).agg(
        F.avg("heartrate").alias("hr_mean"),
        F.stddev_samp("heartrate").alias("hr_std"),
        F.avg("sao2").alias("sao2_mean"),
        F.min("sao2").alias("sao2_min"),
        F.avg("respiration").alias("resp_mean"),
        F.avg("systemicsystolic").alias("sbp_mean"),
        F.avg("systemicdiastolic").alias("dbp_mean"),
        F.avg("temperature").alias("temp_mean"),
    )


def key_labs(labs: DataFrame, names: Sequence[str] = schemas.KEY_LABS) -> DataFrame:
    """Rows of the named labs, without regard to case."""
    return labs.filter(F.lower("labname").isin([n.lower() for n in names]))


def lab_means_per_stay(
    labs: DataFrame, names: Sequence[str] = schemas.KEY_LABS, key: str = STAY
) -> DataFrame:
    """Mean result per stay and key lab, one sorted ``lab_<name>`` column each.

    The columns are fixed by ``names``, so one aggregation does the pivot and no pass over
    the data is needed to find them.
    """
    name = F.lower("labname")
    return (
        key_labs(labs, names)
        .groupBy(key)
        .agg(
            *[
                F.avg(F.when(name == n, F.col("labresult"))).alias(f"lab_{n}")
                for n in sorted(x.lower() for x in names)
            ]
        )
    )


def dedupe_apache(apache: DataFrame, key: str = STAY) -> DataFrame:
    """One row per stay, the one with the highest score."""
    rest = [c for c in apache.columns if c != key]
    best = F.max(F.struct("apachescore", *[c for c in rest if c != "apachescore"])).alias("best")
    return apache.groupBy(key).agg(best).select(key, *[f"best.{c}" for c in rest])


def feature_table(
    patients: DataFrame,
    apache: DataFrame,
    vitals: DataFrame,
    labs: DataFrame,
    *,
    apache_dedupe: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Patients with severity scores, vital aggregates and lab means, all left-joined.

    Several severity rows of one stay repeat that stay. That join comes last, so until then
    the key counts are those of the patients; all joins share one partitioning by stay. With
    a hot stay a join reads its sides several times, so then the aggregates and each joined
    table are stored first and every source table is still aggregated once. With ``hot_rows``
    None the stays are not counted: bucketed tables, of equal bucket counts, are known to have
    no hot one, and then nothing below the result is exchanged.
    """
    scores = (dedupe_apache(apache) if apache_dedupe else apache).select(
        STAY, "apachescore", "predictedhospitalmortality"
    )
    signs, means = vitals_per_stay(vitals), lab_means_per_stay(labs)
    shares = None if hot_rows is None else key_shares(
        patients, None if apache_dedupe else scores, STAY, hot_rows=hot_rows
    )
    if shares is None:
        once, by_left = (lambda df, name: df), None
    else:
        once, by_left = stage, shares.withColumn("_r", F.lit(1).cast("long"))
    signs, means, scores = once(signs, "signs"), once(means, "means"), once(scores, "scores")
    out = left_join(once(patients, "patients"), signs, STAY, by_left)
    out = left_join(once(out, "with-signs"), means, STAY, by_left)
    out = left_join(once(out, "with-means"), scores, STAY, shares)
    return out.select(
        *patients.columns,
        "apachescore", "predictedhospitalmortality",
        *signs.columns[1:], *means.columns[1:],
    )


def write_back_scores(patients: DataFrame, scores: DataFrame, key: str = STAY,
                      *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Put scores on all rows of a stay; stays without a new score keep what they have.

    ``scores`` has ``risk_score`` and ``prediction``; of several for one stay the highest is
    taken. Store the result under a new path.
    """
    best = scores.groupBy(key).agg(F.max(F.struct("risk_score", "prediction")).alias("_new"))
    shares = key_shares(patients, None, key, hot_rows=hot_rows)
    return left_join(patients, best, key, shares).withColumns(
        {
            "ml_risk_score": F.coalesce(F.col("_new.risk_score"), F.col("ml_risk_score")),
            "ml_prediction": F.coalesce(
                F.col("_new.prediction").cast("int"), F.col("ml_prediction")
            ),
        }
    ).drop("_new")


def update_scores(spark: SparkSession, path: str, scores: DataFrame, *, width: int = 100_000,
                  hot_rows: int = HOT_ROWS) -> list[int]:
    """Put scores onto patients stored by ``write_ranged``; returns the ranges that were rewritten.

    Only ranges with a scored stay are read and written; the files of the others are not
    touched. The new rows are stored apart before they take the place of the old ones, so a
    run that dies before that changes nothing, and one that dies later can be run again.
    """
    touched = ranges_of(scores, key=STAY, width=width)
    if not touched:
        return []
    part = f"{STAY}_range"
    old = spark.read.parquet(path).filter(F.col(part).isin(touched)).drop(part)
    new = stage(write_back_scores(old, scores, hot_rows=hot_rows), "rescored")
    write_ranged(new, path, width=width, only=True)
    return touched
