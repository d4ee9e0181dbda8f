"""Cohort statistics and breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acuity import schemas
from acuity.functions import scalars as S
from acuity.operators.clean import drop_missing
from acuity.operators.skew import percentiles
from acuity.sources.storage import stage
from acuity.schemas import STAY


def cohort_stats(patients: DataFrame) -> DataFrame:
    """Patient count, mortality in percent, mean age and mean severity, in one pass."""
    mortality = F.coalesce(F.avg("hospital_mortality"), F.lit(0.0))
    return patients.agg(
        F.count(F.lit(1)).alias("total_patients"),
        F.round(mortality * 100.0, 2).alias("mortality_rate"),
        S.rounded_or_zero(F.avg("age"), 1).alias("avg_age"),
        S.rounded_or_zero(F.avg("apachescore"), 1).alias("avg_apache_score"),
    )


def patient_count(patients: DataFrame) -> DataFrame:
    return patients.agg(F.count(F.lit(1)).alias("n"))


def unit_breakdown(patients: DataFrame) -> DataFrame:
    """Count, mortality in percent and mean severity per unit, largest first."""
    return (
        patients.groupBy("unittype")
        .agg(
            F.count(F.lit(1)).alias("count"),
            (F.avg("hospital_mortality") * 100.0).alias("mortality_pct"),
            F.avg("apachescore").alias("avg_apache"),
        )
        .orderBy(F.desc("count"), "unittype")
    )


def top_units(patients: DataFrame, n: int = schemas.TOP_UNITS) -> DataFrame:
    return unit_breakdown(patients).limit(n)


def unit_share(patients: DataFrame) -> DataFrame:
    """Each unit's share of all patients. The total is a scalar subquery."""
    units = patients.groupBy("unittype").agg(F.count(F.lit(1)).alias("count"))
    total = units.agg(F.sum("count")).scalar()
    return units.withColumn("share", F.col("count") / total).orderBy(F.desc("count"), "unittype")


def mortality_by_age(patients: DataFrame) -> DataFrame:
    """Count and mortality per age group; ages outside all groups are left out.

    They form one more group that is dropped after the aggregation: a filter ahead of it
    would hardly remove rows.
    """
    age = F.col("age")
    group = F.when(S.in_age_groups(age), S.age_group_number(age))
    return (
        patients.groupBy(group.alias("_group"))
        .agg(
            F.count("hospital_mortality").alias("count"),
            F.round(F.avg("hospital_mortality") * 100.0, 2).alias("mortality_pct"),
            F.count(group).alias("_inside"),
        )
        .filter(F.col("_inside") > 0)
        .orderBy("_group")
        .select(S.age_group_label(F.col("_group")).alias("age_group"), "count", "mortality_pct")
    )


def top_diagnoses(diagnosis: DataFrame, n: int = schemas.TOP_DIAGNOSES) -> DataFrame:
    return (
        diagnosis.groupBy("diagnosisstring")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "diagnosisstring")
        .limit(n)
    )


def with_axis_label(df: DataFrame, column: str = "diagnosisstring", length: int = 50) -> DataFrame:
    """Add the shortened text a chart axis shows (50 characters, 60 on the wide chart)."""
    return df.withColumn("label", S.prefix(F.col(column), length))


def lab_summary(labs: DataFrame) -> DataFrame:
    """Mean, minimum, maximum and number of results per stay and lab, most frequent first."""
    return (
        labs.groupBy(STAY, "labname")
        .agg(
            F.avg("labresult").alias("mean"),
            F.min("labresult").alias("min"),
            F.max("labresult").alias("max"),
            F.count("labresult").alias("count"),
        )
        .orderBy(STAY, F.desc("count"), "labname")
    )


def frequent_labs(
    labs: DataFrame, k: int = schemas.TOP_LABS, selected: int = schemas.DEFAULT_LABS
) -> DataFrame:
    """The ``k`` most frequent labs of each stay; the first few are the default selection."""
    place = F.row_number().over(Window.partitionBy(STAY).orderBy(F.desc("count"), "labname"))
    return (
        labs.groupBy(STAY, "labname")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("place", place)
        .filter(F.col("place") <= k)
        .withColumn("is_default", F.col("place") <= selected)
    )


def box_summary(
    patients: DataFrame, value: str = "apachescore", flag: str = "hospital_mortality", **options
) -> DataFrame:
    """Box-plot numbers of ``value`` by outcome over the whole cohort.

    Exact quartiles with linear interpolation; whiskers end at the last values within 1.5
    times the quartile distance.
    """
    rows = drop_missing(patients, [value, flag]).select(
        S.outcome(F.col(flag)).alias("outcome"), F.col(value).alias("_value")
    )
    quartiles = stage(percentiles(
        rows, ["outcome"], "_value", [0.25, 0.5, 0.75], ["q1", "median", "q3"],
        keep=["rows", "least", "most"], **options,
    ), "quartiles")
    # At most three rows: the two outcomes and neither.
    boxed = rows.join(F.broadcast(quartiles), "outcome")
    v, q1, q3 = F.col("_value"), F.col("q1"), F.col("q3")
    reach = (q3 - q1) * 1.5
    return boxed.groupBy(
        "outcome", "q1", "median", "q3", F.col("rows").alias("count"), F.col("least").alias("min"),
        F.col("most").alias("max"),
    ).agg(
        F.min(F.when(v >= q1 - reach, v)).alias("lower_whisker"),
        F.max(F.when(v <= q3 + reach, v)).alias("upper_whisker"),
    )


#: Size of a quantile sketch: ranks are within about 1.7 % of the rows at 200, 0.9 % at 400.
SKETCH_K = 400


def severity_sketches(
    patients: DataFrame, by: Sequence[str] = ("unittype",), value: str = "apachescore",
    flag: str = "hospital_mortality", *, k: int = SKETCH_K,
) -> DataFrame:
    """A mergeable quantile sketch of ``value`` per group and outcome, with count and bounds.

    A few kilobytes a group whatever its rows. Store the result, add the rows of later
    builds to it, and ask it by :func:`box_of_sketches` for any coarser groups.
    """
    return (
        drop_missing(patients, [value, flag])
        .groupBy(*by, S.outcome(F.col(flag)).alias("outcome"))
        .agg(
            F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"),
            F.count(F.lit(1)).alias("count"),
            F.min(value).alias("min"), F.max(value).alias("max"),
        )
    )


def box_of_sketches(
    sketches: DataFrame, by: Sequence[str] = ("outcome",),
    probs: Sequence[float] = (0.25, 0.5, 0.75), names: Sequence[str] = ("q1", "median", "q3"),
) -> DataFrame:
    """Approximate quartiles per group, with exact count and bounds, from stored sketches alone."""
    merged = sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch").alias("_sketch"),
        F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"),
    )
    return merged.select(
        *by, *[F.kll_sketch_get_quantile_double("_sketch", F.lit(float(p))).alias(n) for p, n in zip(probs, names)],
        "count", "min", "max",
    )


def rank_errors(
    boxes: DataFrame, patients: DataFrame, value: str = "apachescore",
    flag: str = "hospital_mortality", probs: Sequence[float] = (0.25, 0.5, 0.75),
    names: Sequence[str] = ("q1", "median", "q3"),
) -> DataFrame:
    """Per outcome, how far the ranks of approximate quartiles are from those asked for, as a share of rows.

    One aggregation over the rows: a quartile covers the ranks from the share of smaller values
    to that of values not larger.
    """
    rows = drop_missing(patients, [value, flag]).select(
        S.outcome(F.col(flag)).alias("outcome"), F.col(value).alias("_value"))
    # three rows at most: the two outcomes and neither
    met = rows.join(F.broadcast(boxes.select("outcome", *names)), "outcome")
    below = {n: F.avg((F.col("_value") < F.col(n)).cast("double")) for n in names}
    up_to = {n: F.avg((F.col("_value") <= F.col(n)).cast("double")) for n in names}
    worst = F.greatest(F.lit(0.0), *[
        x for p, n in zip(probs, names) for x in (below[n] - p, p - up_to[n])])
    return met.groupBy("outcome").agg(worst.alias("rank_error"))


def box_summary_approx(
    patients: DataFrame, value: str = "apachescore", flag: str = "hospital_mortality",
    *, k: int = SKETCH_K,
) -> DataFrame:
    """Quartiles by outcome from sketches, in one pass without a sort."""
    return box_of_sketches(severity_sketches(patients, (), value, flag, k=k))
