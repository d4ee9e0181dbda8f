"""Operators on irregular series: one job answers for all stays at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acuity import schemas
from acuity.functions import scalars as S
from acuity.operators.skew import HOT_ROWS, key_sizes, last_rows, running_total
from acuity.schemas import STAY
from acuity.sources.storage import stage

TIME = "observationoffset"

#: Factor from one value's weight to the next older one's.
DECAY = 1.0 - 2.0 / (schemas.FORECAST_SPAN + 1.0)


def _rest(df: DataFrame, *first: str) -> list[str]:
    return [c for c in df.columns if c not in first]


def long_form(vitals: DataFrame, signs: Sequence[str] = schemas.VITAL_SIGNS) -> DataFrame:
    """One row per stay, time and vital sign that has a value, with the time in hours."""
    present = [c for c in signs if c in vitals.columns]
    return (
        vitals.select(STAY, TIME, *present)
        .unpivot([STAY, TIME], present, "vital", "value")
        .filter(F.col("value").isNotNull())
        .withColumn("time_h", S.hours(F.col(TIME)))
    )


def downsample(
    vitals: DataFrame, max_points: int = schemas.MAX_POINTS, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Keep every k-th row of a stay with more than ``max_points`` rows, from its first.

    k is the row count divided by ``max_points``, rounded down.
    """
    if max_points < 1:
        raise ValueError("max_points must be at least 1")
    order = [F.col(TIME), *[F.col(c) for c in _rest(vitals, STAY, TIME)]]
    placed = running_total(
        vitals, [STAY], order, before="_place", total="_rows", hot_rows=hot_rows
    )
    step = F.greatest(F.floor(F.col("_rows") / max_points), F.lit(1))
    return placed.filter(F.col("_place") % step == 0).select(*vitals.columns)


def with_chunks(vitals: DataFrame, hot_rows: int | None = HOT_ROWS) -> tuple[DataFrame, bool]:
    """``vitals`` dealt by stay, and whether any stay was cut.

    With ``hot_rows`` None they are taken as dealt by stay already, as in a bucketed table.

    A stay with more than ``hot_rows`` rows is cut at about equal shares of its times into
    ``_chunk`` 0, 1, ...; later chunks hold later times only, and rows of one time share a
    chunk. Any cut gives the same results, so approximate shares are enough.
    """
    if hot_rows is None:
        return vitals.withColumn("_chunk", F.lit(0)), False
    hot = key_sizes(vitals, [STAY], hot_rows)
    if hot is None:
        return vitals.withColumn("_chunk", F.lit(0)).repartition(STAY), False
    stays = hot.select(F.col(STAY).alias("_hot"), F.col("rows").alias("_hot_rows"))
    most = math.ceil(stays.agg(F.max("_hot_rows")).first()[0] / hot_rows)
    cuts = (
        vitals.join(stays, F.col(STAY) == F.col("_hot"), "left_semi").groupBy(F.col(STAY).alias("_hot"))
        .agg(F.percentile_approx(TIME, [k / most for k in range(1, most)]).alias("_cuts"))
    )
    cut = vitals.join(stage(cuts, "cuts"), F.col(STAY) == F.col("_hot"), "left")
    later = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(TIME))), F.lit(0))
    rows = cut.withColumn("_chunk", F.when(F.col("_hot").isNull(), 0).otherwise(later))
    return rows.drop("_hot", "_cuts").repartition(STAY, "_chunk"), True


def tail_chunks(
    vitals: DataFrame, signs: Sequence[str] = schemas.FORECAST_VITALS, *, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """What a chunk of a series tells about its end: one row per stay, chunk and vital.

    ``rows`` counts values, ``mass`` is their sum with weights that fall by ``DECAY`` from the
    newest of the chunk on, ``weight`` the sum of those weights, ``newest`` the values that
    a deviation or trend may need. Two neighbouring chunks merge without their readings: the
    older one's sums are multiplied by ``DECAY`` to the number of rows in the newer one.
    Readings move once, as whole rows; the signs are told apart behind the exchange. The
    last sign stands for the reading itself, whatever values it has.
    """
    rows, cut = with_chunks(vitals, hot_rows)
    # Numbers in place of the names: all signs of a stay are sorted by them.
    coded = F.stack(
        F.lit(len(signs) + 1),
        *[c for i, name in enumerate(signs) for c in (F.lit(i), F.col(name).cast("double"))],
        F.lit(len(signs)), F.lit(0.0),
    ).alias("_vital", "value")
    long = rows.select(STAY, "_chunk", TIME, coded).filter(F.col("value").isNotNull())
    key = [STAY, "_chunk", "_vital"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(TIME), F.desc("value")))
    value = F.col("value")
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    weight = F.pow(F.lit(DECAY), (F.col("place") - 1).cast("double"))
    kept = F.when(F.col("place") <= schemas.FORECAST_STD_ROWS, F.struct("place", "value"))
    chunks = long.withColumn("place", place).groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(finite * weight).alias("mass"),
        F.sum(F.when(finite.isNotNull(), weight)).alias("weight"),
        F.transform(F.array_sort(F.collect_list(kept)), lambda e: e["value"]).alias("newest"),
        F.max(TIME).alias("end"),
    )
    return chunks.repartition(STAY) if cut else chunks


def tail_statistics(
    vitals: DataFrame, signs: Sequence[str] = schemas.FORECAST_VITALS, *, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Per stay and vital: weighted mean, deviation and trend at the end of the series.

    ``ewm`` is the exponentially weighted mean of span 5 with adjusted weights at the last
    value, ``std10`` the sample deviation of the last 10 values, ``trend`` the mean step
    over the last 5, ``kept`` the number of values, ``last`` the time of the stay's last
    reading. An infinite value is left out of the weighted mean but keeps its place.
    """
    by_sign = Window.partitionBy(STAY, "_vital")
    newer = by_sign.orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = tail_chunks(vitals, signs, hot_rows=hot_rows).withColumn(
        "_newer", F.coalesce(F.sum("rows").over(newer), F.lit(0))
    )
    faded = F.pow(F.lit(DECAY), F.col("_newer").cast("double"))
    ends = F.array_sort(F.collect_list(F.struct("_newer", "newest")))
    merged = chunks.groupBy(STAY, "_vital").agg(
        F.sum("rows").alias("kept"),
        (F.sum(F.col("mass") * faded) / F.sum(F.col("weight") * faded)).alias("ewm"),
        F.slice(F.flatten(F.transform(ends, lambda e: e["newest"])), 1, schemas.FORECAST_STD_ROWS)
        .alias("_tail"),
        F.max("end").alias("_end"),
    )
    tail, many = F.col("_tail"), F.size("_tail")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    mean = total(tail) / many
    spread = total(F.transform(tail, lambda x: (x - mean) * (x - mean)))
    span = F.least(many, F.lit(schemas.FORECAST_TREND_ROWS))
    names = F.array(*[F.lit(name) for name in signs])
    return merged.select(
        STAY, "_vital", F.get(names, F.col("_vital")).alias("vital"), "kept", "ewm",
        F.when(many > 1, F.sqrt(spread / (many - 1))).alias("std10"),
        ((F.get(tail, F.lit(0)) - F.get(tail, span - 1)) / F.greatest(span - 1, F.lit(1))).alias("trend"),
        F.max("_end").over(Window.partitionBy(STAY)).alias("last"),
    ).filter(F.col("_vital") < len(signs)).drop("_vital")


def future_offsets(vitals: DataFrame, steps: int = 6) -> DataFrame:
    """Times of the next ``steps`` readings, five minutes apart, after the last row."""
    _check_steps(steps)
    return (
        vitals.groupBy(STAY)
        .agg(F.max(TIME).alias("_last"))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
        .select(STAY, "step", (F.col("_last") + F.col("step") * schemas.STEP_MINUTES).alias(TIME))
    )


def _check_steps(steps: int) -> None:
    if steps < 1:
        raise ValueError("steps must be at least 1")


def forecast(
    vitals: DataFrame, steps: int = 6, *, seed: int | None = None,
    signs: Sequence[str] = schemas.FORECAST_VITALS, hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """The next ``steps`` values of each vital with at least three readings, with a band.

    Every step adds 0.3 of the trend, and, given a ``seed``, normal noise of 0.2 of the
    deviation, which builds up over the steps. The band is one deviation to either side.
    """
    return _forecast(vitals, steps, 1, seed, signs, hot_rows)


def _forecast(
    vitals: DataFrame, steps: int, first: int, seed: int | None, signs: Sequence[str],
    hot_rows: int | None,
) -> DataFrame:
    """Steps ``first`` to ``steps`` of the forecast; step 0 stands at the last reading."""
    _check_steps(steps)
    stats = tail_statistics(vitals, signs, hot_rows=hot_rows).filter(F.col("kept") >= schemas.FORECAST_MIN_ROWS)
    ahead = stats.withColumn("step", F.explode(F.sequence(F.lit(first), F.lit(steps))))
    value = F.col("ewm") + F.col("trend") * schemas.FORECAST_TREND_SHARE * F.col("step")
    if seed is not None:
        key = F.concat_ws("|", STAY, "vital", "step", F.lit(str(seed)))
        so_far = (
            Window.partitionBy(STAY, "vital")
            .orderBy("step")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        draw = S.standard_normal(key) * F.coalesce(F.col("std10"), F.lit(0.0))
        drawn = F.when(F.col("step") > 0, draw * schemas.FORECAST_NOISE_SHARE).otherwise(0.0)
        value = value + F.sum(drawn).over(so_far)
    return ahead.withColumn("value", F.round(value, 2)).select(
        STAY, "vital", "step",
        (F.col("last") + F.col("step") * schemas.STEP_MINUTES).alias(TIME),
        "value",
        (F.col("value") - F.col("std10")).alias("lower"),
        (F.col("value") + F.col("std10")).alias("upper"),
    )


def forecast_arrays(predicted: DataFrame) -> DataFrame:
    """The forecast of a stay as one map from vital to its values in step order."""
    steps = F.array_sort(F.collect_list(F.struct("step", "value")))
    return (
        predicted.groupBy(STAY, "vital")
        .agg(F.transform(steps, lambda s: s["value"]).alias("values"))
        .groupBy(STAY)
        .agg(F.map_from_entries(F.collect_list(F.struct("vital", "values"))).alias("forecast"))
    )


def _newest_first(vitals: DataFrame) -> list:
    return [F.desc(c) for c in (TIME, *_rest(vitals, STAY, TIME))]


def history(vitals: DataFrame, rows: int = schemas.HISTORY_ROWS) -> DataFrame:
    """The last rows of each stay, missing values included, with the time in hours."""
    tail = last_rows(vitals, [STAY], _newest_first(vitals), rows)
    return tail.withColumn("time_h", S.hours(F.col(TIME))).select(
        *vitals.columns, "time_h", "place"
    )


def forecast_line(
    vitals: DataFrame, steps: int = 6, *, seed: int | None = None,
    signs: Sequence[str] = schemas.FORECAST_VITALS, hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """The line a chart draws: the last reading as step 0, then the forecast."""
    grid = _forecast(vitals, steps, 0, seed, signs, hot_rows)
    row = F.max(F.struct(TIME, *_rest(vitals, STAY, TIME))).alias("_row")
    last = vitals.groupBy(STAY).agg(row).select(
        STAY, *[F.col(f"_row.{name}").alias(f"_at_{name}") for name in signs]
    )
    at = F.coalesce(*[
        F.when(F.col("vital") == name, F.col(f"_at_{name}")) for name in signs
    ])
    return grid.join(last, STAY).select(
        STAY, "vital", "step", S.hours(F.col(TIME)).alias("time_h"),
        F.when(F.col("step") == 0, at).otherwise(F.col("value")).alias("value"),
    )
