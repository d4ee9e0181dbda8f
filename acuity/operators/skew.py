"""Operators that stay exact and parallel when one key holds much of the data.

Each takes the plain Spark form while every key has at most ``hot_rows`` rows, which one
task can hold. Beyond that, only the hot keys take the spread form, whose tasks hold about
``hot_rows`` rows whatever the key.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acuity.sources.storage import HOT_ROWS, stage

_UID, _PART, _BASE, _SHARE = "_acuity_uid", "_acuity_part", "_acuity_base", "_acuity_share"


def _before(by: Sequence[str], order: Sequence[Column]) -> Window:
    return (
        Window.partitionBy(*by)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def _same(by: Sequence[str], other: str) -> Column:
    """Keys equal to their ``other``-prefixed twins, a null key to a null key."""
    tests = [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in by]
    return functools.reduce(Column.__and__, tests)


def key_sizes(df: DataFrame, by: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, stored; None if there are none.

    Counts combine before the shuffle, and no more than rows / hot_rows keys can pass.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > hot_rows)
    return None if sizes.isEmpty() else stage(sizes, "hot")


def running_total(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    measure: Column | None = None,
    *,
    before: str = "before",
    total: str = "total",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the sum of ``measure`` over the earlier rows of the key, and over all its rows.

    Without a measure these are a row's 0-based place and the key's row count. ``order``
    should leave no ties; an empty ``by`` takes all rows as one key.
    """
    args = dict(by=list(by), order=list(order), measure=measure, before=before, total=total)
    if not by:
        small = df.count() <= hot_rows
        return _local_total(df, **args) if small else _spread_total(df, hot_rows, **args)
    hot = key_sizes(df, by, hot_rows)
    if hot is None:
        return _local_total(df, **args)
    hot = hot.select(*[F.col(c).alias(f"_hot_{c}") for c in by])
    cold = df.join(hot, _same(by, "_hot_"), "left_anti")
    large = df.join(hot, _same(by, "_hot_"), "left_semi")
    return _local_total(cold, **args).unionByName(_spread_total(large, hot_rows, **args))


def _local_total(df, by, order, measure, before, total) -> DataFrame:
    key = Window.partitionBy(*by)
    if measure is None:
        place = F.row_number().over(key.orderBy(*order)).cast("long") - 1
        return df.withColumns({before: place, total: F.count(F.lit(1)).over(key)})
    return df.withColumns(
        {
            before: F.coalesce(F.sum(measure).over(_before(by, order)), F.lit(0)),
            total: F.sum(measure).over(key),
        }
    )


def _spread_total(df, hot_rows, by, order, measure, before, total) -> DataFrame:
    """Cut the sorted keys into ranges of about ``hot_rows`` rows and add range offsets.

    The cut is stored before use, so that both of its readers see the same ranges. A row
    number as last sort key lets equal rows fall into different ranges.
    """
    measure = F.lit(1).cast("long") if measure is None else measure
    fixed = stage(df.withColumn(_UID, F.monotonically_increasing_id()))
    parts = max(1, math.ceil(fixed.count() / hot_rows))
    cut = stage(
        fixed.repartitionByRange(parts, *by, *order, _UID).withColumn(
            _PART, F.spark_partition_id()
        )
    )
    group = [*by, _PART]
    sums = cut.groupBy(*group).agg(F.sum(measure).alias(_SHARE))
    # One row per key and range: at most as many per key as there are ranges.
    offsets = sums.withColumns(
        {
            _BASE: F.coalesce(F.sum(_SHARE).over(_before(by, [F.col(_PART)])), F.lit(0)),
            total: F.sum(_SHARE).over(Window.partitionBy(*by)),
        }
    ).drop(_SHARE)
    inner = F.sum(measure).over(_before(group, [*order, F.col(_UID)]))
    offsets = offsets.select(
        *[F.col(c).alias(f"_of_{c}") for c in group], _BASE, F.col(total).alias("_of_total")
    )
    return (
        cut.join(offsets, _same(group, "_of_"))
        .withColumn(total, F.col("_of_total"))
        .withColumn(before, F.col(_BASE) + F.coalesce(inner, F.lit(0)))
        .select(*df.columns, before, total)
    )


def total_sort(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Sort all rows by ``order``, which should hold every column.

    No row number is among the keys: where a map task runs again, rows go where they went
    before. Rows that are equal in all columns share a task, which sorts them with spilling.
    """
    return df.orderBy(*order)


def last_rows(
    df: DataFrame, by: Sequence[str], newest_first: Sequence[Column], k: int,
    *, place: str = "place", shares: int = 64,
) -> DataFrame:
    """The first ``k`` rows of each key in the given order, numbered from 1.

    Spark cuts every input task's rows to ``k`` per key ahead of the shuffle. The rows that
    are left of one key go to up to ``shares`` tasks, by the input task they come from, and
    meet in one task after the second cut.
    """
    rank = F.row_number().over(Window.partitionBy(*by, _SHARE).orderBy(*newest_first))
    final = F.row_number().over(Window.partitionBy(*by).orderBy(*newest_first))
    return (
        df.withColumn(_SHARE, F.spark_partition_id() % shares)
        .withColumn(place, rank)
        .filter(F.col(place) <= k)
        .drop(_SHARE, place)
        .withColumn(place, final)
        .filter(F.col(place) <= k)
    )


def key_shares(
    left: DataFrame, right: DataFrame | None, key: str, *, hot_rows: int = HOT_ROWS
) -> DataFrame | None:
    """Hot keys of a join with the number of shares for each side; None if there are none.

    A key is hot if it has more than ``hot_rows`` rows on a side, which is so for no more
    than rows / hot_rows keys. Null counts as a key of the left side. Without ``right``, that
    side counts as one share.
    """
    one, none = F.lit(1), F.lit(0)
    keys = left.select(key, one.alias("l"), none.alias("r"))
    if right is not None:
        known = right.filter(F.col(key).isNotNull())
        keys = keys.unionAll(known.select(key, none.alias("l"), one.alias("r")))
    hot = (
        keys.groupBy(key)
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        .filter((F.col("l") > hot_rows) | (F.col("r") > hot_rows))
        .select(key, *[F.greatest(F.ceil(F.col(s) / hot_rows), one).cast("long").alias(f"_{s}")
                       for s in ("l", "r")])
    )
    return None if hot.isEmpty() else stage(hot, "hot")


def left_join(
    left: DataFrame, right: DataFrame, key: str, shares: DataFrame | None
) -> DataFrame:
    """Left equi-join on one column, with the rows of hot keys spread over many tasks.

    ``shares`` comes from :func:`key_shares`. For a hot key each side is dealt into its
    shares, and every share of one side meets every share of the other. Rows of the left
    without a key then skip the join.
    """
    if shares is None:
        return left.join(right, key, "left")
    plan, hot = shares, shares.select(key)

    known, unknown = left.filter(F.col(key).isNotNull()), left.filter(F.col(key).isNull())
    cold = known.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key, "left")
    # Row numbers are stored before they decide where a row goes.
    dealt = {
        s: stage(
            df.join(plan, key)
            .withColumn(_UID, F.monotonically_increasing_id())
            .withColumn("_mine", F.col(_UID) % F.col(f"_{s}"))
        )
        for s, df in (("l", left), ("r", right))
    }
    other = lambda s: F.explode(F.sequence(F.lit(0).cast("long"), F.col(s) - 1))
    l_side = dealt["l"].withColumn("_b", other("_r")).withColumnRenamed("_mine", "_a")
    r_side = dealt["r"].withColumn("_a", other("_l")).withColumnRenamed("_mine", "_b")
    spare = ["_l", "_r", _UID]
    met = l_side.drop(*spare).join(r_side.drop(*spare), [key, "_a", "_b"]).drop("_a", "_b")
    alone = dealt["l"].join(dealt["r"].select(key).distinct(), key, "left_anti")
    unmatched = alone.select(*left.columns).unionByName(unknown)
    return cold.unionByName(met).unionByName(unmatched, allowMissingColumns=True).select(
        *left.columns, *[c for c in right.columns if c != key]
    )


#: Parts a range of values is cut into by one pass of :func:`order_statistics`.
PARTS = 8_192


def order_statistics(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], *, parts: int = PARTS
) -> DataFrame:
    """The values at the ranks that percentiles lie between, one row per key and ``rank``.

    Besides the keys and the 0-based ``rank``: ``at``, its value, ``rows``, the values of the
    key, and their ``least`` and ``most``. Nulls are left out.

    Found by selection: a histogram tells which part of the range of values a rank falls into, and with
    the least and most value in it; the next pass looks into that part only, until its ends
    are equal. The ends of a range have parts of their own, so every pass gets further,
    infinite values included. What is shuffled and stored is ``parts`` rows per range, whatever the
    rows; they are read again for each pass, of which a few are enough.
    """
    keys = [f"_key_{c}" for c in by]
    rows = df.filter(F.col(value).isNotNull()).select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("_v"))
    whole = stage(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min("_v").alias("least"), F.max("_v").alias("most")), "whole")
    at = [F.lit(float(p)) * (F.col("rows") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
    open_ = whole.select(
        *keys, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("_below"),
        F.col("least").alias("_lo"), F.col("most").alias("_hi"))
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    share = (v * 0.5 - lo * 0.5) / F.nullif(hi * 0.5 - lo * 0.5, F.lit(0.0))
    inner = F.when(F.isnan(share), 1).otherwise(
        F.least(F.lit(parts), F.greatest(F.lit(1), F.floor(share * parts) + 1)))
    part = F.when(v == lo, 0).when(v == hi, parts + 1).otherwise(inner).cast("int")
    before = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    found = open_.filter("_lo = _hi")
    open_ = open_.filter("_lo <> _hi")
    while not open_.isEmpty():
        ranges = open_.select(*[F.col(k).alias(f"_in{k}") for k in keys], "_lo", "_hi").distinct()
        inside = functools.reduce(
            Column.__and__, [F.col(k).eqNullSafe(F.col(f"_in{k}")) for k in keys], (v >= lo) & (v <= hi))
        counts = rows.join(ranges, inside).groupBy(*keys, "_lo", "_hi", part.alias("_part")).agg(
            F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_a"), F.max("_v").alias("_z"))
        counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).select(
            *[F.col(k).alias(f"_in{k}") for k in keys], F.col("_lo").alias("_from"), F.col("_hi").alias("_to"),
            "_rows", "_before", "_a", "_z")
        same = functools.reduce(
            Column.__and__, [F.col(k).eqNullSafe(F.col(f"_in{k}")) for k in keys],
            (F.col("_from") == lo) & (F.col("_to") == hi))
        ahead = F.col("_below") + F.col("_before")
        next_ = stage(
            open_.join(counts, same & (F.col("rank") >= ahead) & (F.col("rank") < ahead + F.col("_rows"))).select(
                *keys, "rank", ahead.alias("_below"), F.col("_a").alias("_lo"), F.col("_z").alias("_hi")),
            "ranges")
        found, open_ = found.unionByName(next_.filter("_lo = _hi")), next_.filter("_lo <> _hi")
    mine = whole.select(*[F.col(k).alias(f"_of{k}") for k in keys], "rows", "least", "most")
    same = functools.reduce(
        Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys], F.lit(True))
    return found.join(mine, same).select(
        *[F.col(k).alias(c) for c, k in zip(by, keys)], "rank", F.col("_lo").alias("at"), "rows", "least", "most")


def percentiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str],
    *, parts: int = PARTS, keep: Sequence[str] = (),
) -> DataFrame:
    """Exact percentiles per key with linear interpolation; nulls are left out.

    By :func:`order_statistics`, so no task holds or sorts a key's values. ``keep`` names those of
    its ``rows``, ``least`` and ``most`` to return as well. ``by`` must name a column.
    """
    ranked = order_statistics(df, by, value, probs, parts=parts)
    out = {}
    for prob, name in zip(probs, names):
        at = F.lit(float(prob)) * (F.col("rows") - 1)
        lower, upper = (F.max(F.when(F.col("rank") == f(at), F.col("at"))) for f in (F.floor, F.ceil))
        share = F.max(at - F.floor(at))
        # a share of nothing, so that an infinite neighbour does not count
        out[name] = F.when(share == 0, lower).otherwise(lower * (1.0 - share) + upper * share)
    return ranked.groupBy(*by).agg(
        *[c.alias(n) for n, c in out.items()], *[F.max(c).alias(c) for c in keep])
