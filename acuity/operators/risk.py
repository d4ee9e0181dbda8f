"""Preparation of model inputs, and evaluation of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acuity import schemas
from acuity.functions import scalars as S
from acuity.operators.skew import HOT_ROWS, percentiles, running_total
from acuity.schemas import STAY
from acuity.sources.storage import stage

_UNIT = "_unit"


def with_unit(df: DataFrame) -> DataFrame:
    """Unit type with a name for the missing ones."""
    return df.withColumn(_UNIT, F.coalesce(F.col("unittype"), F.lit("unknown")))


def fit_unit_codes(df: DataFrame) -> StringIndexerModel:
    """Learn the unit codes, in alphabetical order; unseen units get one more code."""
    return StringIndexer(
        inputCol=_UNIT, outputCol="unittype_enc",
        stringOrderType="alphabetAsc", handleInvalid="keep",
    ).fit(with_unit(df).select(_UNIT))


def encode(df: DataFrame, codes: StringIndexerModel | None = None) -> DataFrame:
    """Add ``gender_enc`` and ``unittype_enc``."""
    df = with_unit(df).withColumn("gender_enc", S.male_flag(F.col("gender")))
    return (codes or fit_unit_codes(df)).transform(df).drop(_UNIT)


def present_features(df: DataFrame, wanted: Sequence[str] = schemas.FEATURES) -> list[str]:
    return [c for c in wanted if c in df.columns]


def medians(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """Exact median of each column as rows (feature, median); a column of nulls has none."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "feature", "value"
    )
    return percentiles(long, ["feature"], "value", [0.5], ["median"], **options)


def median_values(df: DataFrame, columns: Sequence[str], **options) -> dict[str, float]:
    """The medians as numbers: one per feature, whatever the number of rows."""
    return {r["feature"]: r["median"] for r in medians(df, columns, **options).collect()}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.fillna({c: v for c, v in values.items() if c in df.columns})


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre each column and divide by its population deviation (by 1 if that is 0)."""
    return apply_scale(df, scale_of(df, columns), columns)


def scale_of(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation of each column, from one aggregation."""
    row = df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
    ).first()
    return {c: (row[f"{c}_mean"], row[f"{c}_std"]) for c in columns}


def apply_scale(df: DataFrame, scale: dict[str, tuple[float, float]], columns: Sequence[str]
                ) -> DataFrame:
    return df.withColumns(
        {c: (F.col(c) - scale[c][0]) / (scale[c][1] or 1.0) for c in columns}
    )


#: Hex digits of the digest by which a histogram gets finer, and the rows that may be put in
#: order once a bin is that small.
DIGITS, FEW = 4, 10_000
_MIX = "_acuity_mix"


def _prefix(length: Column) -> Column:
    return F.substring(F.col(_MIX), F.lit(1), length)


def split_cuts(rows: DataFrame, label: str, fraction: float, *, few: int = FEW) -> DataFrame:
    """Where each class's digests pass its quota of test rows; one row per class, stored.

    Rows whose digest starts with something smaller than ``cut`` are test rows. Of those that
    start with ``cut`` itself, ``bin`` in number, the first ``want`` are. A histogram over the
    first digits of the digest finds the bin that the quota falls into, one over the next
    digits looks into that bin only, and so on until it holds ``few`` rows or the digits end.
    A histogram has 16^DIGITS rows a class at most and combines before the shuffle, so no
    class is ever sorted.
    """
    by_bin = Window.partitionBy("_class").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)

    def narrowed(counts: DataFrame, quota: Column) -> DataFrame:
        before = F.coalesce(F.sum("_rows").over(by_bin), F.lit(0))
        placed = counts.withColumns({"_before": before, "_quota": quota})
        return placed.filter(
            (F.col("_before") < F.col("_quota")) & (F.col("_quota") <= F.col("_before") + F.col("_rows"))
        ).select("_class", F.col("_bin").alias("cut"), F.col("_rows").alias("bin"),
                 (F.col("_quota") - F.col("_before")).alias("want"))

    def counted(of: DataFrame, digits: int, *more: str) -> DataFrame:
        return of.groupBy(F.col(label).alias("_class"), _prefix(F.lit(digits)).alias("_bin"), *more).agg(
            F.count(F.lit(1)).alias("_rows"))

    whole = F.sum("_rows").over(Window.partitionBy("_class"))
    cuts = stage(narrowed(counted(rows, DIGITS), F.ceil(F.lit(fraction) * whole)), "cuts")
    for digits in range(2 * DIGITS, 33, DIGITS):
        wide = (F.col("bin") > few) & (F.col("bin") > F.col("want"))
        if cuts.filter(wide).isEmpty():
            break
        at = cuts.filter(wide).withColumnRenamed("_class", "_of")
        inside = rows.join(
            at, F.col(label).eqNullSafe(F.col("_of")) & (_prefix(F.lit(digits - DIGITS)) == F.col("cut")))
        finer = narrowed(counted(inside, digits, "want"), F.col("want"))
        cuts = stage(finer.unionByName(cuts.filter(~wide)), "cuts")
    return cuts


def stratified_split(
    df: DataFrame, label: str = schemas.TARGET, fraction: float = 0.2, seed: int = 42,
    *, key: str = STAY, flag: str = "is_test", few: int = FEW, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Mark exactly ceil(fraction * n) rows of each class as test rows.

    Rows are ordered by a digest of key and seed, so the choice depends on nothing else. All
    but the few rows in the bin that a class's quota falls into are told by their digest
    alone, in place; those few are put in order, equal digests by the row's other columns.
    """
    rest = [F.col(c) for c in df.columns if c not in (key, label)]
    mix = F.md5(F.concat_ws("|", key, F.lit(str(seed))).cast("binary"))
    rows = df.withColumn(_MIX, mix)
    cuts = split_cuts(rows, label, fraction, few=few)
    met = rows.join(cuts, F.col(label).eqNullSafe(F.col("_class")), "left")
    head = _prefix(F.length("cut"))
    # without a cut a class has no test rows
    open_ = F.coalesce((head == F.col("cut")) & (F.col("want") < F.col("bin")), F.lit(False))
    told = met.filter(~open_).withColumn(flag, F.coalesce(head <= F.col("cut"), F.lit(False)))
    told = told.select(*df.columns, flag)
    if cuts.filter(F.col("want") < F.col("bin")).isEmpty():
        return told
    placed = running_total(
        met.filter(open_), [label], [F.col(_MIX), F.col(key), *rest], before="_place", total="_rows",
        hot_rows=hot_rows,
    )
    return told.unionByName(
        placed.withColumn(flag, F.col("_place") < F.col("want")).select(*df.columns, flag))


def class_weights(df: DataFrame, label: str = schemas.TARGET) -> DataFrame:
    """Balanced weight of each class: all rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    sizes = counts.agg(F.sum("rows") / F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", sizes / F.col("rows"))


def weight_column(df: DataFrame, label: str = schemas.TARGET) -> Column:
    """The balanced weights as an expression over the label."""
    rows = {r[label]: r["weight"] for r in class_weights(df, label).collect()}
    out = None
    for value, weight in rows.items():
        test = F.col(label) == value
        out = F.when(test, weight) if out is None else out.when(test, weight)
    return out


def dataset_summary(df: DataFrame, label: str = schemas.TARGET) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col(label).cast("double")).alias("positive_rate")
    )


def roc_auc(df: DataFrame, score: str, label: str = schemas.TARGET, *, hot_rows: int = HOT_ROWS
            ) -> DataFrame:
    """Exact area under the ROC curve: the share of (positive, negative) pairs in the right
    order, ties counting half.

    Works on distinct scores and running counts, so pairs are never formed. Null without
    both classes.
    """
    hit = F.sum(F.col(label).cast("long"))
    counts = stage(
        df.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).alias("_score"))
        .agg(hit.alias("_pos"), (F.count(F.lit(1)) - hit).alias("_neg"))
    )
    ranked = running_total(
        counts, [], [F.col("_score")], F.col("_neg"),
        before="_below", total="_all", hot_rows=hot_rows,
    )
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return ranked.agg(F.try_divide(wins, pairs).alias("auc"))


def auc_bounds(
    df: DataFrame, score: str, label: str = schemas.TARGET, *, low: float = 0.0, high: float = 1.0,
    bins: int = 4_096,
) -> DataFrame:
    """Bounds ``lo`` and ``hi`` of :func:`roc_auc`, from one aggregation and no order of the rows.

    Scores are counted in ``bins`` equal parts of ``low`` to ``high``; the outer parts take
    what lies beyond. Pairs in different parts are certain; those within one count as lost
    for ``lo`` and as won for ``hi``, so ``hi - lo`` is the share of pairs that share a part. Null without
    both classes.
    """
    known = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    part = F.floor((F.col(score) - low) / (high - low) * bins)
    hit = F.sum(F.col(label).cast("long"))
    counts = df.filter(known).groupBy(
        F.greatest(F.lit(0), F.least(F.lit(bins - 1), part)).alias("_part")
    ).agg(hit.alias("_pos"), (F.count(F.lit(1)) - hit).alias("_neg"))
    # ``bins`` rows at most
    below = F.coalesce(F.sum("_neg").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sure = F.sum(F.col("_pos").cast("double") * F.col("_below"))
    open_ = F.sum(F.col("_pos").cast("double") * F.col("_neg"))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return counts.withColumn("_below", below).agg(
        F.try_divide(sure, pairs).alias("lo"), F.try_divide(sure + open_, pairs).alias("hi"))


def class_report(df: DataFrame, prediction: str = "prediction", label: str = schemas.TARGET
                 ) -> DataFrame:
    """Precision, recall, f1 and support per class, accuracy, and macro and weighted means.

    All from one table of (label, prediction) counts. An undefined ratio is 0.
    """
    y, p, n = F.col("_y"), F.col("_p"), F.col("_n")
    cells = df.groupBy(
        F.col(label).cast("long").alias("_y"), F.col(prediction).cast("long").alias("_p")
    ).agg(F.count(F.lit(1)).alias("_n"))
    # Each cell counts for its true class and for its predicted class.
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(y.alias("class"), n.alias("true"), F.lit(0).cast("long").alias("said")),
                F.struct(p.alias("class"), F.lit(0).cast("long").alias("true"), n.alias("said")),
            )
        ).alias("s"),
        F.when(y == p, n).otherwise(F.lit(0)).alias("hit"),
    ).select("s.*", "hit")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    hits = F.sum(F.when(F.col("true") > 0, F.col("hit")).otherwise(F.lit(0)))
    classes = (
        sides.groupBy("class")
        .agg(hits.alias("hits"), F.sum("true").alias("support"), F.sum("said").alias("said"))
        .withColumn("precision", ratio(F.col("hits"), F.col("said")))
        .withColumn("recall", ratio(F.col("hits"), F.col("support")))
        .withColumn(
            "f1",
            ratio(2.0 * F.col("precision") * F.col("recall"),
                  F.col("precision") + F.col("recall")),
        )
    )
    measures = ["precision", "recall", "f1"]
    each = classes.select(
        F.col("class").cast("string").alias("class"), *measures, "support"
    )
    total = F.sum("support").alias("support")
    macro = classes.agg(*[F.avg(m).alias(m) for m in measures], total).select(
        F.lit("macro avg").alias("class"), *measures, "support"
    )
    weighted = classes.agg(
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in measures],
        total,
    ).select(F.lit("weighted avg").alias("class"), *measures, "support")
    share = F.sum("hits") / F.sum("support")
    accuracy = classes.agg(*[share.alias(m) for m in measures], total).select(
        F.lit("accuracy").alias("class"), *measures, "support"
    )
    return each.unionByName(accuracy).unionByName(macro).unionByName(weighted)
