"""Column expressions shared by the operators. All of them stay inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acuity import schemas

# Spark's cast also takes a trailing d or f ("45d"); a number here is digits, a point, an
# exponent, or an infinity.
_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"

_DIGITS = r"^\s*[+-]?\d+\s*$"


def blank_to_null(c: Column) -> Column:
    """Missing-value texts become null."""
    return F.when(~c.isin(schemas.MISSING_TOKENS), c)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def number(c: Column) -> Column:
    """Numeric value of a text, null where there is none. Never raises.

    Other texts do not get to the cast, which is slow on them.
    """
    text = c.cast("string")
    return F.when(text.rlike(_NUMBER), text).try_cast("double")


def whole_number(c: Column) -> Column:
    """Like :func:`number`, truncated to an integer; 64-bit keys keep every digit."""
    text = c.cast("string")
    return F.when(text.rlike(_DIGITS), text.try_cast("long")).otherwise(
        number(c).try_cast("long")
    )


def clean_age(c: Column) -> Column:
    """The text ``> 89`` stands for 90; anything else is a number or null."""
    return F.when(c == "> 89", 90.0).otherwise(number(c))


def known(c: Column) -> Column:
    return F.coalesce(c, F.lit("Unknown"))


def expired_flag(status: Column) -> Column:
    """1 for an expired patient, else 0; a missing status is 0."""
    return F.coalesce((F.lower(status) == "expired").cast("int"), F.lit(0))


def male_flag(gender: Column) -> Column:
    return F.coalesce((F.lower(gender) == "male").cast("double"), F.lit(0.0))


def in_range_or_null(c: Column, low: float, high: float) -> Column:
    return c.between(low, high) | c.isNull()


def risk_label(score: Column) -> Column:
    return (
        F.when(score >= schemas.HIGH_RISK, "HIGH")
        .when(score >= schemas.MODERATE_RISK, "MODERATE")
        .otherwise("LOW")
    )


def risk_band(score: Column) -> Column:
    """Display band: the label's cut points, and a blank band where there is no score."""
    return (
        F.when(score.isNull() | F.isnan(score), "blank")
        .when(score >= schemas.HIGH_RISK, "red")
        .when(score >= schemas.MODERATE_RISK, "yellow")
        .otherwise("green")
    )


def outcome(flag: Column) -> Column:
    return F.when(flag == 1, "Expired").when(flag == 0, "Survived")


def hours(minutes: Column) -> Column:
    return minutes / 60.0


def prefix(c: Column, length: int) -> Column:
    return F.substring(c, 1, length)


def in_age_groups(age: Column) -> Column:
    """Whether any age group takes the age; the groups follow on each other."""
    return (age > schemas.AGE_GROUPS[0][0]) & (age <= schemas.AGE_GROUPS[-1][1])


def age_group_number(age: Column) -> Column:
    """0-based number of the right-closed group of an age inside the groups.

    Counting the passed bounds keeps the expression flat, so ``age`` is computed once.
    """
    passed = [(age > above).cast("int") for above, _, _ in schemas.AGE_GROUPS[1:]]
    return sum(passed[1:], passed[0])


def age_group_label(number: Column) -> Column:
    labels = F.array(*[F.lit(text) for _, _, text in schemas.AGE_GROUPS])
    return F.get(labels, number)


def high_risk(score: Column, apache: Column) -> Column:
    """A high score or a high severity; a missing one leaves the other to decide."""
    return (score >= schemas.FLAG_RISK) | (apache >= schemas.FLAG_APACHE)


def rounded_or_zero(c: Column, digits: int) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)), digits)


def _doubles(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinite values of all floating columns become null."""
    doubles = _doubles(df)
    limit = F.lit(float("inf"))
    return df.select(
        *[
            F.when(~F.isnan(c) & (F.abs(c) != limit), F.col(c)).alias(c) if c in doubles else c
            for c in df.columns
        ]
    )


def rounded(
    df: DataFrame, digits: int, exact: Sequence[str] = (), nudge: float = 0.0
) -> DataFrame:
    """Round every floating column but the ``exact`` ones, after adding ``nudge``."""
    doubles = _doubles(df) - set(exact)
    return df.select(
        *[F.round(F.col(c) + nudge, digits).alias(c) if c in doubles else c for c in df.columns]
    )


def unit_interval(key: Column, start: int) -> Column:
    """A number in (0, 1) that depends on ``key`` only, so it survives any re-run.

    Takes 12 of the 32 hex digits of the key's digest, from position ``start``.
    """
    digits = F.conv(F.substring(F.md5(key.cast("binary")), start, 12), 16, 10).cast("double")
    return (digits + 0.5) / float(16**12)


def standard_normal(key: Column) -> Column:
    """Box-Muller draw from two uniform numbers of the same key."""
    u, v = unit_interval(key, 1), unit_interval(key, 13)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(2.0) * F.pi() * v)
