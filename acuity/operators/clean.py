"""Cleaning rules of the six raw tables."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acuity import schemas
from acuity.functions import scalars as S
from acuity.schemas import STAY


def _value(df: DataFrame, name: str, kind: T.DataType) -> Column:
    """Column ``name`` as ``kind``. Text is parsed; numbers only lose their NaN."""
    c, held = F.col(name), df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return c.cast("string")
    if isinstance(held, T.StringType):
        return S.whole_number(c) if isinstance(kind, T.LongType) else S.number(c)
    if isinstance(held, (T.DoubleType, T.FloatType)):
        c = S.nan_to_null(c)
    return c.try_cast("long" if isinstance(kind, T.LongType) else "double")


def _typed(df: DataFrame, schema: T.StructType, **given: Column) -> DataFrame:
    """Cast those columns of ``schema`` that exist, in its order; keep other columns after.

    ``given`` holds expressions that take the place of the plain cast.
    """
    known = [f for f in schema if f.name in df.columns]
    names = {f.name for f in known}
    return df.select(
        *[given.get(f.name, _value(df, f.name, f.dataType)).alias(f.name) for f in known],
        *[c for c in df.columns if c not in names],
    )


def coerce_key(df: DataFrame, key: str = STAY) -> DataFrame:
    """Make the key an integer, dropping rows without a numeric one."""
    return _with_key(df.withColumn(key, _value(df, key, T.LongType())), key)


def _with_key(df: DataFrame, key: str = STAY) -> DataFrame:
    """Rows that have a key; as a plain null test this reaches the scan."""
    return df.filter(F.col(key).isNotNull())


def drop_missing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows with a value in all of ``columns``; the null tests reach the scan."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            df = df.filter(~F.isnan(c))
    return df


#: Longest list of stays that becomes a filter, and the stays in one of its terms. The scan compares
#: a term of up to ten values with dictionaries and Bloom filters, a longer one with bounds only.
LISTED, IN_TERM = 500, 10


def among_stays(stays: Iterable[int], key: str = STAY) -> Column:
    """Whether the key is one of the stays, in terms that scans can use to skip row groups."""
    listed = sorted({int(s) for s in stays})
    if not listed:
        return F.lit(False)
    terms = [F.col(key).isin(listed[i : i + IN_TERM]) for i in range(0, len(listed), IN_TERM)]
    return functools.reduce(Column.__or__, terms)


def restrict_to_stays(df: DataFrame, stays: DataFrame | Iterable[int] | int | None,
                      key: str = STAY) -> DataFrame:
    """Keep the rows of the given stays.

    A number, or a list of up to ``LISTED`` numbers, becomes a filter that reaches the scan; a
    longer list or a DataFrame is semi-joined, the list with its bounds as a filter besides.
    A hot key on the left is split by adaptive execution where it is on.
    """
    if stays is None:
        return df
    if isinstance(stays, DataFrame):
        return df.join(stays.select(key).distinct(), key, "left_semi")
    if isinstance(stays, int):
        return df.filter(F.col(key) == stays)
    wanted = sorted({int(s) for s in stays})
    if len(wanted) <= LISTED:
        return df.filter(among_stays(wanted, key))
    listed = df.sparkSession.createDataFrame([(s,) for s in wanted], f"{key} long")
    return df.filter(F.col(key).between(wanted[0], wanted[-1])).join(listed, key, "left_semi")


def clean_patients(raw: DataFrame) -> DataFrame:
    """Numeric age, named unknowns, and the binary mortality label."""
    out = _typed(
        raw,
        schemas.PATIENT,
        age=S.clean_age(F.col("age")),
        gender=S.known(F.col("gender")),
        ethnicity=S.known(F.col("ethnicity")),
    )
    return out.withColumn("hospital_mortality", S.expired_flag(F.col("hospitaldischargestatus")))


def drop_implausible(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None
                     ) -> DataFrame:
    """Drop rows with a value outside its range; a missing value never drops a row."""
    for name, (low, high) in (ranges or schemas.VITAL_RANGES).items():
        df = df.filter(S.in_range_or_null(F.col(name), low, high))
    return df


def clean_vitals(raw: DataFrame, stays: DataFrame | Iterable[int] | int | None = None
                 ) -> DataFrame:
    out = _with_key(_typed(raw, schemas.VITALS))
    return drop_implausible(restrict_to_stays(out, stays))


def clean_labs(raw: DataFrame, stays: DataFrame | Iterable[int] | int | None = None
               ) -> DataFrame:
    """Rows without a raw result go; a result that is not a number stays as null."""
    kept = drop_missing(raw, [c for c in ["labresult"] if c in raw.columns])
    return restrict_to_stays(_with_key(_typed(kept, schemas.LABS)), stays)


def _keyed(schema: T.StructType) -> Callable[[DataFrame], DataFrame]:
    def clean(raw: DataFrame) -> DataFrame:
        return _with_key(_typed(raw, schema))

    return clean


clean_diagnosis = _keyed(schemas.DIAGNOSIS)
clean_treatment = _keyed(schemas.TREATMENT)
clean_apache = _keyed(schemas.APACHE)

CLEANERS: dict[str, Callable[..., DataFrame]] = {
    "patient": clean_patients,
    "vitals": clean_vitals,
    "labs": clean_labs,
    "diagnosis": clean_diagnosis,
    "treatment": clean_treatment,
    "apache": clean_apache,
}
