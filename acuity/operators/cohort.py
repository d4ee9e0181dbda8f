"""Patient pages, search, and lookups by stay."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from acuity import schemas
from acuity.functions import scalars as S
from acuity.operators.clean import restrict_to_stays
from acuity.operators.skew import HOT_ROWS, running_total, total_sort
from acuity.schemas import STAY

# A page that ends within so many rows is taken from each task's first rows.
NEAR_ROWS = 2_000


def _total_order(df: DataFrame, first: Sequence[str]) -> list[str]:
    return [*first, *[c for c in df.columns if c not in first]]


def page(
    df: DataFrame, limit: int = schemas.MAX_PAGE_ROWS, offset: int = 0,
    order: Sequence[str] = (STAY,), *, near_rows: int = NEAR_ROWS, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the given order, ties by the other columns.

    A near page is a top-k. A far page is found by row places, which no single task or the
    driver has to count out.
    """
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    keys = [F.col(c) for c in _total_order(df, order)]
    if offset + limit <= near_rows:
        return df.orderBy(*keys).offset(offset).limit(limit)
    placed = running_total(df, [], keys, before="_place", total="_rows", hot_rows=hot_rows)
    inside = (F.col("_place") >= offset) & (F.col("_place") < offset + limit)
    return placed.filter(inside).select(*df.columns).orderBy(*keys)


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: its last row, and how many rows equal to it have been shown."""

    last: dict
    seen: int


def cursor(rows: Sequence[Row], before: Cursor | None = None) -> Cursor | None:
    """The cursor behind a page's collected rows; ``before`` is the one the page was asked with."""
    if not rows:
        return before
    last = rows[-1].asDict()
    seen = sum(r.asDict() == last for r in rows)
    if before is not None and before.last == last:
        seen += before.seen
    return Cursor(last, seen)


def _from(last: dict, order: Sequence[str]) -> Column:
    """Rows at or behind ``last``, nulls first, as the ordering has it."""
    at = F.lit(True)
    for name in reversed(order):
        value, c = last[name], F.col(name)
        behind = c.isNotNull() if value is None else F.coalesce(c > F.lit(value), F.lit(False))
        at = behind | (c.eqNullSafe(F.lit(value)) & at)
    return at


def page_after(
    df: DataFrame, after: Cursor | None, limit: int = schemas.MAX_PAGE_ROWS,
    order: Sequence[str] = (STAY,), *, reach: int = 1_024,
) -> DataFrame:
    """The next ``limit`` rows behind a cursor, in the order of :func:`page`; the first page without one.

    No row ahead of the page is counted or put in order. The first column, a whole number, is
    bounded on both sides by a filter that reaches the scan: from the cursor's value on, up to
    ``reach`` further, and eight times as far again while that holds fewer than ``limit`` rows.
    In the layout sorted by stay only the row groups of the page are read.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    names = _total_order(df, order)
    keys = [F.col(c) for c in names]
    if after is None:
        return df.orderBy(*keys).limit(limit)
    first, seen = F.col(names[0]), after.seen
    value = after.last[names[0]]
    rest = df.filter(_from(after.last, names))
    if value is None:
        return rest.orderBy(*keys).offset(seen).limit(limit)
    rest = rest.filter(first >= value)
    while value + reach < 2**62:
        near = rest.filter(first <= value + reach)
        if near.limit(seen + limit).count() == seen + limit:
            return near.orderBy(*keys).offset(seen).limit(limit)
        reach *= 8
    return rest.orderBy(*keys).offset(seen).limit(limit)


def search(df: DataFrame, text: str | None = None, high_risk_only: bool = False) -> DataFrame:
    """Patients that match a search text, optionally only those flagged as high risk.

    A text that reads as an integer is a stay id. Any other is looked for in unit type and
    gender without regard to case; ``%`` and ``_`` in it are wildcards.
    """
    if text:
        if not re.fullmatch(r"\s*[+-]?[0-9]+\s*", text, re.ASCII):
            pattern = "%" + text.replace("\\", "\\\\") + "%"
            df = df.filter(F.col("unittype").ilike(pattern) | F.col("gender").ilike(pattern))
        else:
            stay = int(text)
            fits = -(2**63) <= stay < 2**63
            df = df.filter(F.col(STAY) == stay if fits else F.lit(False))
    if high_risk_only:
        df = df.filter(S.high_risk(F.col("ml_risk_score"), F.col("apachescore")))
    return df


def search_page(
    df: DataFrame, text: str | None = None, high_risk_only: bool = False,
    limit: int = schemas.PAGE_ROWS, offset: int = 0,
) -> DataFrame:
    """One page of :func:`search`, at most 500 rows, in order of stay."""
    if limit > schemas.MAX_PAGE_ROWS:
        raise ValueError(f"limit must be at most {schemas.MAX_PAGE_ROWS}")
    return page(search(df, text, high_risk_only), limit, offset)


def search_counts(
    df: DataFrame, text: str | None = None, high_risk_only: bool = False,
    limit: int = schemas.PAGE_ROWS, offset: int = 0,
) -> DataFrame:
    """Rows on the page, and rows that match in all."""
    total = F.count(F.lit(1))
    return search(df, text, high_risk_only).agg(
        F.greatest(F.least(total - offset, F.lit(limit)), F.lit(0)).cast("long").alias("page_rows"),
        total.alias("total"),
    )


def display_rows(df: DataFrame) -> DataFrame:
    """Search-result columns with the risk band and the outcome text."""
    out = df.select(*[c for c in schemas.DISPLAY_COLUMNS if c in df.columns])
    if "ml_risk_score" in out.columns:
        out = out.withColumn("risk", S.risk_band(F.col("ml_risk_score")))
    if "hospital_mortality" in out.columns:
        out = out.withColumn("outcome", S.outcome(F.col("hospital_mortality")))
    return out


def patient(df: DataFrame, stay: int, *, must_exist: bool = True) -> DataFrame:
    """The rows of one stay; a stay that is not there is an error."""
    out = restrict_to_stays(df, stay)
    if must_exist and out.isEmpty():
        raise LookupError(f"no patient with stay {stay}")
    return out


Stays = DataFrame | Iterable[int] | int | None


def vitals_of(vitals: DataFrame, stays: Stays = None) -> DataFrame:
    """Vitals of the given stays (all without) by stay and time."""
    out = restrict_to_stays(vitals, stays)
    return total_sort(out, [F.col(c) for c in _total_order(out, [STAY, "observationoffset"])])


def labs_of(labs: DataFrame, stays: Stays = None) -> DataFrame:
    """Lab results of the given stays (all without) by stay and time."""
    out = restrict_to_stays(labs, stays)
    return total_sort(out, [F.col(c) for c in _total_order(out, [STAY, "labresultoffset"])])


def lab_lines(labs: DataFrame, names: Iterable[str], stays: Stays = None) -> DataFrame:
    """Series of the named labs with a time axis in hours, ordered for plotting."""
    out = restrict_to_stays(labs.filter(F.col("labname").isin(list(names))), stays).select(
        STAY, "labname", S.hours(F.col("labresultoffset")).alias("time_h"), "labresult"
    )
    return total_sort(out, [F.col(c) for c in out.columns])


def diagnoses_of(diagnosis: DataFrame, stays: Stays = None) -> DataFrame:
    return restrict_to_stays(diagnosis, stays)


def treatments_of(treatment: DataFrame, stays: Stays = None) -> DataFrame:
    return restrict_to_stays(treatment, stays)


# Headings of the event tables and the lab summary.
DIAGNOSIS_HEADINGS = {
    "diagnosisoffset": "Offset (min)", "diagnosisstring": "Diagnosis",
    "icd9code": "ICD9", "diagnosispriority": "Priority",
}
TREATMENT_HEADINGS = {"treatmentoffset": "Offset (min)", "treatmentstring": "Treatment"}
LAB_SUMMARY_HEADINGS = {
    "labname": "Lab Test", "mean": "Mean", "min": "Min", "max": "Max", "count": "Count",
}


def with_headings(df: DataFrame, headings: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(h) for c, h in headings.items()])
