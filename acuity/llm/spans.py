"""Spans of regular expressions in whole texts, by SQL functions alone.

Splitting a text at an expression gives the gaps between its matches; the matches come from
the same expression. Running sums of both lengths are the positions, in code points. The
expressions use possessive repeats, so that very long runs neither recurse nor backtrack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acuity.llm.common import prefix_sums

CONTEXT = 40
_NONE = "cast(array() AS array<string>)"


@dataclass(frozen=True)
class Kind:
    """An expression to look for.

    ``gate`` is a cheap SQL test of ``text`` that holds wherever the expression matches;
    ``value`` is the group whose text is judged; ``confirm`` is a SQL test of a match ``m``
    with fields start, end, text, value, before, after (the text around it, ``CONTEXT`` signs).
    """

    name: str
    pattern: str
    gate: str
    confirm: str = "true"
    value: int = 0


def quoted(pattern: str) -> str:
    """A SQL string literal in raw form, with its quotes spelled as escapes."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _fields(i: int) -> str:
    """SQL for the matches of the i-th kind, from its gaps, matches and running sums.

    The text around a match is put together from the neighbouring matches and the ends of the
    gaps between them; as no match is empty, ``CONTEXT`` neighbours are always enough.
    """
    ahead = f"least(k, {CONTEXT})"
    before = f"""concat(array_join(zip_with(
        slice(_tail{i}, k - {ahead} + 1, {ahead}), slice(_hit{i}, k - {ahead} + 1, {ahead}),
        (g, h) -> concat(g, h)), ''), _tail{i}[k])"""
    after = f"""concat(_head{i}[k + 1], array_join(zip_with(
        slice(_hit{i}, k + 2, {CONTEXT}), slice(_head{i}, k + 3, {CONTEXT}),
        (h, g) -> concat(h, g)), ''))"""
    start = f"_pre{i}[k] + length(_gap{i}[k])"
    return f"""transform(_hit{i}, (x, k) -> named_struct(
        'start', {start}, 'end', {start} + length(x), 'text', x, 'value', _val{i}[k],
        'before', right({before}, {CONTEXT}), 'after', left({after}, {CONTEXT})))"""


def find(docs: DataFrame, kinds: list[Kind], extra: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id`` and, for each kind, an array column of its name with the confirmed matches.

    ``docs`` has doc_id and text. ``extra`` columns are computed from the text beside them.
    """
    keep = list(extra or {})
    first, second, third, fourth = {}, {}, {}, {}
    for i, kind in enumerate(kinds):
        at = quoted(kind.pattern)
        first[f"_gap{i}"] = f"CASE WHEN {kind.gate} THEN split(text, {at}, -1) ELSE {_NONE} END"
        first[f"_hit{i}"] = (
            f"CASE WHEN {kind.gate} THEN regexp_extract_all(text, {at}, 0) ELSE {_NONE} END"
        )
        first[f"_val{i}"] = f"_hit{i}" if not kind.value else (
            f"CASE WHEN {kind.gate} THEN regexp_extract_all(text, {at}, {kind.value})"
            f" ELSE {_NONE} END"
        )
        second[f"_step{i}"] = (
            f"transform(_hit{i}, (x, k) -> cast(length(_gap{i}[k]) + length(x) AS bigint))"
        )
        second[f"_tail{i}"] = f"transform(_gap{i}, g -> right(g, {CONTEXT}))"
        second[f"_head{i}"] = f"transform(_gap{i}, g -> left(g, {CONTEXT}))"
        third[f"_pre{i}"] = prefix_sums(f"_step{i}")
        fourth[kind.name] = f"filter({_fields(i)}, m -> {kind.confirm})"
    plain = {n: F.expr(x) for n, x in first.items() if not x.startswith("_hit")}
    alias = {n: F.expr(x) for n, x in first.items() if x.startswith("_hit")}
    steps = [plain | (extra or {}), alias, *({n: F.expr(x) for n, x in d.items()}
                                             for d in (second, third, fourth))]
    out = docs
    for step in steps:
        out = out.withColumns(step) if step else out
    return out.select("doc_id", *keep, *[k.name for k in kinds])


def digest(kinds: list[str], by_start: bool) -> str:
    """SQL for ``kind:start:end`` of all matches of the kinds, joined by commas."""
    parts = ", ".join(
        f"transform({k}, m -> named_struct('start', m.start, 'no', {i}, "
        f"'s', concat('{k}:', m.start, ':', m.end)))"
        for i, k in enumerate(kinds)
    )
    ordered = f"array_sort(concat({parts}))" if by_start else f"concat({parts})"
    return f"array_join(transform({ordered}, m -> m.s), ',')"
