"""Personal data: expressions propose spans, checksums confirm, context words weigh.

A span's score starts from its kind, rises where a checksum holds, and rises again where a
word that goes with the kind stands within 40 characters of it. The four base kinds need no
more than their own rule. The added kinds are weak as patterns alone, so they need a score
of ``THRESHOLD``: an IBAN by its mod-97 checksum, the others by a context word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acuity.llm.common import texts
from acuity.llm.spans import Kind, digest, find

THRESHOLD = 0.6

_LUHN = """(aggregate(transform(
      sequence(1, length(regexp_replace(m.text, '[^0-9]', ''))),
      j -> CASE WHEN j % 2 = 1
        THEN int(substring(regexp_replace(m.text, '[^0-9]', ''), -j, 1))
        ELSE (2 * int(substring(regexp_replace(m.text, '[^0-9]', ''), -j, 1))) DIV 10
           + (2 * int(substring(regexp_replace(m.text, '[^0-9]', ''), -j, 1))) % 10 END
    ), 0L, (a, d) -> a + d) % 10 = 0)"""

# Remainder by 97 of the code with its first four characters put last, letters as 10 to 35.
_IBAN = "concat(substring(replace(m.text, ' ', ''), 5), left(m.text, 4))"
_MOD97 = f"""(length(replace(m.text, ' ', '')) BETWEEN 15 AND 34 AND aggregate(transform(
      sequence(1, length({_IBAN})), j -> ascii(substring({_IBAN}, j, 1))
    ), 0L, (a, c) -> CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97
                         ELSE (a * 10 + c - 48) % 97 END) = 1)"""

_DIGITS = "length(regexp_replace(m.text, '[^0-9]', ''))"

BASE = [
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "contains(text, '@')",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"text RLIKE r'[0-9]\.[0-9]++\.[0-9]++\.[0-9]'",
        r"m.text RLIKE r'^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$'",
    ),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,18}+(?![ -]?[0-9])",
        r"text RLIKE r'[0-9](?:[ -]?+[0-9]){12}'",
        _LUHN,
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        "contains(text, '+')",
        f"{_DIGITS} BETWEEN 9 AND 15",
    ),
]

ADDED = [
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?+[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
        r"text RLIKE r'[A-Z]{2}[0-9]{2} ?[A-Z0-9]'",
        _MOD97,
    ),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         r"text RLIKE r'[0-9]{3}-[0-9]{2}-[0-9]{4}'"),
    Kind(
        "local",
        r"(?<![0-9+().-])(?<!\+[0-9]{1,3}[ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])"
        r"[0-9]{3}[-. ][0-9]{4}(?![0-9-])",
        r"text RLIKE r'[0-9]{3}[-. ][0-9]{4}'",
    ),
]

#: Score of the pattern, gain by a held checksum, and the words that go with the kind.
WEIGHTS = {
    "email": (0.7, 0.0, "mail|contact|write|address"),
    "ip": (0.5, 0.0, "ip|host|server|client|address"),
    "card": (0.3, 0.4, "card|visa|credit|debit|payment|pay"),
    "phone": (0.5, 0.0, "phone|call|tel|mobile|fax|contact"),
    "iban": (0.3, 0.4, "iban|account|bank|transfer"),
    "ssn": (0.4, 0.0, "ssn|social security|tax id"),
    "local": (0.4, 0.0, "phone|call|tel|mobile|fax"),
}
CONTEXT_GAIN = 0.25


def _scored(kind: str) -> str:
    base, gain, words = WEIGHTS[kind]
    near = (f"(m.before RLIKE r'(?i)\\b(?:{words})\\b' OR m.after RLIKE r'(?i)\\b(?:{words})\\b')")
    return (
        f"transform({kind}, m -> named_struct('start', m.start, 'end', m.end, 'text', m.text, "
        f"'score', round({base + gain}D + CASE WHEN {near} THEN {CONTEXT_GAIN}D ELSE 0D END, 2)))"
    )


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id`` and one array column per kind with start, end, text and score of its spans.

    Positions count code points, the end exclusive; spans are in order and do not overlap
    within a kind. A null text counts as empty; rows may repeat and doc_id may be null, each
    row is judged by itself. Columns other than doc_id and text are ignored.
    """
    kinds = BASE + ADDED
    found = find(texts(docs), kinds)
    scored = found.withColumns({k.name: F.expr(_scored(k.name)) for k in kinds})
    return scored.withColumns(
        {k.name: F.expr(f"filter({k.name}, m -> m.score >= {THRESHOLD}D)") for k in ADDED}
    )


def pii_digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and the list of all spans."""
    base, every = [k.name for k in BASE], [k.name for k in BASE + ADDED]
    return find_pii(docs).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(F.expr(digest(base, by_start=False)), 256).alias("base_sha256"),
        F.expr(digest(every, by_start=False)).alias("spans"),
    )
