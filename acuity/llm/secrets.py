"""Secrets: named assignments, access keys, hex runs, and tokens that pass for random.

A token of 20 or more letters, digits and code signs is taken for the encoding with the
smallest alphabet that fits it. Three tests ask whether its characters look drawn at random
from that alphabet: chi-squared for uniform use, the number of runs above and below the
alphabet's middle, and the correlation of neighbours. Fisher's rule joins their p-values.

Whether a small p-value counts against a token is settled for all tokens of about the same
length together (one power of two), by the Benjamini-Hochberg rule at a false-discovery rate
``RATE``: short tokens, with little evidence each and many among them, do not drown long
ones. A token not found out as patterned is a secret. The counts cover the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acuity.llm.common import stage, texts, unused
from acuity.llm.spans import Kind, digest, find, quoted

RATE = 0.05
GRID = 10_000
MASK = "[SECRET]"

_ASSIGN = (
    r"(?i:(?:password|passwd|secret|token|api_?key))[\"']?+\x20*+[:=]\x20*+[\"']?+"
    r"([A-Za-z0-9+/_.=-]++)"
)
BASE = [
    Kind("assign", _ASSIGN, "text RLIKE r'(?i)password|passwd|secret|token|api_?key'",
         "length(m.value) >= 6", value=1),
    Kind("access", r"AKIA[A-Z0-9]++", "contains(text, 'AKIA')", "length(m.text) >= 20"),
    Kind("hex", r"[0-9a-f]{24,}+", r"text RLIKE r'[0-9a-f]{24}'"),
]

_TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])"
_MIXED = "({0} RLIKE '[0-9]' AND {0} RLIKE '[A-Za-z]')"
TOKEN = Kind(
    "token", _TOKEN, r"text RLIKE r'[A-Za-z0-9+/_-]{20}'", _MIXED.format("m.text"),
)

# The alphabets in the order of their codes.
_UPPER, _LOWER, _TEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = [
    ("hex", "^[0-9a-f]+$", _TEN + "abcdef"),
    ("hex_upper", "^[0-9A-F]+$", _TEN + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", "^[a-z0-9]+$", _TEN + _LOWER),
    ("base36_upper", "^[A-Z0-9]+$", _TEN + _UPPER),
    ("base62", "^[A-Za-z0-9]+$", _UPPER + _LOWER + _TEN),
    ("base64", "^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _TEN + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _TEN + "-_"),
    ("mixed", "", _UPPER + _LOWER + _TEN + "+/-_"),
]

#: Hex digits in groups, judged without their dashes.
DASHED = "^(?:(?:[0-9a-f]{4,}+-)++[0-9a-f]{4,}+|(?:[0-9A-F]{4,}+-)++[0-9A-F]{4,}+)$"


def _upper_tail(z: str) -> str:
    """The normal distribution's tail beyond ``z`` by a logistic fit, error below 0.0002."""
    return f"(1D / (1D + exp(1.5976D * ({z}) + 0.07056D * pow({z}, 3D))))"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def randomness(token: str) -> str:
    """SQL for a struct of a token's length bin and its joint p-value, in time linear in its length."""
    alphabet = "CASE " + "".join(
        f"WHEN v RLIKE '{test}' THEN '{chars}' " for _, test, chars in ALPHABETS[:-1]
    ) + f"ELSE '{ALPHABETS[-1][2]}' END"
    n = "double(length(v))"
    # every sign is in the alphabet; those that do not occur add nothing
    squares = (
        "aggregate(transform(array_distinct(cs), c -> "
        "octet_length(v) - octet_length(replace(v, c, ''))), 0D, (t, c) -> t + double(c) * c)"
    )
    codes = "transform(cs, c -> double(instr(abc, c) - 1))"
    shifted = "zip_with(slice(xs, 1, size(xs) - 1), slice(xs, 2, size(xs) - 1), {f})"
    high = "size(filter(xs, x -> 2 * x >= a))"
    runs = (
        "1 + size(filter("
        + shifted.format(f="(x, y) -> (2 * x >= a) != (2 * y >= a)")
        + ", b -> b))"
    )
    mean = "(aggregate(xs, 0D, (t, x) -> t + x) / size(xs))"
    stat = f"""named_struct(
        'chi', a / {n} * {squares} - {n}, 'df', a - 1,
        'up', double({high}), 'runs', double({runs}), 'n', {n},
        'cov', aggregate({shifted.format(f="(x, y) -> (x - mean) * (y - mean)")}, 0D, (t, x) -> t + x),
        'var', aggregate(xs, 0D, (t, x) -> t + (x - mean) * (x - mean)))"""
    z = """named_struct(
        'chi', (pow(t.chi / t.df, 1D / 3) - (1 - 2 / (9 * t.df))) / sqrt(2 / (9 * t.df)),
        'run', CASE WHEN t.up * (t.n - t.up) * 2 <= t.n THEN 9D ELSE
            (t.runs - (2 * t.up * (t.n - t.up) / t.n + 1)) / sqrt(
            (2 * t.up * (t.n - t.up) / t.n) * (2 * t.up * (t.n - t.up) / t.n - 1) / (t.n - 1)) END,
        'cor', CASE WHEN t.var = 0 THEN 9D ELSE (t.cov / t.var + 1 / t.n) * sqrt(t.n) END)"""
    logs = (
        f"-2 * (ln({_upper_tail('least(z.chi, 8D)')})"
        f" + ln(least(1D, 2 * {_upper_tail('least(abs(z.run), 8D)')}))"
        f" + ln(least(1D, 2 * {_upper_tail('least(abs(z.cor), 8D)')})))"
    )
    out = f"""named_struct('bin', int(floor(log2(length({token})))),
        'p', ceil(exp(-f / 2) * (1 + f / 2 + f * f / 8) * {GRID}) / {GRID})"""
    stripped = (f"CASE WHEN {token} RLIKE '{DASHED}' THEN replace({token}, '-', '') "
                f"ELSE regexp_replace({token}, '=+$', '') END")
    # what a long token is spread into lasts while that token is judged, not the whole text's
    for name, value in reversed([
        ("v", stripped), ("abc", alphabet), ("a", "double(length(abc))"), ("cs", "split(v, '')"),
        ("xs", codes), ("mean", mean), ("t", stat), ("z", z), ("f", logs),
    ]):
        out = _let(name, value, out)
    return out


def _cutoffs(judged: DataFrame) -> dict[int, float]:
    """The largest p-value rejected in each length bin; none is rejected where it is absent.

    ``judged`` has ``bin`` and ``p`` of every token. P-values lie on a grid, so the running
    counts have few rows whatever the table; one row per power of two of the token length
    comes to the driver.
    """
    counts = judged.groupBy("bin", "p").agg(F.count(F.lit(1)).alias("n"))
    key = Window.partitionBy("bin")
    ranked = counts.select(
        "bin", "p",
        F.sum("n").over(key.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)).alias("rank"),
        F.sum("n").over(key).alias("all"),
    )
    passed = ranked.filter(F.col("p") <= RATE * F.col("rank") / F.col("all"))
    return {r[0]: r[1] for r in passed.groupBy("bin").agg(F.max("p")).collect()}


def _patterned(cutoffs: dict[int, float], token: str = "m") -> str:
    """SQL for whether a token was found out as not random."""
    cases = "".join(f" WHEN {b} THEN {token}.p <= {float(p)!r}D" for b, p in cutoffs.items())
    return f"(CASE {token}.bin{cases} ELSE false END)" if cases else "false"


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the spans of each kind: assign, access, hex, and random.

    Positions count code points, the end exclusive. A null text counts as empty; rows may
    repeat and doc_id may be null, each row is judged by itself. Columns other than doc_id
    and text are ignored. Spans of different kinds may overlap.
    """
    found = find(texts(docs), [*BASE, TOKEN])
    judged = _let("r", randomness("m.text"), "named_struct('start', m.start, 'end', m.end, "
                  "'text', m.text, 'bin', r.bin, 'p', r.p)")
    found = stage(found.withColumn("token", F.expr(f"transform(token, m -> {judged})")), "secrets")
    cutoffs = _cutoffs(found.select(F.explode("token").alias("t")).select("t.bin", "t.p"))
    secret = F.expr(f"filter(token, m -> NOT {_patterned(cutoffs)})")
    return found.withColumn("random", secret).drop("token")


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts of each kind, the digest of the base spans, and the list of all spans."""
    base = [k.name for k in BASE]
    return find_secrets(docs).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(F.expr(digest(base, by_start=True)), 256).alias("base_sha256"),
        F.expr(digest([*base, "random"], by_start=True)).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the secret part of every span replaced by ``[SECRET]``; no row goes.

    ``n_chars``, where there is such a column, follows the new text. Null texts stay null.
    """
    at = quoted(_TOKEN)
    hits = f"regexp_extract_all(text, {at}, 0)"
    # outer, as a filter on the matches would be pushed ahead of them with all that they are made of
    tokens = texts(docs).select(F.explode_outer(F.expr(hits)).alias("text")).filter(
        F.expr(_MIXED.format("text"))
    )
    judged = tokens.select(F.expr(randomness("text")).alias("t"))
    cutoffs = _cutoffs(judged.select("t.bin", "t.p"))
    hit = unused("_hit", docs.columns)
    patterned = _let("r", randomness("x"), _patterned(cutoffs, "r"))
    keep = f"NOT {_MIXED.format('x')} OR {patterned}"
    new = f"transform({hit}, x -> CASE WHEN {keep} THEN x ELSE '{MASK}' END)"
    out = docs.withColumn(hit, F.expr(hits)).withColumn("text", F.expr(
        f"CASE WHEN size({hit}) = 0 THEN text ELSE array_join(flatten(zip_with("
        f"split(text, {at}, -1), {new}, (g, h) -> array(g, coalesce(h, '')))), '') END"
    ))
    named = _ASSIGN.replace("([A-Za-z0-9+/_.=-]++)", "[A-Za-z0-9+/_.=-]{6,}+")
    head, tail = named.rsplit("[A-Za-z0-9+/_.=-]{6,}+", 1)
    text = F.regexp_replace("text", f"({head})[A-Za-z0-9+/_.=-]{{6,}}+{tail}", f"$1{MASK}")
    text = F.regexp_replace(text, "AKIA[A-Z0-9]{16,}+", MASK)
    out = out.withColumn("text", F.regexp_replace(text, "[0-9a-f]{24,}+", MASK))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
