"""URL verdicts: the longest fitting rule, else gradient-boosted trees on lexical features.

The trees see only the shape of a URL: lengths, depth, digits, entropy, parameters, hyphens
and how often the host's last label went with unwanted URLs in training. They are trained on
every distinct labelled URL, here those of known unwanted and of other hosts; the rates of
all last labels are a table that is joined, however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acuity.llm.common import column, stage

# Rules as (verdict, host, path); the rule text is host and path together.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Names in a host's labels that make a URL a labelled unwanted one.
UNWANTED = ["adult", "casino", "spam", "pills", "bets", "ads", "track", "porn", "malware"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOST_CHARS = _LOWER + "0123456789-."
FEATURES = ["length", "host_length", "labels", "depth", "digits", "host_digits", "hyphens",
            "entropy", "parameters", "longest", "suffix_rate"]


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; both empty without ``://``."""
    url = F.coalesce(column(pages, url_col).cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return pages.select("*", rest.alias("_rest")).select(
        "*",
        F.translate(F.regexp_extract("_rest", "^[^/?#]*", 0), _UPPER, _LOWER).alias("host"),
        F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
    ).drop("_rest")


def rule_of(rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Columns for the text and the verdict of the longest rule that fits host and path."""
    name = verdict = None
    for said, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = (
            ((F.col("host") == host) | F.col("host").endswith(f".{host}"))
            & F.col("path").startswith(path)
        )
        if name is None:
            name, verdict = F.when(fits, host + path), F.when(fits, said)
        else:
            name, verdict = name.when(fits, host + path), verdict.when(fits, said)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def _count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("double")


def _suffix() -> Column:
    return F.substring_index("host", ".", -1)


def suffix_rates(labelled: DataFrame) -> DataFrame:
    """Each last label of a host with its URLs and the share of unwanted ones, drawn to a half; stored."""
    return stage(
        labelled.groupBy(_suffix().alias("_suffix")).agg(
            F.count(F.lit(1)).alias("_urls"),
            ((F.sum("label") + 1) / (F.count(F.lit(1)) + 2)).alias("_rate")),
        "rates",
    )


def with_features(urls: DataFrame, rates: DataFrame) -> DataFrame:
    """Add the lexical features; ``urls`` has url, host and path, ``rates`` is by :func:`suffix_rates`.

    A last label without a rate takes the mean of all.
    """
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    size = F.greatest(F.length(host), F.lit(1)).cast("double")
    share = F.transform(
        F.array(*[F.lit(c) for c in _HOST_CHARS]),
        lambda c: (F.length(host) - F.length(F.replace(host, c, F.lit("")))) / size,
    )
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: F.when(p > 0, a - p * F.log2(p))
                          .otherwise(a))
    digits = lambda t: F.length(F.regexp_replace(t, "[^0-9]+", "")).cast("double")
    mean = rates.agg(F.avg("_rate")).first()[0]
    rated = urls.withColumn("_suffix", _suffix()).join(rates.select("_suffix", "_rate"), "_suffix", "left")
    return rated.withColumns({
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": _count(host, ".") + 1,
        "depth": _count(path, "/"),
        "digits": digits(url) / F.greatest(F.length(url), F.lit(1)),
        "host_digits": digits(host) / size,
        "hyphens": _count(host, "-"),
        "entropy": entropy,
        "parameters": _count(url, "=") + _count(url, "&"),
        "longest": F.array_max(F.transform(F.split(host, "[.]"), lambda x: F.length(x)))
        .cast("double"),
        "suffix_rate": F.coalesce("_rate", F.lit(mean)),
    }).drop("_suffix", "_rate")


def label_hosts(urls: DataFrame, unwanted: list[str] = UNWANTED) -> DataFrame:
    """Add ``label``: 1 where a part of the host is an unwanted name, 0 elsewhere; null: no host."""
    bad = F.col("host").rlike(f"(?:^|[.-])(?:{'|'.join(unwanted)})(?:[.-]|$)")
    return urls.withColumn("label", F.when(F.col("host") != "", bad.cast("double")))


@dataclass
class UrlModel:
    """Trained trees and a table of suffix rates, or one verdict where a class was missing."""

    trees: GBTClassificationModel | None
    rates: DataFrame | None
    constant: float = 0.0

    def probability(self, urls: DataFrame) -> DataFrame:
        """Add ``unwanted``, the probability of class 1, keeping the other columns."""
        if self.trees is None:
            return urls.withColumn("unwanted", F.lit(self.constant))
        rows = with_features(urls, self.rates)
        rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows)
        return self.trees.transform(rows).select(
            *urls.columns, vector_to_array("_probability")[1].alias("unwanted")
        )


def train(labelled: DataFrame, *, sample: int | None = None, seed: int = 7) -> UrlModel:
    """Fit on every distinct labelled URL; ``labelled`` has url, host, path, label.

    A caller may bound the URLs of each class by ``sample``; the smallest hashes are taken then.
    """
    rows = labelled.filter(F.col("label").isNotNull()).select("url", "host", "path", "label")
    taken = rows.dropDuplicates(["url"])
    if sample is not None:
        parts = [
            taken.filter(F.col("label") == c).orderBy(F.xxhash64("url"), "url").limit(sample)
            for c in (0.0, 1.0)
        ]
        taken = parts[0].unionByName(parts[1])
    taken = stage(taken, "urls")
    counts = {r[0]: r[1] for r in taken.groupBy("label").count().collect()}
    if len(counts) < 2:
        return UrlModel(None, None, constant=1.0 if counts.get(1.0) else 0.0)
    rates = suffix_rates(taken)
    rows = with_features(taken, rates)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows)
    trees = GBTClassifier(
        featuresCol="_features", labelCol="label", predictionCol="_class",
        maxIter=12, maxDepth=4, seed=seed,
    ).setProbabilityCol("_probability").setRawPredictionCol("_raw").fit(rows.select("_features", "label"))
    return UrlModel(trees, rates)


def judge(pages: DataFrame, model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (null without one) and ``verdict`` of each row.

    Without a model, one is trained on the pages' own labelled hosts. A null or malformed
    URL has an empty host and path; the trees judge it too. Rows may repeat; page_id may be
    null. Columns other than page_id and url are ignored.
    """
    urls = with_parts(pages.select(
        column(pages, "page_id").cast("long").alias("page_id"),
        column(pages, "url").cast("string").alias("url"),
    ))
    model = model or train(label_hosts(urls))
    name, said = rule_of()
    scored = model.probability(urls)
    verdict = F.coalesce(
        said, F.when(F.col("unwanted") > threshold, "block").otherwise("allow")
    )
    return scored.select(
        "page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"),
        F.round("unwanted", 4).alias("unwanted"),
    )
