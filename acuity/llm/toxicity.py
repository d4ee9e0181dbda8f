"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

One weight per word serves all grades; ordered thresholds cut the score into grade 0 (clean)
to ``GRADES``: logit P(grade > k) = w.x - t_k, with t_0 < t_1 < ... The labels say toxic or
not, so the grade of a toxic training text is found first: how often it uses words that are
tied to toxic texts (logarithms of counts, added), cut at the terciles of the sample. The
grades above clean thus follow from words that are features too: they order toxic texts by
how much they hold of what marks them, and say nothing about severity beyond that.

Training reads at most ``SAMPLE`` labelled texts of each class, picked by a hash of the id,
and keeps the ``WORDS`` words with the largest difference between the classes. What comes to
the driver is bounded by these two numbers. Every text is then scored whole, in place.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from acuity.llm.common import column, reserve, stage, texts, unused

SAMPLE, WORDS, GRADES, LEAST = 4_000, 512, 3, 5
_WORD = re.compile(r"[^\W\d_]+")


def counted(text: str | None) -> Counter:
    """Lower-cased letter runs of a whole text with their counts."""
    return Counter(_WORD.findall((text or "").lower()))


@dataclass
class OrdinalModel:
    """Word weights shared by all grades, and the ascending thresholds between grades."""

    weights: dict[str, float]
    thresholds: list[float]

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k; no columns where nothing was learnt."""
        cut = np.asarray(self.thresholds, dtype=float).reshape(1, -1)
        return 1.0 / (1.0 + np.exp(-np.clip(score.reshape(-1, 1) - cut, -500, 500)))

    def scores(self, batch: list[str | None]) -> np.ndarray:
        known, find = self.weights, _WORD.findall
        return np.array([
            sum(known[w] * np.log1p(c)
                for w, c in Counter(filter(known.__contains__, find((t or "").lower()))).items())
            for t in batch
        ], dtype=float)


def _cuts(par: np.ndarray, d: int) -> np.ndarray:
    """Thresholds from a first value and the logarithms of the steps, so that their order always holds."""
    return par[d] + np.concatenate([[0.0], np.cumsum(np.exp(par[d + 1 :]))])


def loss(par: np.ndarray, x: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int,
         penalty: float) -> tuple[float, np.ndarray]:
    """Penalised negative log-likelihood, and its gradient. ``weight`` adds up to one."""
    n, d = x.shape
    w, gaps = par[:d], np.exp(par[d + 1 :])
    z = (x @ w)[:, None] - _cuts(par, d)[None, :]
    over = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    # P(grade = g) is the difference of neighbouring tails
    tails = np.hstack([np.ones((n, 1)), over, np.zeros((n, 1))])
    slope = np.hstack([np.zeros((n, 1)), over * (1 - over), np.zeros((n, 1))])
    rows = np.arange(n)
    mass = np.maximum(tails[rows, grade] - tails[rows, grade + 1], 1e-12)
    by_tail = np.zeros((n, grades + 2))
    by_tail[rows, grade] = slope[rows, grade] / mass
    by_tail[rows, grade + 1] -= slope[rows, grade + 1] / mass
    by_z = by_tail[:, 1:-1] * weight[:, None]
    by_cut = -by_z.sum(axis=0)
    grad = np.concatenate([
        x.T @ by_z.sum(axis=1) - penalty * w,
        [by_cut.sum()],
        [by_cut[k:].sum() * gaps[k - 1] for k in range(1, grades)],
    ])
    return penalty / 2 * float(w @ w) - float(weight @ np.log(mass)), -grad


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, *,
             steps: int = 2_000, enough: float = 1e-6, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton descent, until no part of the gradient is over ``enough``."""
    x, (value, grad) = start, f(start)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(grad).max() < enough:
            break
        way, kept = -grad, []
        for s, y in reversed(past):
            kept.append((a := (s @ way) / (s @ y)))
            way = way - a * y
        if past:
            s, y = past[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), a in zip(past, reversed(kept)):
            way = way + s * (a - (y @ way) / (s @ y))
        length = 1.0 if past else min(1.0, 1.0 / np.abs(grad).max())
        slope = grad @ way
        for _ in range(40):
            nx = x + length * way
            nv, ng = f(nx)
            if nv <= value + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        s, y = nx - x, ng - grad
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y)]
        x, value, grad = nx, nv, ng
    return x


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int = GRADES,
                *, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Word weights and thresholds at the minimum of the weighted loss."""
    d = x.shape[1]
    share = [max(1e-3, min(1 - 1e-3, np.average(grade > k, weights=weight))) for k in range(grades)]
    first = [np.log((1 - s) / s) for s in share]
    start = np.concatenate([np.zeros(d), first[:1], np.log(np.maximum(np.diff(first), 0.05))])
    weight = weight / weight.sum()
    par = minimise(lambda p: loss(p, x, grade, weight, grades, penalty), start)
    return par[:d], _cuts(par, d)


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    marks = labels.select(
        column(labels, "doc_id").cast("long").alias("doc_id"),
        column(labels, "toxic").cast("int").alias("toxic"),
    ).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    totals = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    taken = [marks.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
             for c in (0, 1)]
    # at most two samples of ids: bounded whatever the tables
    ids = F.broadcast(taken[0].unionByName(taken[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([list(c) for c in found], pa.list_(pa.string())),
                 pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))],
                ["doc_id", "toxic", "words", "counts"],
            )

    rows = texts(docs).join(ids, "doc_id").select("doc_id", "toxic", "text")
    return stage(rows.mapInArrow(
        run, "doc_id long, toxic int, words array<string>, counts array<int>"
    ), "labelled"), totals


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, words: int = WORDS,
          grades: int = GRADES) -> OrdinalModel:
    """Fit on labelled texts; without texts of both classes, a model that finds nothing toxic."""
    rows, totals = _sample(docs, labels, sample)
    taken = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(taken) < 2:
        return OrdinalModel({}, [])
    seen = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum(F.col("toxic").cast("double")).alias("bad"),
        F.sum(1.0 - F.col("toxic").cast("double")).alias("good"),
    ).filter(F.col("bad") + F.col("good") >= LEAST)
    p, q = F.col("bad") / taken[1], F.col("good") / taken[0]
    pooled = (F.col("bad") + F.col("good")) / (taken[0] + taken[1])
    z = (p - q) / F.sqrt(pooled * (1 - pooled) * (1 / taken[0] + 1 / taken[1]) + 1e-12)
    best = seen.select("word", z.alias("z"), (p > 5 * q).alias("tied")).orderBy(
        F.desc(F.abs("z")), "word").limit(words).collect()
    at = {r["word"]: i for i, r in enumerate(best)}
    tied = {r["word"] for r in best if r["tied"]}
    kept = F.array(*[F.lit(w) for w in at])
    slim = rows.select(
        "toxic",
        F.filter(F.arrays_zip("words", "counts"), lambda e: F.array_contains(kept, e["words"]))
        .alias("hits"),
    ).orderBy("doc_id").collect()  # at most two samples of rows, each of at most ``words`` hits
    x = np.zeros((len(slim), len(at)))
    toxic = np.array([r["toxic"] for r in slim])
    for i, r in enumerate(slim):
        for e in r["hits"]:
            x[i, at[e["words"]]] = np.log1p(e["counts"])
    # summed word by word in one order, and compared after rounding: equal texts never part
    amount = np.round(x @ np.array([float(w in tied) for w in at]), 6)
    cuts = np.round(np.quantile(amount[toxic == 1], [k / grades for k in range(1, grades)]), 6)
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, amount, side="right"), 0)
    weight = np.where(toxic == 1, totals[1] / taken[1], totals[0] / taken[0])
    w, thresholds = fit_ordinal(x, grade, weight, grades)
    return OrdinalModel({r["word"]: float(w[i]) for i, r in enumerate(best)},
                        [float(t) for t in thresholds])


def with_tails(docs: DataFrame, model: OrdinalModel, name: str = "_above", grades: int = GRADES
               ) -> DataFrame:
    """``docs`` with the probabilities that the grade exceeds 0, 1, ... in column ``name``."""
    reserve([name], docs.columns)
    if not model.thresholds:
        return docs.withColumn(name, F.array(*[F.lit(0.0)] * grades))
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = model.above(model.scores(batch.column(where).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(above), pa.list_(pa.float64()))],
                [*batch.schema.names, name],
            )

    schema = StructType(list(docs.schema.fields)).add(name, ArrayType(DoubleType()))
    return docs.mapInArrow(run, schema)


def grade_texts(docs: DataFrame, model: OrdinalModel, *, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``toxic``, ``severity`` and ``expected_severity`` of every row.

    ``severity`` is the number of thresholds passed with more than an even chance, ``toxic``
    whether the first is passed by ``threshold``; ``expected_severity`` is the sum of the
    chances. A null or empty text has no words and gets the grade of that. Rows may repeat
    and doc_id may be null. Columns other than doc_id and text are ignored.
    """
    rows = with_tails(texts(docs), model)
    return rows.select(
        "doc_id",
        (F.col("_above")[0] > threshold).alias("toxic"),
        F.size(F.filter("_above", lambda p: p > 0.5)).alias("severity"),
        F.round(F.aggregate("_above", F.lit(0.0), lambda a, p: a + p), 4)
        .alias("expected_severity"),
    )


def drop_toxic(docs: DataFrame, model: OrdinalModel, *, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows graded toxic, all columns kept, whatever their names."""
    name = unused("_above", docs.columns)
    rows = with_tails(docs, model, name)
    return rows.filter(F.col(name)[0] <= threshold).drop(name)
