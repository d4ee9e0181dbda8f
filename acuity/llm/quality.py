"""Document quality from a linear-chain conditional random field over lines.

Each line of a whole text is good or bad. A line's evidence is what its signs and words look
like, and what the lines before and after it look like; neighbouring labels are tied by a
weight for each pair of labels. Forward and backward passes give each line's chance to be
good, and their mean, weighted by the lines' lengths, is the document's score.

Labels are per document, so in training every line carries the label of its text. The fit
reads at most ``SAMPLE`` labelled texts of each class, picked by a hash of the id, and of each
a stretch of at most ``LINES`` neighbouring lines; the driver holds no more than that. Rows
whose crc32 of doc_id is divisible by ``FOLDS`` are never learnt from. Every text is then
scored whole, in place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acuity.llm.common import column, texts

SAMPLE, LINES, FOLDS, ACCEPT = 1_500, 32, 5, 0.3
#: Bytes of text and number of lines whose evidence is held at once (one text at least).
TEXT_BYTES, AT_ONCE = 1 << 22, 1 << 15

#: Signs by class: letters, capitals, digits, blanks, sentence marks, other marks, bytes inside a sign.
KINDS = ("lower", "upper", "digit", "blank", "mark", "symbol", "inside")
FEATURES = ("length", "letters", "capitals", "digits", "blanks", "marks", "symbols", "word_length",
            "distinct", "commonest", "words", "repeated", "closed", "empty")


def _kinds() -> np.ndarray:
    out = np.full(256, KINDS.index("symbol"), np.uint8)
    for name, signs in (("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                        ("digit", b"0123456789"), ("blank", b" \t\r\x0b\x0c"), ("mark", b".,;:!?'\"()-")):
        out[list(signs)] = KINDS.index(name)
    out[0x80:0xC0] = KINDS.index("inside")
    out[0xC0:] = KINDS.index("lower")
    return out


_KIND = _kinds()


def line_features(text: bytes) -> np.ndarray:
    """One row of ``FEATURES`` per line of a text; an empty text is one empty line."""
    lines = text.split(b"\n")
    size = np.array([len(x) for x in lines], np.int64)
    kinds = _KIND[np.frombuffer(text, np.uint8)]
    start = np.cumsum(size + 1) - size - 1
    bounds = np.stack([start, start + size], axis=1)
    counts = np.empty((len(lines), len(KINDS)), np.float32)
    for k in range(len(KINDS)):
        total = np.r_[0, np.cumsum(kinds == k, dtype=np.int32)]
        counts[:, k] = total[bounds[:, 1]] - total[bounds[:, 0]]
    signs = np.maximum(size - counts[:, 6], 1).astype(np.float32)
    seen = Counter(lines)
    out = np.zeros((len(lines), len(FEATURES)), np.float32)
    letters = counts[:, 0] + counts[:, 1]
    out[:, 0] = np.log1p(signs)
    out[:, 1] = letters / signs
    out[:, 2] = counts[:, 1] / np.maximum(letters, 1)
    out[:, 3:7] = counts[:, 2:6] / signs[:, None]
    for i, line in enumerate(lines):
        words = line.split()
        if words:
            each = Counter(words)
            out[i, 8:11] = len(each) / len(words), max(each.values()) / len(words), np.log1p(len(words))
            out[i, 7] = np.log1p(signs[i] / len(words))
            out[i, 11] = seen[line] > 1
            out[i, 12] = line.rstrip()[-1:] in b".!?:;"
        else:
            out[i, 13] = 1
    return out


@dataclass
class LineModel:
    """Standardisation, line weights, and label-pair weights (rows: this line, columns: next; 1 is good)."""

    mean: np.ndarray
    scale: np.ndarray
    own: np.ndarray
    square: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    pairs: np.ndarray

    def evidence(self, features: np.ndarray) -> np.ndarray:
        """Log-odds of good from each line's surroundings, for the lines of one text."""
        out = np.full(len(features), self.bias)
        for at in range(0, len(features), AT_ONCE):
            begin, end = max(0, at - 1), min(len(features), at + AT_ONCE + 1)
            z = standard(features[begin:end], self.mean, self.scale)
            here = slice(at - begin, min(at - begin + AT_ONCE, len(z)))
            mine = z @ self.own + (z * z) @ self.square
            part = mine[here].copy()
            left, right = z @ self.before, z @ self.after
            part += np.r_[0.0, left][:-1][here] if begin == at else left[here.start - 1 : here.stop - 1]
            part += np.r_[right, 0.0][1:][here]
            out[at : at + AT_ONCE] += part
        return out


def standard(features: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((features.astype(np.float64) - mean) / scale, -4, 4)


def marginals(evidence: np.ndarray, sizes: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Chances of good for every line of every chain, the sum of log partition values, and
    the expected number of each label pair.

    ``evidence`` joins the chains, whose lengths are ``sizes``, all at least 1. Chains go side
    by side, longest first, so that a step works on all that have not ended.
    """
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    longest = int(sizes[0])
    live = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    weight = np.exp(pairs - pairs.max())
    ahead = np.empty((len(evidence), 2))
    behind = np.ones((len(evidence), 2))
    # potentials of a line, the larger one 1
    line = np.stack([np.exp(np.minimum(-evidence, 0)), np.exp(np.minimum(evidence, 0))], axis=1)
    log_z = float(np.maximum(evidence, 0).sum() + pairs.max() * (sizes - 1).sum())
    for t in range(longest):
        at = start[: live[t]] + t
        now = line[at] if t == 0 else (ahead[at - 1] @ weight) * line[at]
        total = now.sum(axis=1, keepdims=True)
        ahead[at] = now / total
        log_z += float(np.log(total).sum())
    both = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = start[: live[t + 1]] + t
        inner = line[at + 1] * behind[at + 1]
        joint = ahead[at][:, :, None] * weight[None] * inner[:, None, :]
        both += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = inner @ weight.T
        behind[at] = back / back.sum(axis=1, keepdims=True)
    good = ahead * behind
    return good[:, 1] / good.sum(axis=1), log_z, both


def design(z: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Columns for the line itself, its squares, the line before, the line after, and one."""
    first = np.zeros(len(z), bool)
    first[np.cumsum(sizes) - sizes] = True
    last = np.roll(first, -1)
    before, after = np.roll(z, 1, axis=0), np.roll(z, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.hstack([z, z * z, before, after, np.ones((len(z), 1))])


def objective(par: np.ndarray, x: np.ndarray, sizes: np.ndarray, good: np.ndarray, weight: np.ndarray,
              penalty: float) -> tuple[float, np.ndarray]:
    """Mean penalised log-likelihood a line, and its gradient. ``weight`` is per class."""
    d = x.shape[1]
    pairs = np.concatenate([[0.0], par[d:]]).reshape(2, 2)
    evidence = x @ par[:d]
    n = len(x)
    value, grad = 0.0, np.zeros_like(par)
    of_line = np.repeat(good, sizes)
    for label in (0, 1):
        lines, chains = of_line == label, good == label
        chance, log_z, both = marginals(evidence[lines], sizes[chains], pairs)
        steps = float((sizes[chains] - 1).sum())
        value += weight[label] * (label * evidence[lines].sum() + steps * pairs[label, label] - log_z)
        grad[:d] += weight[label] * (x[lines].T @ (label - chance))
        held = np.zeros((2, 2))
        held[label, label] = steps
        grad[d:] += weight[label] * (held - both).ravel()[1:]
    loose = par.copy()
    loose[d - 1] = 0
    return value / n - penalty / 2 * float(loose @ loose), grad / n - penalty * loose


def fit(features: Sequence[np.ndarray], good: np.ndarray, *, penalty: float = 1e-3, steps: int = 300,
        rate: float = 0.05, enough: float = 1e-4) -> LineModel:
    """Weights for stretches of lines with the labels of their texts, both of which must occur.

    Adam on the whole sample, until no gradient is over ``enough``; both classes count alike.
    """
    sizes = np.array([len(f) for f in features])
    rows = np.concatenate(features)
    mean, scale = rows.mean(axis=0, dtype=np.float64), rows.std(axis=0, dtype=np.float64)
    scale = np.where(scale > 1e-6, scale, 1.0)
    x = design(standard(rows, mean, scale), sizes)
    lines = np.array([sizes[good == k].sum() for k in (0, 1)])
    weight = lines.sum() / (2.0 * lines)
    par = np.zeros(x.shape[1] + 3)
    m, v = np.zeros_like(par), np.zeros_like(par)
    for step in range(1, steps + 1):
        _, grad = objective(par, x, sizes, good, weight, penalty)
        if np.abs(grad).max() < enough:
            break
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        par += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    k = rows.shape[1]
    return LineModel(mean, scale, par[:k], par[k : 2 * k], par[2 * k : 3 * k], par[3 * k : 4 * k],
                     float(par[4 * k]), np.concatenate([[0.0], par[4 * k + 1 :]]).reshape(2, 2))


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    """Whether a row is kept from training; so is a null doc_id, which stands as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch.column(0).to_pylist(), []
        for doc, text in zip(ids, batch.column(2).to_pylist()):
            rows = line_features(text.encode())
            begin = doc % max(1, len(rows) - LINES + 1)
            out.append(rows[begin : begin + LINES].ravel())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float32()))],
            ["doc_id", "good", "rows"])


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> LineModel | None:
    """Fit on labelled texts outside the held-out fold; None unless both classes are there.

    Labels other than 0 and 1 and null ids are left out; of several labels of an id the
    largest counts, and of several texts the smallest.
    """
    marks = labels.select(
        column(labels, "doc_id").cast("long").alias("doc_id"),
        column(labels, "quality").cast("int").alias("good"),
    ).filter(~held_out() & F.col("doc_id").isNotNull() & F.col("good").isin(0, 1)).groupBy("doc_id").agg(
        F.max("good").alias("good"))
    taken = [marks.filter(F.col("good") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
             for c in (0, 1)]
    # at most two samples of ids: bounded whatever the tables
    ids = F.broadcast(taken[0].unionByName(taken[1]))
    rows = texts(docs).join(ids, "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text")).select(
        "doc_id", "good", "text")
    found = rows.mapInArrow(_stretches, "doc_id long, good int, rows array<float>").toArrow()
    found = found.sort_by("doc_id")
    good = found.column("good").to_numpy().astype(int)
    if len(set(good)) < 2:
        return None
    features = [np.asarray(r.values).reshape(-1, len(FEATURES)) for r in found.column("rows")]
    return fit(features, good)


def line_chances(docs: DataFrame, model: LineModel | None) -> DataFrame:
    """``doc_id``, and of each line of the text its chance to be good and its length in bytes, in order.

    Without a model every chance is one half.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, source = batch.column(0), [t.encode() for t in batch.column(1).to_pylist()]
            bounds, held = [0], 0
            for i, text in enumerate(source):
                if held and held + len(text) > TEXT_BYTES:
                    bounds.append(i)
                    held = 0
                held += len(text)
            for a, b in zip(bounds, [*bounds[1:], len(source)]):
                if a < b:
                    yield _chances(ids.slice(a, b - a), source[a:b], model)

    return texts(docs).mapInArrow(run, "doc_id long, good array<double>, lengths array<long>")


def _chances(ids: pa.Array, source: list[bytes], model: LineModel | None) -> pa.RecordBatch:
    lengths = [np.array([len(x) for x in t.split(b"\n")], np.int64) for t in source]
    sizes = np.array([len(x) for x in lengths])
    if model is None:
        chance = np.full(sizes.sum(), 0.5)
    else:
        evidence = np.concatenate([model.evidence(line_features(t)) for t in source])
        chance = marginals(evidence, sizes, model.pairs)[0]
    offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
    return pa.RecordBatch.from_arrays(
        [ids, pa.ListArray.from_arrays(offsets, pa.array(chance, pa.float64())),
         pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lengths), pa.int64()))],
        ["doc_id", "good", "lengths"])


def score_texts(docs: DataFrame, model: LineModel | None, *, accept: float = ACCEPT) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 at ``accept`` or more) of every row.

    Lines weigh as their length in bytes and one more. A null or empty text is one empty line.
    Rows may repeat; columns other than doc_id and text are ignored; no rows give no rows.
    """
    weight = F.transform("lengths", lambda x: x + 1)
    add = lambda a, x: a + x
    total = F.aggregate(weight, F.lit(0).cast("long"), add)
    mass = F.aggregate(F.zip_with("good", weight, lambda p, w: p * w), F.lit(0.0), add)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(mass / total, 9)))
    return line_chances(docs, model).select(
        "doc_id", held_out().alias("held_out"), score.alias("score"),
    ).withColumn("predicted", (F.col("score") >= accept).cast("int"))
