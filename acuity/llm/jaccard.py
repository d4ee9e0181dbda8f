"""Near copies by the Jaccard similarity of word shingles, found without loss.

A text is the set of its distinct shingles of five words (the whole text where it has fewer).
In an order of all shingles that is the same everywhere, two sets of similarity ``SIMILARITY``
share one of their first ``n - ceil(SIMILARITY * n) + 1`` shingles, so only those meet. The
order puts the shingles that are common in a sample of the texts last; the sample decides how
many pairs are compared, never which are found. A candidate pair is first compared by
profiles, counts of the shingles by the first byte of their hash: the sum of the smaller
counts is never less than the number of common shingles. Pairs that may still be similar are
then compared by their whole sets. Equal sets meet as one.

Up to ``PLAIN`` sets that share a leading shingle are compared pair by pair. In larger groups
all are first compared with a few of them; those that this has not put in one class with each
other are compared pair by pair afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acuity.llm.common import components, in_table, key_place, key_table, stage, texts
from acuity.llm.decontam import _BASE, _chunks, _mix, _power
from acuity.llm.simhash import one_of_each

WORDS, SIMILARITY = 5, 0.8
PLAIN, CENTRES = 64, 3
SAMPLE, COMMON = 16, 1 << 18

_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_MANY = 1 << 20
#: Largest number in a profile.
_FULL = 65_535


def shingles(raw: np.ndarray, starts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the distinct shingles of each text, sorted by both.

    ``raw`` holds texts in UTF-8, laid end to end from ``starts`` on. Words are parted by ASCII
    white space and taken in ASCII lower case.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(raw):
        return none
    space, fresh = _SPACE[raw], np.zeros(len(raw), dtype=bool)
    fresh[starts[starts < len(raw)]] = True
    new = ~space
    new[1:] &= space[:-1] | fresh[1:]
    first = np.flatnonzero(new)
    if not len(first):
        return none
    ends = np.append(np.flatnonzero(space | fresh), len(raw))
    last = ends[np.searchsorted(ends, first, side="right")]
    forward, back = _power(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_LOWER[raw] * forward[: len(raw)], out=sums[1:])
    code = _mix((sums[last] - sums[first]) * back[first])
    text = np.searchsorted(starts, first, side="right") - 1

    def fold(at: np.ndarray, n: int) -> np.ndarray:
        mixed = np.full(len(at), n, dtype=np.uint64)
        for i in range(n):
            mixed = _mix((mixed ^ code[at + i]) * np.uint64(_BASE))
        return mixed

    whole = np.flatnonzero(text[: max(0, len(text) - words + 1)] == text[words - 1 :])
    found = [(text[whole], fold(whole, words))]
    numbers, head, counts = np.unique(text, return_index=True, return_counts=True)
    for n in range(1, words):
        found.append((numbers[counts == n], fold(head[counts == n], n)))
    text, code = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    keep = np.append(True, (text[1:] != text[:-1]) | (code[1:] != code[:-1]))
    return text[keep], code[keep]


def _sets(batch: list[bytes | None], words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number and sorted shingle hashes of each text of a batch, empty sets included."""
    for begin, raw, starts in _chunks(batch):
        text, code = shingles(raw, starts, words)
        bounds = np.searchsorted(text, np.arange(len(starts) + 1))
        for i in range(len(starts)):
            yield begin + i, code[bounds[i] : bounds[i + 1]]


def _node(codes: np.ndarray) -> int:
    """Name of a set: equal sets have one, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(codes.tobytes())).view(np.int64))


def _profile(codes: np.ndarray) -> bytes:
    """Number of shingles by the first byte of their hash; the largest number stands for any more."""
    counts = np.bincount((codes >> np.uint64(56)).astype(np.int64), minlength=256)
    return np.minimum(counts, _FULL).astype("<u2").tobytes()


def _plausible(pairs: DataFrame, least: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs whose profiles leave it open that they are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, 256) for i in (4, 5))
            most = np.minimum(a, b).sum(axis=1, dtype=np.int64)
            open_ = (np.maximum(a, b).max(axis=1, initial=0) == _FULL) | (
                most >= similarity * (sizes - most) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(open_))

    side = lambda name: least.select(
        F.col("node").alias(name), F.col("size").alias(f"{name}_size"), F.col("profile").alias(f"{name}_profile"))
    return pairs.join(side("u"), "u").join(side("v"), "v").select(
        "u", "v", "u_size", "v_size", "u_profile", "v_profile").mapInArrow(run, "u long, v long")


def _signed(codes: np.ndarray) -> np.ndarray:
    return codes.view(np.int64)


def _common(rows: DataFrame, words: int, sample: int):
    """The shingles that repeat most in a sample, the most frequent last; a broadcast of 4 MB at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, starts in _chunks(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(_signed(shingles(raw, starts, words)[1]))], ["w"])

    counts = (
        rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0).mapInArrow(run, "w long")
        .groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
        .orderBy(F.desc("n"), "w").limit(COMMON)
    )
    w = np.array([r[0] for r in counts.select("w").collect()], dtype=np.int64).view(np.uint64)
    order = np.argsort(w)
    return rows.sparkSession.sparkContext.broadcast((w[order], (len(w) - order).astype(np.int64)))


def _leading(rows: DataFrame, words: int, similarity: float, common) -> DataFrame:
    """``doc_id``, the name, size and profile of its set, and the set's leading shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = common.value
        for batch in batches:
            at, nodes, sizes, shapes, lead = [], [], [], [], []

            def out():
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(nodes, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(shapes, pa.binary()),
                     pa.array(lead, pa.list_(pa.int64()))],
                    ["doc_id", "node", "size", "profile", "lead"],
                )

            held = 0
            for i, codes in _sets(batch.column(1).to_pylist(), words):
                n = len(codes)
                at.append(i)
                nodes.append(_node(codes))
                sizes.append(n)
                shapes.append(_profile(codes))
                if len(keys) and n:
                    k = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
                    codes = codes[np.argsort(np.where(keys[k] == codes, ranks[k], 0), kind="stable")]
                lead.append(_signed(codes[: n - math.ceil(similarity * n - 1e-9) + 1]))
                held += len(lead[-1])
                if held > _MANY:
                    yield out()
                    at, nodes, sizes, shapes, lead, held = [], [], [], [], [], 0
            if at:
                yield out()

    return rows.mapInArrow(run, "doc_id long, node long, size long, profile binary, lead array<long>")


def _kept(sets: DataFrame, least: DataFrame) -> DataFrame:
    """``sets`` without most of those that are equal to one of a smaller doc_id.

    Told by a bit table ahead of the shuffle; the copies that pass meet there and count once.
    """
    table = key_table(least, "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(in_table(table.value, batch.column(0).to_numpy()))
            yield batch.select(["node", "size", "lead"]).filter(keep)

    return sets.select(key_place("doc_id").alias("place"), "node", "size", "lead").mapInArrow(
        run, "node long, size long, lead array<long>")


def _may_match(size_a, at_a, size_b, at_b, similarity: float) -> np.ndarray:
    """Whether two sets may be similar if this shingle is the first that both lead with."""
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    most = np.minimum(size_a - at_a, size_b - at_b)
    need = similarity / (1 + similarity) * (size_a + size_b)
    return (small >= similarity * large - 1e-9) & (most >= need - 1e-9)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows in blocks of whole groups of the first column; repeated rows once."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(now[0]):
            continue
        cut = 0
        if now[0][0] != now[0][-1]:
            cut = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1
        elif held and held[-1][0][-1] != now[0][0]:
            yield _once(held)
            held = []
        if cut:
            held.append([c[:cut] for c in now])
            yield _once(held)
            held = []
        held.append([c[cut:] for c in now])
    if held:
        yield _once(held)


def _once(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    columns = [np.concatenate(c) for c in zip(*held)]
    keep = np.append(True, (columns[0][1:] != columns[0][:-1]) | (columns[2][1:] != columns[2][:-1]))
    return [c[keep] for c in columns]


def _pairs_out(u: np.ndarray, v: np.ndarray, kind: int) -> pa.RecordBatch:
    if kind == 0 and len(u):
        both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
        u, v = both[:, 0], both[:, 1]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(u)), pa.array(np.ascontiguousarray(v)),
         pa.array(np.full(len(u), kind, dtype=np.int32))], ["u", "v", "kind"],
    )


def _first_pairs(rows: DataFrame, similarity: float, plain: int) -> DataFrame:
    """Candidate pairs (kind 0), and the shingles of groups of over ``plain`` sets (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, size, node, at in _groups(batches):
            edge = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            count = np.diff(np.append(edge, len(w)))
            large = np.repeat(count > plain, count)
            us, vs = [], []
            few = np.repeat((count > 1) & (count <= plain), count)
            cols = [c[few] for c in (w, size, node, at)]
            for d in range(1, min(plain, len(cols[0]))):
                a, b = [c[:-d] for c in cols], [c[d:] for c in cols]
                same = a[0] == b[0]
                if not same.any():
                    break
                near = same & _may_match(a[1], a[3], b[1], b[3], similarity)
                us.append(a[2][near])
                vs.append(b[2][near])
            if us:
                yield _pairs_out(np.concatenate(us), np.concatenate(vs), 0)
            if large.any():
                yield _pairs_out(w[edge[count > plain]], count[count > plain], 1)
            for lo, n in zip(edge[count > plain], count[count > plain]):
                s, x, p = size[lo : lo + n], node[lo : lo + n], at[lo : lo + n]
                for c in np.argsort(_mix(x.view(np.uint64)))[:CENTRES]:
                    near = _may_match(s, p, s[c], p[c], similarity)
                    near[c] = False
                    yield _pairs_out(np.full(int(near.sum()), x[c]), x[near], 0)

    return _grouped(rows.select("w", "size", "node", "at")).mapInArrow(run, "u long, v long, kind int")


def _later_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs of different classes in the large groups; ``rows`` has their ``root`` too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, size, node, at, root in _groups(batches):
            edge = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            for lo, hi in zip(edge, np.append(edge[1:], len(w))):
                s, x, p, r = (c[lo:hi] for c in (size, node, at, root))
                values, inverse, n = np.unique(r, return_inverse=True, return_counts=True)
                rest = np.flatnonzero(inverse != np.argmax(n))
                us, vs, held = [], [], 0
                for i in rest:
                    near = (r != r[i]) & _may_match(s, p, s[i], p[i], similarity)
                    us.append(np.full(int(near.sum()), x[i]))
                    vs.append(x[near])
                    held += len(vs[-1])
                    if held > _MANY:
                        yield _pairs_out(np.concatenate(us), np.concatenate(vs), 0)
                        us, vs, held = [], [], 0
                if held:
                    yield _pairs_out(np.concatenate(us), np.concatenate(vs), 0)

    return _grouped(rows.select("w", "size", "node", "at", "root")).mapInArrow(
        run, "u long, v long, kind int"
    )


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("w").sortWithinPartitions("w", "size", "node")


def _similar(pairs: DataFrame, rows: DataFrame, least: DataFrame, words: int, similarity: float
             ) -> DataFrame:
    """Those of the pairs whose whole sets are similar enough.

    A pair's sets come from the texts of their smallest doc_ids. A bit table keeps most other
    texts from being cut again; what it lets through besides is dropped by the join.
    """
    pairs = stage(_plausible(pairs, least, similarity), "plausible")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    named = stage(least.join(nodes, "node", "left_semi").select("node", "least"), "named")
    table = key_table(named, "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_table(table.value, batch.column(1).to_numpy())))
            ids = batch.column(0)
            for i, codes in _sets(batch.column(2).to_pylist(), words):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, 1), pa.array([_node(codes)], pa.int64()),
                     pa.array([_signed(codes)], pa.list_(pa.int64()))], ["doc_id", "node", "codes"],
                )

    cut = rows.select("doc_id", key_place("doc_id").alias("place"), "text").mapInArrow(
        run, "doc_id long, node long, codes array<long>")
    # rows that repeat an id may hold another text, and the same one more than once
    sets = stage(
        cut.join(named, "node").filter("doc_id = least").select("node", "codes").dropDuplicates(["node"]),
        "sets",
    )
    side = lambda name: sets.select(F.col("node").alias(name), F.col("codes").alias(f"{name}_codes"))
    both = F.size(F.array_intersect("u_codes", "v_codes"))
    every = F.size("u_codes") + F.size("v_codes") - both
    return pairs.join(side("u"), "u").join(side("v"), "v").filter(
        both >= similarity * every - 1e-9).select("u", "v")


def near_duplicates(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY,
                    plain: int = PLAIN, sample: int = SAMPLE) -> DataFrame:
    """``doc_id`` and ``component_id`` for every row that has a doc_id.

    ``component_id`` is the smallest doc_id reachable over pairs of similarity ``similarity``
    or more. Texts without words form one class, null texts included. Rows may repeat.
    """
    rows = texts(docs).filter(F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("text").cast("binary").alias("text"))
    sets = stage(_leading(rows, words, similarity, _common(rows, words, sample)), "leading")
    least = stage(sets.groupBy("node").agg(
        F.min("doc_id").alias("least"), F.max("size").alias("size"), F.max("profile").alias("profile")), "least")
    leads = _kept(sets, least).select("node", "size", F.posexplode("lead").alias("at", "w"))
    first = stage(_first_pairs(leads, similarity, plain), "first")
    pairs = stage(first.filter("kind = 0").select("u", "v").distinct(), "pairs")
    links = stage(_similar(pairs, rows, least, words, similarity), "links")
    roots = components(links)
    large = first.filter("kind = 1").select(F.col("u").alias("w"))
    if not large.isEmpty():
        crowded = leads.join(large, "w", "left_semi").join(roots.withColumnRenamed("root", "_root"),
                                                           "node", "left")
        crowded = crowded.withColumn("root", F.coalesce("_root", "node"))
        more = stage(
            _later_pairs(crowded, similarity).select("u", "v").distinct()
            .join(pairs, ["u", "v"], "left_anti"), "pairs",
        )
        if not more.isEmpty():
            roots = components(links.unionByName(_similar(more, rows, least, words, similarity)))
    joined = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.join(smallest, "root").select("node", "component_id")
    return sets.select("doc_id", "node").join(classes, "node").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class of near copies: that of the smallest doc_id.

    Of rows that repeat that doc_id one stays, whichever. Rows without a doc_id all stay and
    stand for no others. All columns of ``docs`` are kept.
    """
    return one_of_each(docs, near_duplicates(docs, **options))
