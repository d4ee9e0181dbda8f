"""Exact top-k by inner product over a pivot-distance index.

Vectors x get one more coordinate that lifts them to the same length M; queries get zero
there. Then the largest inner product belongs to the nearest vector, and the triangle
inequality holds: |d(q, p) - d(x, p)| <= d(q, x) for every pivot p.

The index keys every vector by its nearest pivot and its distance to it, and packs it in that
order into blocks, each an annulus [lo, hi] around its pivot. Queries go in batches. A batch
first searches the blocks whose annuli are nearest; its k-th best scores then bound what is
left, and only blocks that the bound does not rule out are searched. Batches and blocks meet
in an equi-join on the pivot; blocks split a pivot's vectors, so no pivot is too large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acuity.llm.common import column, stage

PIVOTS, BLOCK, BATCH, FIRST = 64, 1024, 256, 3
_SLACK = 1e-6


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id`` and ``q``, the floors of the scaled components.

    Vectors that are null or empty, or hold null or non-finite components, and rows without
    an id take no part.
    """
    x = column(vectors, "embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.filter(x.isNotNull() & (F.size(x) > 0) & fine).select(
        column(vectors, "vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("q"),
    ).filter(F.col("vec_id").isNotNull())


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, short ones filled up with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def _packed(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m).tobytes()


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, scale: int = 1024,
          pivots: int = PIVOTS, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """The ``k`` best rows for each row whose id is divisible by ``every``.

    ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; ties go to the smaller vec_id, a
    query never finds its own id. Equal rows count once. Vectors of different lengths are
    compared as if filled up with zeros. Scores are exact while they fit a long.
    """
    rows = stage(quantised(vectors, scale).distinct(), "vectors")
    square = F.aggregate("q", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    width, longest, largest = rows.agg(
        F.max(F.size("q")), F.max(square), F.max(F.array_max(F.transform("q", F.abs)))
    ).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if width is None:
        return rows.sparkSession.createDataFrame([], schema)
    exact = longest < 2.0**52  # then sums of products are whole in doubles, in any order
    kind = np.dtype(np.int32 if largest < 2**31 else np.int64)
    # the index's pivots: a bounded sample of distinct vectors
    taken = rows.select("q").distinct().orderBy(F.xxhash64("q"), "q").limit(pivots).collect()
    centre = np.zeros((len(taken), width))
    for i, r in enumerate(taken):
        centre[i, : len(r["q"])] = r["q"]
    rise = np.sqrt(np.maximum(longest - (centre**2).sum(axis=1), 0))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), width).astype(float)
            lift = np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))
            apart = np.sqrt(np.maximum(2 * longest - 2 * (x @ centre.T + lift[:, None] * rise), 0))
            near = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(near.astype(np.int32)),
                 pa.array(apart[np.arange(len(near)), near])], ["vec_id", "q", "pivot", "far"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivot, far = b.column(2).to_numpy(), b.column(3).to_numpy()
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1), width).astype(kind)
            cuts = np.flatnonzero(np.diff(pivot)) + 1
            out = []
            for a, z in zip([0, *cuts], [*cuts, len(pivot)]):  # no step if there are no rows
                for lo in range(a, z, block):
                    hi = min(lo + block, z)
                    out.append((int(pivot[lo]), far[lo], far[hi - 1],
                                _packed(ids[lo:hi]), _packed(x[lo:hi])))
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)],
                ["pivot", "lo", "hi", "ids", "vecs"])

    index = stage(rows.mapInArrow(keyed, "vec_id long, q array<long>, pivot int, far double"), "keyed")
    # equal distances are told apart by id, so that a crowded annulus is cut as well
    table = stage(
        index.repartitionByRange("pivot", "far", "vec_id")
        .sortWithinPartitions("pivot", "far", "vec_id")
        .mapInArrow(blocks, "pivot int, lo double, hi double, ids binary, vecs binary")
        .withColumn("block", F.monotonically_increasing_id()), "blocks")

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1), width)
            for a in range(0, len(ids), batch):
                part = x[a : a + batch].astype(float)
                norm = (part**2).sum(axis=1)
                apart = np.sqrt(np.maximum(norm[:, None] + longest - 2 * part @ centre.T, 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_packed(ids[a : a + batch])]),
                     pa.array([_packed(x[a : a + batch].astype(kind))]),
                     pa.array([apart.min(axis=0)]), pa.array([apart.max(axis=0)]),
                     pa.array([_packed(apart)]), pa.array([norm.max()])],
                    ["qids", "qvecs", "near", "wide", "apart", "norm"])

    queries = index.filter(F.col("vec_id") % every == 0)
    groups = stage(
        queries.repartitionByRange("pivot", "far", "vec_id")
        .sortWithinPartitions("pivot", "far", "vec_id").select("vec_id", "q")
        .mapInArrow(batched, "qids binary, qvecs binary, near array<double>, wide array<double>, "
                             "apart binary, norm double")
        .withColumn("group", F.monotonically_increasing_id()), "queries")

    # every batch against every annulus, by pivot: one small row a pair
    spans = groups.select("group", "norm", F.posexplode(F.arrays_zip("near", "wide"))
                          .alias("pivot", "d"))
    gap = F.greatest(F.lit(0.0), F.col("lo") - F.col("d.wide"), F.col("d.near") - F.col("hi"))
    pairs = spans.join(table.select("block", "pivot", "lo", "hi"), "pivot").select(
        "group", "block", "norm", (gap - _SLACK * (1 + F.sqrt(F.lit(longest)))).alias("gap"))
    ranked = stage(pairs.withColumn(
        "turn", F.row_number().over(Window.partitionBy("group").orderBy("gap", "block"))), "pairs")

    def search(chosen: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    qids = np.frombuffer(row["qids"], np.int64)
                    ids = np.frombuffer(row["ids"], np.int64)
                    q = np.frombuffer(row["qvecs"], kind).reshape(-1, width)
                    x = np.frombuffer(row["vecs"], kind).reshape(-1, width)
                    if row["worst"] is not None:  # single queries that the bound rules out
                        d = np.frombuffer(row["apart"]).reshape(len(qids), -1)[:, row["pivot"]]
                        least = np.maximum(0, np.maximum(row["lo"] - d, d - row["hi"])
                                           - _SLACK * (1 + np.sqrt(longest)))
                        best = ((q.astype(float) ** 2).sum(axis=1) + longest - least**2) / 2
                        go = best >= row["worst"]
                        qids, q = qids[go], q[go]
                        if not len(qids):
                            continue
                    if exact:
                        score = (q.astype(float) @ x.T.astype(float)).astype(np.int64)
                    else:
                        score = q.astype(np.int64) @ x.T.astype(np.int64)
                    own = qids[:, None] == ids[None, :]
                    out = []
                    for i in range(len(qids)):
                        order = np.lexsort((ids, -score[i]))
                        order = order[~own[i][order]][:k]
                        out.append((np.full(len(order), qids[i]), ids[order], score[i][order]))
                    cols = [np.concatenate(c) for c in zip(*out)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(cols[0]), row["group"])), *map(pa.array, cols)],
                        ["group", "query_id", "vec_id", "score"])

        joined = chosen.join(groups.select("group", "qids", "qvecs", "apart"), "group").join(
            table.select("block", "pivot", "lo", "hi", "ids", "vecs"), "block")
        return joined.mapInArrow(run, "group long, query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.dropDuplicates(["query_id", "vec_id", "score"]).withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    no_bound = F.lit(None).cast("double").alias("worst")
    first = stage(best(search(ranked.filter(F.col("turn") <= FIRST).select(
        "group", "block", no_bound))), "first")
    # the worst k-th score of a batch; none where a query has found fewer than k
    found = first.groupBy("group", "query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
    worst = found.groupBy("group").agg(
        F.when(F.min("n") >= k, F.min("s")).cast("double").alias("worst"))
    rest = ranked.filter(F.col("turn") > FIRST).join(worst, "group", "left").filter(
        F.col("worst").isNull()
        | ((F.col("norm") + longest - F.pow(F.greatest("gap", F.lit(0.0)), 2)) / 2 >= F.col("worst"))
    ).select("group", "block", "worst")
    both = first.drop("rank").unionByName(search(rest))
    return best(both).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle(k: int = 10, every: int = 100, scale: int = 1024) -> str:
    return f"""
      WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS q
                 FROM embeddings
                 WHERE vec_id IS NOT NULL AND len(embedding) > 0
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT a.vec_id AS query_id, b.vec_id,
                   cast(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
            FROM s)
      SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""
