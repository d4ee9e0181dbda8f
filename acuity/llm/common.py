"""Helpers that several of the text operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acuity.sources.storage import stage

__all__ = ["bounded_batches", "components", "column", "in_table", "key_place", "key_table", "prefix_sums", "read", "reserve", "stage", "texts", "unused", "whole_groups"]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


#: Bytes of rows that Spark hands to a Python worker at once. The engine's own bound is 64 MB, which
#: texts fill; both sides of the pipe then hold several times that for every task.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def bounded_batches(spark: SparkSession) -> None:
    """Set the bound for the session; an operator's results are computed after it has returned."""
    spark.conf.set(*BATCH)


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots included."""
    return df[f"`{name}`"]


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one."""
    return docs.select(
        column(docs, id_col).cast("long").alias("doc_id"),
        F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"),
    )


def prefix_sums(lengths: str) -> str:
    """SQL for the sums ahead of each element of an array column of integers.

    Blocks of about the square root of the size keep the work at n to the power 1.5 for
    texts with very many spans, where a plain fold would copy its result at each step.
    """
    block = f"int(ceil(sqrt(size({lengths}))))"
    return f"""
      CASE WHEN size({lengths}) = 0 THEN cast(array() AS array<bigint>) ELSE flatten(transform(
        sequence(0, int(ceil(size({lengths}) / {block})) - 1),
        b -> transform(
          array(aggregate(slice({lengths}, 1, b * {block}), 0L, (a, x) -> a + x)),
          ahead -> transform(
            sequence(1, least({block}, size({lengths}) - b * {block})),
            i -> ahead + aggregate(slice({lengths}, b * {block} + 1, i - 1), 0L, (a, x) -> a + x)
          )
        )[0]
      )) END"""


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: ``node`` and the smallest node it reaches.

    ``edges`` has two long columns ``u`` and ``v``; nodes without an edge are not returned.
    Large-star and small-star rounds, of which the logarithm of the size is enough; minima
    combine before the shuffle, so a hub costs one row per task. Each round is written to
    the shared folder. No link or label passes the driver, only one row of totals per round.
    """
    pairs = stage(
        edges.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = None
    for _ in range(max_rounds):
        state = tuple(pairs.agg(F.count(F.lit(1)), total).first())
        if state[0] == 0 or state == before:
            break
        before = state
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _minima(both).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter(F.col("u") != F.col("v")).distinct()
        )
        large = stage(large, "large")
        small = large.join(_minima(large), "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        ).select("e.*").filter(F.col("u") != F.col("v")).distinct()
        pairs = stage(small, "small")
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def reserve(names: Sequence[str], taken: Sequence[str]) -> None:
    """Refuse output names that clash with columns a caller wants to keep."""
    clash = sorted(set(names) & set(taken))
    if clash:
        raise ValueError(f"columns clash with the operator's own: {clash}")


def unused(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores before it until no column has it, in any case."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches whose rows come in order of their groups.

    Only the last group of a batch is held back until the next one, so a task's memory is
    bounded by the largest group and one batch.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        turn = np.zeros(batch.num_rows, bool)
        for key in keys:
            column_ = batch.column(batch.schema.get_field_index(key))
            if held:
                last = held[-1].column(held[-1].schema.get_field_index(key))
                turn[0] |= bool(pc.not_equal(column_[0], last[len(last) - 1]).as_py())
            turn[1:] |= pc.not_equal(column_[1:], column_[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(turn)
        if len(starts):
            head = [*held, batch.slice(0, int(starts[-1]))]
            if any(b.num_rows for b in head):
                yield pa.Table.from_batches(head)
            held = [batch.slice(int(starts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


#: Bits of a table that tells most rows without a wanted key from the others: 8 MB on each executor.
TABLE_BITS = 26


def key_table(keys: DataFrame, name: str, bits: int = TABLE_BITS) -> Broadcast:
    """A broadcast bit table of the long column ``name``, 2^(bits - 3) bytes whatever its rows.

    Bits are set by tasks and combined before the shuffle; the driver gets at most one bitmap
    of 4 KB for each 32,768 places. No key that is there is ever missed; of the others a share
    passes that grows with the number of keys, and what follows must be right for those too.
    """
    place = key_place(name, bits) + 1  # bitmap buckets start with place 1
    parts = keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("held")).collect()
    table = np.zeros(max(1 << (bits - 3), 4096), np.uint8)
    for row in parts:
        table[(row["part"] - 1) * 4096 : row["part"] * 4096] = np.frombuffer(row["held"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table)


def key_place(name: str, bits: int = TABLE_BITS) -> Column:
    """A key's place in a :func:`key_table`."""
    return F.pmod(F.xxhash64(name), F.lit(1 << bits))


def in_table(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the bits at ``places`` are set."""
    return (table[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0
