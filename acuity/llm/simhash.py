"""SimHash fingerprints, their links within a few bits, and the classes these links form.

Links are found by the pigeonhole principle. A fingerprint is cut into six blocks; two that
differ in at most three bits agree in at least three whole blocks, so they share one of the
twenty keys made of three blocks. Only distinct fingerprints take part, so copies cost
nothing. Keys are counted first:

* one fingerprint has no partner, two are compared where they are counted;
* up to ``PLAIN`` fingerprints meet in one task, which walks the group and writes a spanning
  forest of its links, never all pairs;
* beyond that the key's free bits are cut again into six blocks, twenty keys each. Then no
  more than 2 ** 18 distinct fingerprints can share a key, so a task's memory is bounded
  whatever the data, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acuity.llm.common import components, stage, texts

WORDS, BITS, SEED = 3, 3, 42
PLAIN = 1 << 14


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Fingerprint of one UTF-8 text: a bit is set if over half of the shingle hashes set it."""
    return _fingerprints([text], words, seed)[0]


def _fingerprints(batch: list[bytes | None], words: int, seed: int) -> list[int]:
    out, digest = [], xxhash.xxh64_intdigest
    for text in batch:
        parts = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
        if not parts:
            out.append(0)
            continue
        if len(parts) < words:
            shingles = [b" ".join(parts)]
        else:
            shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
        hashes = np.array([digest(s, seed) for s in shingles], dtype="<u8")
        ones = np.zeros(64, dtype=np.int64)
        for start in range(0, len(hashes), 1 << 16):
            block = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
        out.append(int(bits.view("<u8")[0]))
    return out


def fingerprints(docs: DataFrame, *, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint's 64 bits as a signed long, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _fingerprints(batch.column(1).to_pylist(), words, seed)
            fps = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    source = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def _masks(bits: list[int]) -> list[int]:
    """Masks of the twenty choices of three blocks out of the six that ``bits`` is cut into."""
    cuts = np.array_split(np.array(bits), 6)
    blocks = [sum(1 << int(b) for b in cut) for cut in cuts]
    return [a | b | c for a, b, c in combinations(blocks, 3)]


MASKS = _masks(list(range(64)))
FINER = [_masks([b for b in range(64) if not m >> b & 1]) for m in MASKS]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(fps: DataFrame) -> DataFrame:
    """One row per fingerprint and choice of blocks."""
    choices = F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for i, m in enumerate(MASKS)
    ])
    return fps.select("fp", F.explode(choices).alias("k")).select("k.choice", "k.key", "fp")


def _finer(rows: DataFrame) -> DataFrame:
    """Twenty keys out of the free bits of each row's key."""
    table = F.array(*[F.array(*[F.lit(_signed(m | f)) for f in fs])
                      for m, fs in zip(MASKS, FINER)])
    choice = F.col("choice")
    return rows.select("choice", "fp", F.posexplode(table[choice]).alias("sub", "mask")).select(
        (choice * 20 + F.col("sub") + 20).cast("int").alias("choice"),
        F.col("fp").bitwiseAND(F.col("mask")).alias("key"),
        "fp",
    )


def forest(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links of distinct values within ``bits`` bits.

    Each value is compared once with those not reached so far.
    """
    left, links = values.view(np.uint64), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                reached = left[near]
                links += [(int(at), int(r)) for r in reached]
                frontier += list(reached)
                left = left[~near]
    return links


def _group_links(rows: DataFrame, bits: int) -> DataFrame:
    """Links inside each (choice, key) group; a group is read as one run of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        links: list[tuple[int, int]] = []

        def emit():
            pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            links.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], ["u", "v"]
            )

        for batch in batches:
            choice, keys, fps = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(choice) != 0) | (np.diff(keys) != 0)) + 1
            bounds = [0, *cuts.tolist(), len(fps)]
            for lo, hi in zip(bounds, bounds[1:]):
                if hi == lo:
                    continue
                now = (choice[lo], keys[lo])
                if now != key and held:
                    links += forest(np.concatenate(held), bits)
                    held = []
                key = now
                held.append(fps[lo:hi])
            yield emit()
        if held:
            links += forest(np.concatenate(held), bits)
        yield emit()

    return (
        rows.select("choice", "key", "fp")
        .repartition("choice", "key")
        .sortWithinPartitions("choice", "key", "fp")
        .mapInArrow(run, "u long, v long")
    )


def links(fps: DataFrame, *, bits: int = BITS, plain: int = PLAIN) -> DataFrame:
    """Links ``u``, ``v`` between distinct fingerprints that connect the same classes as all do.

    ``fps`` is a stored table with one column ``fp`` of distinct values.
    """
    keys = _keys(fps)
    sizes = stage(
        keys.groupBy("choice", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
        .filter(F.col("n") > 1),
        "keys",
    )
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits
    out = sizes.filter((F.col("n") == 2) & near).select("u", "v")
    groups = sizes.filter((F.col("n") > 2) & (F.col("n") <= plain)).select("choice", "key")
    out = out.unionByName(_group_links(keys.join(groups, ["choice", "key"], "left_semi"), bits))
    large = sizes.filter(F.col("n") > plain).select("choice", "key")
    if not large.isEmpty():
        finer = _finer(keys.join(large, ["choice", "key"], "left_semi"))
        out = out.unionByName(_group_links(finer, bits))
    return out


def near_duplicates(
    docs: DataFrame, *, words: int = WORDS, bits: int = BITS, seed: int = SEED, plain: int = PLAIN
) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most ``bits`` bits. A
    null or empty text has fingerprint zero and is linked like any other. Rows may repeat;
    a null doc_id is kept and never the smallest, unless a class has no other: then null.
    Columns other than doc_id and text are ignored.
    """
    if bits > 3:
        raise ValueError("blocks are cut for three differing bits at most")
    rows = stage(fingerprints(docs, words=words, seed=seed), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.select("fp"), bits=bits, plain=plain))
    joined = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stage(joined.join(least, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the smallest doc_id.

    Of rows that repeat that doc_id one stays, whichever. Rows without a doc_id cannot be
    told apart by it; they all stay. All columns of ``docs`` are kept.
    """
    return one_of_each(docs, near_duplicates(docs, **options))


def representatives(classes: DataFrame) -> DataFrame:
    """Each doc_id that is the ``component_id`` of one of its rows, once."""
    return classes.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()


def one_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its ``component_id``, one each; those without an id stay."""
    keep = stage(
        classes.filter(F.col("doc_id") == F.col("component_id"))
        .groupBy("doc_id").agg(F.count(F.lit(1)).alias("_copies")), "keep"
    )
    once, more = (keep.filter(f"_copies {test} 1").select("doc_id") for test in ("=", ">"))
    # about as many ids as documents: never a broadcast, however few they are
    out = docs.join(once.hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    if not more.isEmpty():
        again = docs.join(more, "doc_id", "left_semi").select(*docs.columns)
        out = out.unionByName(again.dropDuplicates(["doc_id"]))
    return out.unionByName(docs.filter(F.col("doc_id").isNull()))
