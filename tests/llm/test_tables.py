"""Small parts that several operators rest on."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from acuity.llm import common, jaccard, substrings


@pytest.mark.parametrize("bits", [15, 18, 26])
def test_key_table_never_misses_a_key(spark, bits):
    keys = spark.range(0, 30_000, 3).select(F.col("id").alias("k"))
    table = common.key_table(keys, "k", bits).value
    places = spark.range(30_000).select(common.key_place("id", bits).alias("p")).toPandas()["p"].to_numpy()
    found = common.in_table(table, places)
    assert found[::3].all()
    others = np.delete(found, np.s_[::3]).mean()
    assert others == pytest.approx(1 - np.exp(-10_000 / 2**bits), rel=0.1, abs=0.001)
    assert not common.in_table(common.key_table(keys.limit(0), "k", bits).value, places).any()


def test_whole_groups():
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 40, 500))
    b = np.array([str(x) for x in a])
    for cuts in ([], [1, 2, 3], sorted(rng.integers(0, 500, 60).tolist())):
        bounds = [0, *cuts, 500]
        batches = [pa.RecordBatch.from_arrays([pa.array(a[i:j]), pa.array(b[i:j])], ["a", "b"])
                   for i, j in zip(bounds, bounds[1:])]
        tables = list(common.whole_groups(iter(batches), ["a", "b"]))
        assert np.concatenate([t.column("a").to_numpy() for t in tables]).tolist() == a.tolist()
        seen = [set(t.column("a").to_pylist()) for t in tables]
        assert sum(map(len, seen)) == len(set().union(*seen))  # no group is in two tables


def test_unused_names():
    assert common.unused("_x", ["a", "_X", "__x"]) == "___x" and common.unused("y", []) == "y"


def test_merged_spans():
    rng = np.random.default_rng(2)
    doc, no = rng.integers(0, 4, 200), rng.integers(0, 2, 200)
    start = rng.integers(0, 400, 200)
    stop = start + rng.integers(1, 30, 200)
    marks = {}
    for d, n, a, z in zip(doc, no, start, stop):
        marks.setdefault((d, n), np.zeros(500, bool))[a:z] = True
    got = {}
    for d, n, a, z in zip(*substrings.merged(doc, no, start, stop)):
        part = got.setdefault((d, n), np.zeros(500, bool))
        assert not part[max(0, a - 1) : z + 1].any()  # neither overlap nor touch
        part[a:z] = True
    assert marks.keys() == got.keys() and all((marks[k] == got[k]).all() for k in marks)
    assert all(len(x) == 0 for x in substrings.merged(*(np.zeros(0, np.int64),) * 4))


def test_packed_values():
    for values in (np.arange(1000, dtype=np.uint64), np.zeros(0, np.int32), np.frombuffer(b"abc" * 50, np.uint8)):
        assert np.array_equal(substrings._unpacked(substrings._packed(values), values.dtype), values)


def test_profiles_never_rule_out_similar_sets():
    rng = np.random.default_rng(3)
    for n in (1, 5, 300, 5_000, 400_000):
        codes = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        if n == 400_000:
            codes[:] = codes % np.uint64(2**56)  # all in one part: the number is cut off
        other = np.unique(np.concatenate([codes[: len(codes) * 9 // 10], rng.integers(0, 2**63, n // 20).astype(np.uint64)]))
        a, b = (np.frombuffer(jaccard._profile(c), "<u2").astype(int) for c in (codes, other))
        common_ = len(np.intersect1d(codes, other))
        assert np.minimum(a, b).sum() >= common_ or max(a.max(), b.max()) == jaccard._FULL
