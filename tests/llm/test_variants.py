"""Spelling variants against comparison of all pairs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from acuity.llm import variants


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_by_hand(rows) -> Counter:
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return Counter({w: n for w, n in out.items() if len(w) >= 5 and n >= 3})


def by_hand(rows) -> set:
    n = words_by_hand(rows)
    form, out = {}, set()
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = (best if best and n[best] >= 2 * n[w] else None, len(near))
    for w in n:
        root = w
        while form[root][0]:
            root = form[root][0]
        out.add((w, form[w][0], root, n[w], form[w][1], n[form[w][0]] if form[w][0] else None))
    return out


def texts_with_variants(seed: int, n: int = 150) -> list[tuple]:
    rng = np.random.default_rng(seed)
    stems = ["".join(rng.choice(list("abÀé"), rng.integers(4, 9))) for _ in range(40)]
    rows = []
    for i in range(n):
        words = []
        for w in rng.choice(stems, 60):
            w, at = str(w), int(rng.integers(0, len(str(w)) + 1))
            words.append([w, w, w.upper(), w[:at] + "x" + w[at:], w[:at] + w[at + 1 :]][rng.integers(5)])
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("crowd", [2, 30, 100_000])
def test_variants_equal_all_pairs(spark, crowd):
    rows = texts_with_variants(crowd) + [(None, "Hello hello hello hallo hallo hallo hellos"), (7, None), (8, ""),
                                         (9, "aaaaa " * 3 + "aaaaaa " * 6 + "aaaaaaa " * 13)] * 2
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, n long")
    got = [tuple(r) for r in variants.group_variants(df, crowd=crowd).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(rows)
    assert any(r[1] and r[1] != r[2] for r in got)  # a chain of forms


def test_variants_of_odd_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group_variants(none).count() == 0
    long = "w" * 40_000
    odd = spark.createDataFrame(
        [(1, f"{long} {long} {long}"), (1, f"{long}x {long}x {long}x"), (2, "ab × ÷÷÷÷÷ ÷÷÷÷÷ ÷÷÷÷÷ 12345"), (3, "日本語日本語 ÿÿÿÿÿ")],
        "doc_id long, text string")
    got = {(r["word"], r["n"], r["n_near"]) for r in variants.group_variants(odd).collect()}
    assert got == {(w, n, sum(one_edit(w, v) for v, _ in words_by_hand(
        [tuple(r) for r in odd.collect()]).items())) for w, n in words_by_hand([tuple(r) for r in odd.collect()]).items()}


def test_common_starts_and_ends():
    left, right, size = variants.matrices(["abcde", "abxde", "bcde", "é" * 3, ""])
    assert size.tolist() == [5, 5, 4, 3, 0]
    ahead = variants.common(left[None], left[None])[0]
    behind = variants.common(right[None], right[None])[0]
    assert ahead[0, 1] == 2 and behind[0, 1] == 2 and ahead[0, 2] == 0 and behind[0, 2] == 4
