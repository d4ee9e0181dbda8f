"""The Merkle manifest against a tree built by hand."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from acuity.llm import merkle

SCHEMA = "place long, doc_id long, text string, lang string, source string, n_chars long, tree string, node int"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text) -> str:
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return digest(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree: list[list[str]], at: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for nodes in tree[:-1]:
        run = at // 8 * 8
        out.append((nodes[run:at], nodes[at + 1 : run + 8]))
        at //= 8
    return out


def by_hand(rows) -> list[tuple]:
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        now = text
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
            now = "".join(c.lower() if c.isascii() else c for c in text)
        groups[lang].append((doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, now)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = levels([r[1] for r in groups[lang]])
    whole = levels([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, (doc_id, own, now) in enumerate(groups[lang]):
            steps = siblings(trees[lang], i) + siblings(whole, k)
            proof = digest(*(h for a, b in steps for h in a + b))
            for a, b in steps:
                now = digest(*a, now, *b)
            root = whole[-1][0]
            out.append((doc_id, own, trees[lang][-1][0], root, proof, now, now == root))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(0, i, t, la, s, n, "x", 1) for i, t, la, s, n in rows], SCHEMA)


def compare(spark, rows):
    key = lambda r: tuple((v is not None, v) for v in r)
    got = [tuple(r) for r in merkle.proofs(frame(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(by_hand(rows), key=key)


def test_manifest_over_several_blocks(spark):
    rng = np.random.default_rng(3)
    ids = rng.permutation(9_000).tolist()
    langs = ["en"] * 4 + ["de", "fr", "zz", "Ä"]
    compare(spark, [(i, f"Text {i} Ünd Mehr", langs[i % 8], "s", i) for i in ids] + [(9_999, "alone", "one", None, 5)])


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "A", "en", "s", 1), (None, "A", "en", "s", 1), (None, "B", "en", "s", 1),
            (5, "", "en", "", 0), (5, "", "en", "", 0), (5, "OTHER", "en", "", 0), (5, "x" * 50_000 + "É", "en", "", 0),
            (-1, "a", "en", None, 1), (-64, "b", "en", None, 1), (-65, "c", "en", None, 1), (63, "d", "en", None, 1),
            (2**62, "e", "en", None, 1), (-(2**63), "f", "en", None, 1), (2**63 - 1, "g", "en", None, 1),
            (7, "h", "", "s", 1), (8, "i", "=", "s", 1)]
    compare(spark, rows)
    # rows that repeat an id in numbers beyond a word
    compare(spark, [(6, f"T {i % 90}", "en", "s", 1) for i in range(200)] + [(i, "U", "en", "s", 1) for i in range(20)])


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_manifest_sizes(spark, n):
    compare(spark, [(3 * i, f"T{i}", "en", "s", i) for i in range(n)])


def test_many_languages_and_none(spark):
    compare(spark, [(i, "T", f"l{i % 77}", "s", i) for i in range(100)])
    none = merkle.build(frame(spark, []))
    assert none.root() is None and merkle.prove(none).count() == 0


def test_directory_over_sparse_words(spark):
    rng = np.random.default_rng(5)
    ids = sorted({int(x) for x in rng.integers(-(2**63), 2**63 - 1, 3_000)} | set(range(500)))
    leaves = spark.createDataFrame([("t", i, b"", None) for i in ids], "tree string, doc_id long, leaf binary, changed binary")
    got = {r["doc_id"]: (r["place"], r["n"]) for r in merkle.placed(leaves).collect()}
    assert got == {x: (k, len(ids)) for k, x in enumerate(ids)}
