"""Masks of texts with many tokens, and of very long ones."""

from __future__ import annotations

import time

import numpy as np
import pytest

pytest.importorskip("sentencepiece")

from acuity.llm import secrets  # noqa: E402

SIGNS = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
PLAIN = ["the-quick-brown-fox-jumps-over-1", "z" * 31 + "1", "no-digit-in-this-long-identifier"]


def masked(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(docs).collect()}
    seconds = time.perf_counter() - began
    spans = {r["doc_id"]: r["random"] for r in secrets.find_secrets(docs).collect()}
    for i, text in enumerate(texts):
        want, at = "", 0
        for m in spans[i]:
            want, at = want + text[at : m["start"]] + secrets.MASK, m["end"]
        assert got[i] == want + text[at:]
    return [got[i] for i in range(len(texts))], seconds


def test_many_tokens_in_a_text(spark):
    """The work on a text grows with its tokens, not with a power of their number."""
    rng = np.random.default_rng(5)
    masked(spark, ["one " + "".join(rng.choice(SIGNS, 32))])
    words = ["".join(rng.choice(SIGNS, 32)) for _ in range(80)]
    got, seconds = masked(spark, [", ".join([*words, *PLAIN]), "none here"])
    assert got[0].count(secrets.MASK) >= 76 and all(p in got[0] for p in PLAIN)
    assert got[1] == "none here"
    assert seconds < 30


def test_very_long_tokens(spark):
    rng = np.random.default_rng(6)
    random = "".join(rng.choice(SIGNS, 20_000))
    dashed = "-".join(["abc1"] * 5_000)
    got, _ = masked(spark, [f"a {random} b", f"a {dashed} b", f"a {'z1' * 5_000} b"])
    assert got == [f"a {secrets.MASK} b", f"a {dashed} b", f"a {'z1' * 5_000} b"]
