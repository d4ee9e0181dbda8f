"""The text operators as queries over the test tables, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from acuity.llm import (
    decontam, licenses, merkle, pii, quality, secrets, sentencepiece_bpe, simhash, substrings, topk,
    toxicity, urls, variants,
)
from acuity.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op1_pii(spark, folder):
    return pii.pii_digests(read(spark, folder, "documents"))


@query
def op2_sentencepiece(spark, folder):
    return sentencepiece_bpe.token_digests(read(spark, folder, "documents"))


@query
def op3_secrets(spark, folder):
    return secrets.secret_digests(read(spark, folder, "documents"))


@query
def op4_substrings(spark, folder):
    return substrings.repeat_digests(read(spark, folder, "documents"))


@query
def op5_decontamination(spark, folder):
    return decontam.find_leaks(
        read(spark, folder, "documents"), read(spark, folder, "benchmark")
    )


@query
def op6_topk(spark, folder):
    return topk.top_k(read(spark, folder, "embeddings"))


ORACLE["op6_topk"] = topk.oracle()


@query
def op7_toxicity(spark, folder):
    docs = read(spark, folder, "documents")
    return toxicity.grade_texts(docs, toxicity.train(docs, read(spark, folder, "labels")))


@query
def op8_urls(spark, folder):
    return urls.judge(read(spark, folder, "pages"))


@query
def op9_simhash(spark, folder):
    return simhash.near_duplicates(read(spark, folder, "documents"))


@query
def op10_licenses(spark, folder):
    return licenses.license_rows(read(spark, folder, "documents"))


ORACLE["op10_licenses"] = licenses.oracle()


@query
def op11_merkle(spark, folder):
    return merkle.proofs(read(spark, folder, "documents"))


ORACLE["op11_merkle"] = merkle.oracle()


@query
def op12_quality(spark, folder):
    docs = read(spark, folder, "documents")
    return quality.score_texts(docs, quality.train(docs, read(spark, folder, "labels")))


@query
def op13_variants(spark, folder):
    return variants.group_variants(read(spark, folder, "documents"))


ORACLE["op13_variants"] = variants.oracle()
