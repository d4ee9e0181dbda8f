"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of ``docs``; each result is written as Parquet in the session's
shared folder and read again. Toxic documents, all but one of each near-duplicate class, and
documents that contain a benchmark item go; secrets are masked, with their documents kept;
what is left becomes token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acuity.llm import decontam, jaccard, secrets, sentencepiece_bpe, simhash, toxicity
from acuity.llm.common import bounded_batches, read, stage

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that come first in their class, both by fingerprints and by whole sets.

    The classes by fingerprints are those of ``op9_simhash``: links of three bits or fewer. An
    exact search by the similarity of five-word shingles follows, as a similarity of 0.8 is some
    ten of 64 bits apart, where blocks no longer part the pairs from chance. Both see all rows
    of ``docs``. A row that goes has one of a smaller doc_id in a class of its own, and the
    smallest of all that are tied together stays.
    """
    bounded_batches(spark)
    first = stage(simhash.representatives(simhash.near_duplicates(docs)), "first")
    classes = jaccard.near_duplicates(docs)
    # about as many ids as documents: never a broadcast, however few they are
    return simhash.one_of_each(docs, classes.join(first.hint("merge"), "doc_id", "left_semi"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return decontam.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return secrets.mask_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids``, and ``lossless``, the outcome of decoding them again."""
    bounded_batches(spark)
    return sentencepiece_bpe.encode_checked(docs).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", mask_secrets),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.split()[0])
    return docs


#: Trained weights, components and merges have no SQL form. ``tests/llm`` holds the stages against
#: brute force or planted cases.
ORACLE_SQL = None
