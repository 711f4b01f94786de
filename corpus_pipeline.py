"""From raw documents to packed training sequences.

``STAGES`` are applied one after the other; each result is written as Parquet and read
again as the next stage's documents. Stages work on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowtide.llm.common import documents
from rowtide.llm.exact_dedup import keep_one
from rowtide.llm.language_id import keep_identified
from rowtide.llm.packing import pack_documents
from rowtide.llm.shingle_pairs import keep_one_of_similar
from rowtide.session import scratch_scope, settle


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one of the largest identifier."""
    return keep_one(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest identifier.

    Near are texts whose five-word shingles overlap by 0.8 or more, counted exactly. SimHash
    fingerprints that differ in up to 6 bits say what to count, by shards of equal blocks and
    vantage-point trees. Such pairs may differ in more bits, which no block or tree narrows
    down: those left are found from there by a prefix filter over the shingles, and all of them.
    """
    return keep_one_of_similar(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which training sequence."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("best_fit_packing", best_fit_packing),
]

# The first, third and last stage are not expressible in SQL; the tests hold a brute force against all.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage has written for itself goes when its result is written.

    A null text is an empty one for every stage. Rows of equal or null identifiers are rows of
    their own, but for exact copies; ties go as each stage says. An empty table gives no rows.
    """
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        with scratch_scope(spark):
            docs = settle(stage(spark, docs, sf_dir), outlive=True)
    return STAGES[-1][1](spark, docs, sf_dir)
