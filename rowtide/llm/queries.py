"""The registered queries of this package and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.bpe import round_trip
from rowtide.llm.common import documents, embeddings, pages
from rowtide.llm.exact_dedup import exact_groups
from rowtide.llm.html_extract import extract_main_text
from rowtide.llm.language_id import identify_pages
from rowtide.llm.line_dedup import MIN_SITES, remove_spread_lines
from rowtide.llm.merkle import manifest
from rowtide.llm.merkle_sql import MERKLE_SQL
from rowtide.llm.mixture import pack_mixture
from rowtide.llm.packing import pack_documents
from rowtide.llm.sharding import shuffle_into_shards
from rowtide.llm.simhash import simhash_components
from rowtide.llm.transducer import count_tokens
from rowtide.llm.whitening import whiten
from rowtide.llm.winnowing import edited_fingerprints


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_spread_lines(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_into_shards(documents(spark, sf_dir)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(pages(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(pages(spark, sf_dir), documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(embeddings(spark, sf_dir))


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the ids themselves are the operator's; the query returns their checksums
    return pack_mixture(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_winnowing": op4_winnowing,
    "op5_sharding": op5_sharding,
    "op6_simhash": op6_simhash,
    "op7_html_extract": op7_html_extract,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_merkle": op11_merkle,
    "op12_whitening": op12_whitening,
    "op13_mixture_packing": op13_mixture_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": f"""
        WITH split AS (
            SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), line AS (
            SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
        ), shared AS (
            SELECT trim(line) AS line FROM line WHERE trim(line) <> ''
            GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
        ), kept AS (
            SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n
            FROM line WHERE trim(line) NOT IN (SELECT line FROM shared) GROUP BY 1
        )
        SELECT doc_id, coalesce(kept.text, '') AS text, CAST(len(lines) AS BIGINT) AS n_lines,
               CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_removed
        FROM split LEFT JOIN kept USING (doc_id)""",
    "op3_exact_dedup": """
        WITH base AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM base WINDOW w AS (PARTITION BY t)""",
    "op11_merkle": MERKLE_SQL,
}
