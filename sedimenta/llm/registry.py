"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm.bpe import encode_decode
from sedimenta.llm.chat import chat_format
from sedimenta.llm.exact_dedup import exact_dedup
from sedimenta.llm.licenses import license_scan
from sedimenta.llm.lm_score import lm_score
from sedimenta.llm.near_dedup import near_dedup
from sedimenta.llm.packing import pack
from sedimenta.llm.quality import quality
from sedimenta.llm.topk import nearest
from sedimenta.llm.toxicity import toxicity
from sedimenta.session import table

CAPACITY = 8192


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), CAPACITY)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_toxicity, op3_near_dedup, op4_licenses, op5_exact_dedup, op6_packing, op7_quality, op8_lm_score, op9_topk, op10_chat)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": """
            SELECT doc_id, text, lang, source, n_chars FROM (
                SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, lang NULLS LAST, source NULLS LAST, n_chars NULLS LAST) AS rn FROM documents)
            WHERE rn = 1 OR text IS NULL""",
        "op9_topk": """
            WITH v AS (SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY vec_id),
            pairs AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_distance(a.v, b.v), 9) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS rank FROM pairs)
            SELECT vec_id, rank::INTEGER AS rank, neighbour_id, distance FROM ranked WHERE rank <= 10""",
    }
