"""The corpus pipeline: documents without toxic ones, of good quality, without exact and near copies, packed into bins.

Every stage keeps the columns of its input, whatever their names, up to the last one, which returns places in bins. Null and empty texts pass the
classifiers (nothing in them is toxic or bad); exact dedup keeps every null text and one empty one; near dedup keeps both, and rows without an id; packing gives no
row for texts of no length. Repeated rows leave one at exact dedup. Ties: a toxicity at the limit goes, a quality at the limit stays, of copies the smallest id
stays. Texts count whole, however long; those longer than a bin are cut into pieces. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm.common import removed, written
from sedimenta.llm.exact_dedup import exact_dedup
from sedimenta.llm.near_dedup import near_dedup
from sedimenta.llm.packing import pack
from sedimenta.llm.quality import only_good
from sedimenta.llm.registry import CAPACITY
from sedimenta.llm.toxicity import without_toxic
from sedimenta.session import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: rows that `without_toxic` keeps under the labels of `sf_dir`; null and empty texts stay."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: rows that `only_good` keeps under the labels of `sf_dir`; null, empty and blank texts stay."""
    return only_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: one row of each text, the one with the smallest id; null texts all stay."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: one row of each group of near copies, the one with the smallest id; texts without words and rows without an id stay."""
    return near_dedup(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: where each piece of each text lies in which bin; texts of no length have no row."""
    return pack(docs, CAPACITY)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_bad),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("packing", pack_bins),
]

#: The classifiers, the similarity join and the packing aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of `sf_dir`. What a stage keeps is written to the cluster's shared
    folder, so that no later one works it out again; packing holds numbers only, so at the end those tables go."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir))
        docs = spark.read.parquet(kept)
        if last:
            removed(spark, last)
        last = kept
    packed = STAGES[-1][1](spark, docs, sf_dir)
    removed(spark, last)
    return packed


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
