"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import quoted


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int | tuple[int, int], text_col: str = "text", id_col: str = "doc_id", skip: tuple[int, int] = (0, 0)) -> DataFrame:
    """(id, y, text): up to `per_class` labelled documents of each class, those with the smallest hashes of their ids after the first `skip`.
    Labels other than 0 and 1 and null ids don't count; of several labels for one id the largest counts; of several
    rows with one id the one with the smallest text."""
    clean = labels.select(quoted("doc_id").cast("bigint").alias("id"), quoted(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(quoted(id_col).cast("bigint").alias("id"), quoted(text_col).alias("text")).filter("id is not null and text is not null")
    known = texts.select("id").distinct().join(clean, "id")
    limits = (per_class, per_class) if isinstance(per_class, int) else per_class
    picked = None
    for y in (0, 1):
        ordered = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id")
        part = (ordered.offset(skip[y]) if skip[y] else ordered).limit(limits[y])
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 x per_class rows of two numbers: always small enough to broadcast
    return texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
