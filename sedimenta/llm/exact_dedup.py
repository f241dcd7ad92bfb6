"""Exact deduplication in two Bloom passes.

Pass one sends only 64-bit text hashes to the slice that owns them; the number of slices follows the number of rows. A slice
fills a first-seen Bloom filter batch by batch; a hash that the filter already holds may be repeated and enters the slice's second filter.
Pass two tests every row against the second filters: rows that they don't hold are the only ones with
their text and stay where they are, the rest shuffle and are compared by their whole text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import Slice, by_slice, collect_filter, filter_tester, fresh, orderable, quoted, slice_column, slice_rows, slices_for


class Repeats:
    """A first-seen filter and the hashes that it already held when they came, or that came twice in one batch."""

    def __init__(self, items: int, bits_per_item: int) -> None:
        self.seen, self.found, self.held = Slice(items, bits_per_item), [], 0

    def add(self, hashes: np.ndarray) -> None:
        part, counts = np.unique(hashes, return_counts=True)
        again = part[self.seen.add(part) | (counts > 1)]
        self.found.append(again)
        self.held += len(again)
        if self.held > 1 << 20:
            self.found = [self.all()]
            self.held = 0

    def all(self) -> np.ndarray:
        return np.unique(np.concatenate(self.found)) if self.found else np.zeros(0, np.int64)


def maybe_repeated_filter(hashes: DataFrame, slices: int, rows: int, bits_per_item: int = 16) -> DataFrame:
    """Slices (slice, bits) of a filter of the hashes `h` (of so many rows) that may occur more than once."""
    each = int(1.1 * rows / slices) + 1000

    def build(batches):
        held: dict[int, Repeats] = {}
        for k, part in by_slice(batches, slices):
            held.setdefault(k, Repeats(each, bits_per_item)).add(part)
        filters = {}
        for k in list(held):
            again = held.pop(k).all()
            if len(again):
                filters[k] = Slice(len(again), bits_per_item)
                filters[k].add(again)
        yield from slice_rows(filters)

    return hashes.repartition(slices, slice_column(F.col("h"), slices)).mapInArrow(build, "slice int, bits binary")


def exact_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", bits_per_item: int = 16, max_filter_mb: float = 128) -> DataFrame:
    """One row of every set of rows with the same text, all columns unchanged.

    Of rows with one text the one with the smallest `id_col` stays (null ids last; ties go by the other
    columns, so equal rows leave one). Texts compare byte by byte over their whole length, however long: case and
    white space count. A null text equals no other, so such rows all stay; the empty text is a text like any. An empty table gives an empty
    table. Helper columns take names that the table doesn't have. `max_filter_mb` bounds the broadcast filter;
    beyond it every row takes the path of the rows that the filter holds.
    """
    spark, text = df.sparkSession, quoted(text_col)
    rows = df.count()
    slices = slices_for(spark, rows)
    hashes = df.filter(text.isNotNull()).select(F.xxhash64(text).alias("h"))
    parts = collect_filter(maybe_repeated_filter(hashes, slices, rows, bits_per_item), max_filter_mb)
    if parts is None:
        return df.filter(text.isNull()).unionByName(_smallest(df.filter(text.isNotNull()), text_col, id_col))
    if not parts:
        return df
    hit = fresh(df, "hit")[0]
    tagged = df.withColumn(hit, text.isNotNull() & filter_tester(spark, parts, slices)(F.xxhash64(text)))
    passed = tagged.filter(~F.col(hit)).drop(hit)
    return passed.unionByName(_smallest(tagged.filter(F.col(hit)).drop(hit), text_col, id_col))


def _smallest(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """The first row of each text. It is an aggregate, not a window: copies meet on their own side first,
    so a text with millions of copies moves once per task."""
    row = fresh(df, "row")[0]
    best = F.min_by(F.struct(*[quoted(c) for c in df.columns]), F.struct(*_ordering(df, text_col, id_col)))
    out = df.groupBy(quoted(text_col).alias("text_key")).agg(best.alias(row))
    return out.select(*[F.col(row)[c].alias(c) for c in df.columns])


def _ordering(df: DataFrame, text_col: str, id_col: str):
    """Struct fields that order rows ascending with nulls last."""
    names = [id_col, *[f.name for f in df.schema.fields if f.name not in (id_col, text_col) and orderable(f.dataType)]]
    for k, name in enumerate(names):
        yield quoted(name).isNull().alias(f"n{k}")
        yield quoted(name).alias(f"v{k}")
