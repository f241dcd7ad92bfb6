"""Best-fit packing of documents into fixed-size bins, planned on the histogram of sizes.

There are at most `capacity` distinct sizes however many documents there are, so the packing is planned
on (size, count) and then carried out by rank: piece number r of size s goes where the plan puts the r-th
piece of size s. The plan pairs the large pieces (above a third of the capacity; two of them at most fit a
bin) by greedy matching, the largest with the largest partner that still fits, and then best-fits the smaller
ones, largest first, into the tightest gap.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm.common import cut, quoted

GROUP_ROWS = 1 << 18  # documents of one size, or with full pieces, that one group numbers


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Rows (size, first rank, end rank, first bin, pieces a bin, offset in the bin) and the number of bins.
    Pieces first..end-1 of a size fill the bins from the first on, so many each, side by side from the offset."""
    left = {int(s): int(c) for s, c in zip(sizes, counts) if s > 0 and c > 0}
    used: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of bins (first, how many)
    bins = 0

    def place(size: int, n_bins: int, first_bin: int, each: int, offset: int) -> None:
        rows.append((size, used[size], used[size] + n_bins * each, first_bin, each, offset))
        used[size] += n_bins * each
        left[size] -= n_bins * each

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    top = np.array(large[::-1], np.int64)  # ascending, for the search of partners
    for size in large:
        while left[size]:
            k = int(np.searchsorted(top, min(capacity - size, size), side="right")) - 1
            while k >= 0 and not left[int(top[k])]:
                k -= 1
            mate = int(top[k]) if k >= 0 else 0
            if mate == size:
                n = left[size] // 2
                if n:
                    place(size, n, bins, 2, 0)
                    gaps[capacity - 2 * size].append((bins, n))
                    bins += n
                    continue
                k -= 1
                while k >= 0 and not left[int(top[k])]:
                    k -= 1
                mate = int(top[k]) if k >= 0 else 0
            n = min(left[size], left[mate]) if mate else left[size]
            place(size, n, bins, 1, 0)
            if mate:
                place(mate, n, bins, 1, size)
            gaps[capacity - size - mate].append((bins, n))
            bins += n

    for size in sorted((s for s in left if left[s] and 3 * s <= capacity), reverse=True):
        ready = sorted(g for g in gaps if g >= size and gaps[g])
        for gap in ready:
            runs, gaps[gap] = gaps[gap], []
            while runs and left[size]:
                first, n = runs.pop(0)
                each = gap // size
                full = min(n, left[size] // each)
                if full:
                    place(size, full, first, each, capacity - gap)
                    gaps[gap - each * size].append((first, full))
                    first, n = first + full, n - full
                if n and left[size]:  # fewer than a bin takes
                    some = left[size]
                    place(size, 1, first, some, capacity - gap)
                    gaps[gap - some * size].append((first, 1))
                    first, n = first + 1, n - 1
                if n:
                    runs.insert(0, (first, n))
            gaps[gap] += runs
            if not left[size]:
                break
        if left[size]:
            each = capacity // size
            full, rest = divmod(left[size], each)
            if full:
                place(size, full, bins, each, 0)
                gaps[capacity - each * size].append((bins, full))
                bins += full
            if rest:
                place(size, 1, bins, rest, 0)
                gaps[capacity - rest * size].append((bins, 1))
                bins += 1
    return np.array(rows, np.int64).reshape(-1, 6), bins


def pack(df: DataFrame, capacity: int = 8192, text_col: str = "text", id_col: str = "doc_id", size_col: str | None = None) -> DataFrame:
    """(bin_id, bin_offset, doc_id, piece, start, length): which part of which document lies where in which bin.

    A document's size is its number of characters, or `size_col` (tokens, say). A document longer than the
    capacity is cut into full pieces, each a bin of its own, and a rest that is packed like a document. Bins are
    numbered from 0 without holes; the parts of a bin don't overlap. A document without text (null, empty, size null
    or not positive) takes no room and gets no row. Rows that repeat are packed as often as they occur; a null id is
    packed and stays null. Within one size, pieces are ordered by a hash group of id and size, the id and the piece, so ties between
    equal rows change nothing but their own places. An empty table gives an empty table; other columns aren't read.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = df.sparkSession
    size = quoted(size_col).cast("bigint") if size_col else F.length(quoted(text_col)).cast("bigint")
    docs = df.select(quoted(id_col).cast("bigint").alias("doc_id"), size.alias("size")).filter(F.col("size") > 0)
    cap = F.lit(capacity).cast("bigint")
    docs = docs.select("doc_id", "size", F.floor(F.col("size") / cap).cast("bigint").alias("full"), (F.col("size") % cap).alias("rest"))
    docs = cut(docs)  # four numbers a document: the texts are read once

    # how many documents there are of each rest and with full pieces (size 0 here), at most `capacity` rows; as many groups number them as they need
    rests = docs.filter(F.col("rest") > 0).groupBy(F.col("rest").alias("s")).agg(F.count("*").alias("n"))
    sizes = rests.unionByName(docs.filter(F.col("full") > 0).agg(F.lit(0).cast("bigint").alias("s"), F.count("*").alias("n"))).toPandas().sort_values("s", ignore_index=True)
    groups = np.zeros(capacity, np.int64)
    groups[sizes["s"].to_numpy(np.int64)] = -(-sizes["n"].to_numpy(np.int64) // GROUP_ROWS)
    base = np.concatenate([[0], np.cumsum(groups)])  # the groups of all sizes, one after another
    of_size = F.broadcast(spark.createDataFrame([(int(k), int(groups[k]), int(base[k])) for k in np.flatnonzero(groups)], "s bigint, groups bigint, base bigint"))
    grouped = lambda part, s: part.join(of_size, s == F.col("s")).withColumn("spread", F.col("base") + F.pmod(F.xxhash64("doc_id", "size"), "groups")).drop("s", "groups", "base")
    rest_rows, full_rows = grouped(docs.filter(F.col("rest") > 0), F.col("rest")), grouped(docs.filter(F.col("full") > 0), F.lit(0).cast("bigint"))

    hist = rest_rows.groupBy("spread").agg(F.count("*").alias("n")).unionByName(full_rows.groupBy("spread").agg(F.sum("full").alias("n"))).toPandas()
    held = np.zeros(int(base[-1]), np.int64)
    held[hist["spread"].to_numpy(np.int64)] = hist["n"].to_numpy(np.int64)
    start = np.cumsum(held) - held
    start -= np.repeat(start[np.minimum(base[:-1], max(0, len(held) - 1))] if len(held) else np.zeros(capacity, np.int64), groups)  # within each size
    total = sizes[sizes["s"] > 0]
    rows, bins = plan(total["s"].to_numpy(), total["n"].to_numpy(), capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    start[: groups[0]] += bins
    shared = spark.sparkContext.broadcast((rows, start))

    @F.pandas_udf(T.StructType([T.StructField("bin_id", T.LongType()), T.StructField("bin_offset", T.LongType())]))
    def place(size: pd.Series, spread: pd.Series, number: pd.Series) -> pd.DataFrame:
        table, first = shared.value
        s, n = size.to_numpy(np.int64), number.to_numpy(np.int64) - 1
        rank = first[spread.to_numpy(np.int64)] + n
        bin_id, offset = rank.copy(), np.zeros(len(s), np.int64)  # full pieces: size 0, their rank is their bin
        few = np.flatnonzero(s > 0)
        if len(few):
            top = int(table[:, 2].max()) + 1
            if top * capacity < 2**62:
                k = np.searchsorted(table[:, 0] * top + table[:, 1], s[few] * top + rank[few], side="right") - 1
            else:
                k = np.array([np.searchsorted(table[:, 1][(lo := np.searchsorted(table[:, 0], a)) : (hi := np.searchsorted(table[:, 0], a, "right"))], b, "right") - 1 + lo for a, b in zip(s[few], rank[few])])
            t = table[k]
            nth = rank[few] - t[:, 1]
            bin_id[few] = t[:, 3] + nth // t[:, 4]
            offset[few] = t[:, 5] + nth % t[:, 4] * s[few]
        return pd.DataFrame({"bin_id": bin_id, "bin_offset": offset})

    # rests: numbered within the group; full pieces: numbered within the group by running sums
    by_size = Window.partitionBy("spread").orderBy(F.col("doc_id").asc_nulls_last(), "size")
    packed = (
        rest_rows.withColumn("number", F.row_number().over(by_size).cast("bigint"))
        .withColumn("at", place(F.col("rest"), F.col("spread"), F.col("number")))
        .select("at.bin_id", "at.bin_offset", "doc_id", F.col("full").alias("piece"), (F.col("full") * cap).alias("start"), F.col("rest").alias("length"))
    )
    running = Window.partitionBy("spread").orderBy(F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    alone = (
        full_rows.withColumn("number", F.coalesce(F.sum("full").over(running), F.lit(0)) + 1)
        .select("doc_id", "spread", "number", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"))
        .withColumn("at", place(F.lit(0).cast("bigint"), F.col("spread"), F.col("number") + F.col("piece")))
        .select("at.bin_id", "at.bin_offset", "doc_id", "piece", (F.col("piece") * cap).alias("start"), cap.alias("length"))
    )
    return packed.unionByName(alone)
