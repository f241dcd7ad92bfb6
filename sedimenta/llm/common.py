"""What the operators share: the cluster's shared folder, free column names, Bloom filters."""

from __future__ import annotations

import uuid
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.session import cut, ensure_checkpoint_dir

__all__ = ["Slice", "bloom_positions", "bloom_set", "bloom_size", "bloom_test", "build_filter", "by_slice", "collect_filter", "cut", "filter_tester", "fresh", "opened", "orderable", "quoted", "removed", "row_order", "shuffle_partitions", "slice_column", "slices_for", "split_rows", "written"]


def written(df: DataFrame, *by: str, **options: str) -> str:
    """The path of a Parquet copy of the table in the shared folder, in folders by the columns `by`."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}.parquet"
    df.write.options(**options).parquet(path, partitionBy=list(by) or None)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of `written`."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm, True)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a table of `written`, for Python workers that read parts of it themselves: whatever pyarrow opens
    (local and mounted folders, HDFS, S3, GCS)."""
    return fs.FileSystem.from_uri(quote(path.replace("s3a://", "s3://", 1), safe=":/@")) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these which the table doesn't have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        cand, k = f"__{name}", 0
        while cand.lower() in taken:
            k += 1
            cand = f"__{name}_{k}"
        taken.add(cand.lower())
        out.append(cand)
    return out


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return all(orderable(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return orderable(dtype.elementType)
    return not isinstance(dtype, (T.MapType, T.VariantType, T.NullType))


def row_order(df: DataFrame, first: list[str]) -> list[Column]:
    """A total order of the rows as far as their columns allow: `first`, then the other columns, nulls last."""
    rest = [f.name for f in df.schema.fields if f.name not in first and orderable(f.dataType)]
    return [quoted(c).asc_nulls_last() for c in [*first, *rest]]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# ---------------------------------------------------------------- Bloom filters

PROBES = 5


def bloom_size(items: int, bits_per_item: int = 16) -> int:
    """Bits, a power of two."""
    return 1 << max(10, int(np.ceil(np.log2(max(1, items) * bits_per_item))))


def bloom_positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Positions (PROBES x n) of int64 hashes in a filter of that many bits: double hashing."""
    h = hashes.astype(np.int64).view(np.uint64)
    a = h * np.uint64(0x9E3779B97F4A7C15)
    a ^= a >> np.uint64(29)
    b = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1)
    b ^= (b >> np.uint64(32)) << np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) & np.uint64(bits - 1) for i in range(PROBES)])


def bloom_set(bitmap: np.ndarray, pos: np.ndarray) -> None:
    flat = pos.ravel()
    np.bitwise_or.at(bitmap, (flat >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (flat & np.uint64(7)).astype(np.uint8)))


def bloom_test(bitmap: np.ndarray, pos: np.ndarray) -> np.ndarray:
    got = bitmap[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8) & np.uint8(1)
    return got.all(axis=0)


def slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    """The slice of a hash; the same as `slice_column` in the JVM."""
    return np.mod(hashes.astype(np.int64) >> np.int64(7), np.int64(slices))


def slice_column(h: Column, slices: int) -> Column:
    return F.pmod(F.shiftright(h, 7), F.lit(slices))


def filter_tester(spark: SparkSession, parts: list[tuple[int, bytes]], slices: int):
    """A pandas UDF on an int64 column that tells whether the sliced filter may hold it."""
    by = spark.sparkContext.broadcast({int(k): v for k, v in parts})

    @F.pandas_udf(T.BooleanType())
    def may_hold(h: pd.Series) -> pd.Series:
        values = h.to_numpy(dtype="int64", na_value=0) if h.isna().any() else h.to_numpy(dtype="int64")
        out = np.zeros(len(values), bool)
        where = slice_of(values, slices)
        order = np.argsort(where, kind="stable")
        edges = np.flatnonzero(np.diff(where[order], prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(order)]):
            blob = by.value.get(int(where[order[lo]]))
            if blob:
                bitmap = np.frombuffer(blob, np.uint8)
                rows = order[lo:hi]
                out[rows] = bloom_test(bitmap, bloom_positions(values[rows], len(bitmap) * 8))
        return pd.Series(out & ~h.isna().to_numpy())

    return may_hold


SLICE_ROWS = 1 << 22  # rows of a slice: its task holds a filter of them, not the rows


def slices_for(spark: SparkSession, rows: int) -> int:
    """How many slices a filter of so many rows gets: as many as shuffles have partitions, and more where slices would grow beyond `SLICE_ROWS`."""
    return max(shuffle_partitions(spark), -(-rows // SLICE_ROWS))


class Slice:
    """A Bloom filter that is filled batch by batch; `items` is the most that it is made for."""

    def __init__(self, items: int, bits_per_item: int) -> None:
        self.bitmap = np.zeros(bloom_size(items, bits_per_item) // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Adds the hashes; tells which of them the filter may have held before."""
        pos = bloom_positions(hashes, len(self.bitmap) * 8)
        held = bloom_test(self.bitmap, pos)
        bloom_set(self.bitmap, pos)
        return held


def by_slice(batches, slices: int):
    """(slice, its hashes) of each batch of hashes."""
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        where = slice_of(values, slices)
        order = np.argsort(where, kind="stable")
        edges = np.flatnonzero(np.diff(where[order], prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(order)]):
            yield int(where[order[lo]]), values[order[lo:hi]]


def slice_rows(held: dict[int, Slice]):
    for k, part in held.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "bits": pa.array([part.bitmap.tobytes()], pa.binary())})


def build_filter(hashes: DataFrame, slices: int, rows: int, bits_per_item: int = 12) -> DataFrame:
    """A Bloom filter of the int64 column `h` of `hashes` (of so many rows), in slices (slice, bits) of the hash space; the task that owns a
    slice fills it batch by batch."""
    each = int(1.1 * rows / slices) + 1000

    def build(batches):
        held: dict[int, Slice] = {}
        for k, part in by_slice(batches, slices):
            held.setdefault(k, Slice(each, bits_per_item)).add(part)
        yield from slice_rows(held)

    return hashes.select("h").repartition(slices, slice_column(F.col("h"), slices)).mapInArrow(build, "slice int, bits binary")


def collect_filter(parts: DataFrame, max_mb: float) -> list[tuple[int, bytes]] | None:
    """The slices on the driver, or None where together they exceed `max_mb`."""
    parts = cut(parts)
    total = parts.agg(F.sum(F.length("bits"))).first()[0] or 0
    return None if total > max_mb * 1e6 else [(r[0], bytes(r[1])) for r in parts.collect()]


def split_rows(df: DataFrame, keys: list[Column], wanted: DataFrame, max_filter_mb: float = 128) -> tuple[DataFrame | None, DataFrame]:
    """(passed, held): the rows of `df` whose keys surely aren't among the rows of `wanted` (a table that is cheap to read twice, with as many
    columns), and the others. A Bloom filter of the keys tells them apart where the rows lie; beyond `max_filter_mb` passed is None and held is `df`."""
    spark, rows = df.sparkSession, wanted.count()
    if not rows:
        return df, df.limit(0)
    slices = slices_for(spark, rows)
    parts = collect_filter(build_filter(wanted.select(F.xxhash64(*wanted.columns).alias("h")), slices, rows), max_filter_mb)
    if parts is None:
        return None, df
    hit = fresh(df, "hit")[0]
    tagged = df.withColumn(hit, F.coalesce(filter_tester(spark, parts, slices)(F.xxhash64(*keys)), F.lit(False)))
    return tagged.filter(~F.col(hit)).drop(hit), tagged.filter(F.col(hit)).drop(hit)
