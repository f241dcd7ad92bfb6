"""Near duplicates by a chosen-path set similarity join.

A text is the set of its word 3-grams, seen through `COORDS` minwise tokens; sets with the same tokens are one. In each of several
trees a node chooses one or two coordinates, and every set of the node goes to a child for its minwise token there; the chance of meeting
again is the share of tokens that agree, which estimates the similarity. Given the tokens, the trees choose independently, so their number
follows from the recall wanted. Small nodes are compared exhaustively, large ones branch on; what is still large on the last
level is compared in blocks. Sets that match are linked, and the texts of linked sets form groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import cut, fresh, quoted, row_order, shuffle_partitions, split_rows
from sedimenta.llm.textkit import mix, spans, string_buffers, words

COORDS = 256
SHINGLE = 3
RECALL = 0.95  # of pairs at the threshold, however deep the tree: more alike ones are found more surely
THRESHOLD = 0.55
SMALL = 1000
DEPTH = 8

_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 1 << 32, COORDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, COORDS, dtype=np.uint64).astype(np.uint32)


def trees_for(recall: float, threshold: float, depth: int) -> int:
    """How many trees find a pair that agrees in `threshold` of its tokens with probability `recall`, even if its nodes stay large down to the
    last level. In one tree the pair survives a branching process with 1/threshold children in the mean, each kept with the chance `threshold`."""
    base, miss = int(1 / threshold), 0.0
    for _ in range(depth):
        part = 1 - threshold + threshold * miss
        miss = part**base * (1 - (1 / threshold - base) * (1 - part))
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(miss)))) if miss > 0 else 1


def shingles(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word k-grams of each row and the first index of each row (and the total). A row of
    fewer words than k has one shingle of all its words, a row without words has none."""
    _, _, h, first = words(data, offs)
    n = np.diff(first)
    if not len(h):
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    gram = padded[: len(h)].copy()
    row_end = np.repeat(first[1:], n)
    at = np.arange(len(h))
    for j in range(1, k):
        gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + np.where(at + j < row_end, padded[j : j + len(h)], np.uint64(0)))
    row_start = np.repeat(first[:-1], n)
    keep = (at + k <= row_end) | (at == row_start)
    counts = np.where(n == 0, 0, np.maximum(1, n - k + 1))
    return (gram[keep] >> np.uint64(32)).astype(np.uint32), np.concatenate([[0], np.cumsum(counts)])


def minwise(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The minwise tokens (rows x COORDS); rows without shingles hold the largest value."""
    rows = np.flatnonzero(np.diff(first) > 0)
    out = np.full((len(first) - 1, COORDS), 0xFFFFFFFF, np.uint32)
    if len(rows):
        starts = first[rows]
        for lo, hi in spans(first[np.concatenate([rows, [len(first) - 1]])], 1 << 17):
            part = gram[starts[lo] : (starts[hi] if hi < len(rows) else len(gram))]
            at = starts[lo:hi] - starts[lo]
            for c in range(COORDS):
                out[rows[lo:hi], c] = np.minimum.reduceat(part * _A[c] + _B[c], at)
    return out


def chosen(key: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(rows, coordinate)]: the coordinates that the nodes `key` choose, 1/threshold in the mean."""
    base = int(1 / threshold)
    out = []
    for j in range(base + 1):
        draw = mix(key + np.uint64(0x632BE59BD9B4E019) * np.uint64(j + 1))
        take = np.ones(len(key), bool)
        if j == base:
            take = (draw >> np.uint64(40)).astype(np.float64) / (1 << 24) < 1 / threshold - base
        rows = np.flatnonzero(take)
        out.append((rows, (draw[rows] & np.uint64(0xFFFF)).astype(np.int64) % COORDS))
    return out


def child_key(key: np.ndarray, coord: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + (coord.astype(np.uint64) << np.uint64(32)) + token.astype(np.uint64))


def agreements(threshold: float, coords: int = COORDS) -> float:
    """How many coordinates agree at this similarity: tokens are kept as bytes, so one in 256 others agrees by chance."""
    return coords * (threshold + (1 - threshold) / 256)


def link(sig: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that join all pairs of a node with estimated similarity at least `threshold`, directly or through
    others. Every pair is compared unless earlier links join it already."""
    m = len(sig)
    need = agreements(threshold, sig.shape[1])
    comp = np.arange(m)
    links = []
    for i in range(m - 1):
        others = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
        if not len(others):
            continue
        same = (sig[others] == sig[i]).sum(axis=1)
        found = others[same >= need]
        if len(found):
            comps, at = np.unique(comp[found], return_index=True)
            links += [(i, int(j)) for j in found[at]]
            comp[np.isin(comp, comps)] = comp[i]
    return links


def _sketch_batches(trees: int, threshold: float):
    roots = mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches):
        for batch in batches:
            data, offs = string_buffers(batch.column(1))
            ids = batch.column(0)
            for lo, hi in spans(offs):
                gram, first = shingles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                some = np.flatnonzero(np.diff(first) > 0)
                if not len(some):
                    continue
                mins = minwise(gram, first)[some]
                whole = np.zeros(len(some), np.uint64)
                for c in range(COORDS):
                    whole = mix(whole * np.uint64(31) + mins[:, c].astype(np.uint64) + np.uint64(1))
                keys = []
                for root in roots:
                    for _, coord in chosen(np.array([root]), threshold):
                        for c in coord:
                            keys.append(child_key(np.array([root]), np.array([c]), mins[:, c]))
                keys = np.stack(keys, axis=1)
                flat = (mins & np.uint32(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({
                    "id": ids.slice(lo, hi - lo).take(pa.array(some)),
                    "th": batch.column(2).slice(lo, hi - lo).take(pa.array(some)),
                    "sh": pa.array(whole.view(np.int64)),
                    "sig": pa.array([r.tobytes() for r in flat], pa.binary()),
                    "keys": pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel().view(np.int64))),
                })

    return run


def _branch_batches(threshold: float):
    def run(batches):
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, COORDS)
            for rows, coord in chosen(key, threshold):
                if len(rows):
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_pydict({"key": pa.array(child_key(key[rows], coord, sig[rows, coord]).view(np.int64)), "sh": batch.column(1).take(at), "sig": batch.column(2).take(at)})

    return run


def _compare_batches(threshold: float):
    """Rows (key, sh, sig) sorted by key and sh -> links (a, b)."""

    def nodes(batches):
        held: list = []
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, COORDS)
            if held and held[0][0][0] != key[0]:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held = []
            last = int(np.searchsorted(key, key[-1])) if key[0] != key[-1] else 0
            if last:
                held.append((key[:last], ids[:last], sig[:last]))
                yield tuple(np.concatenate(x) for x in zip(*held))
                held = []
            held.append((key[last:], ids[last:], sig[last:]))
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held))

    def run(batches):
        for key, ids, sig in nodes(batches):
            edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            size = np.diff(edges)
            a, b = [], []
            two = edges[:-1][size == 2]
            for lo in range(0, len(two), 4096):
                at = two[lo : lo + 4096]
                near = at[(sig[at] == sig[at + 1]).sum(axis=1) >= agreements(threshold)]
                a.append(ids[near])
                b.append(ids[near + 1])
            for lo, n in zip(edges[:-1][size > 2], size[size > 2]):
                pairs = link(sig[lo : lo + n], threshold)
                if pairs:
                    x = np.array(pairs) + lo
                    a.append(ids[x[:, 0]])
                    b.append(ids[x[:, 1]])
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return run


def sketches(df: DataFrame, text_col: str, id_col: str, threshold: float, trees: int) -> DataFrame:
    """(id, th, sh, sig, keys) of each row with an id and words: hash of the text, hash of its set's tokens, the tokens as bytes, and the nodes
    of the first level."""
    text = quoted(text_col).cast("string")
    base = df.filter(quoted(id_col).isNotNull() & text.isNotNull()).select(quoted(id_col).cast("bigint").alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    return base.mapInArrow(_sketch_batches(trees, threshold), "id bigint, th bigint, sh bigint, sig binary, keys array<bigint>")


def near_links(sketched: DataFrame, threshold: float = THRESHOLD, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """Links (a, b) between sets `sh`, a < b, that join all found pairs of sets of estimated similarity `threshold` or more."""
    sets = cut(sketched.groupBy("sh").agg(F.min("sig").alias("sig"), F.min("keys").alias("keys")))
    rows = sets.select("sh", F.explode("keys").alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    level = cut(rows.join(counts, "key").join(sets.select("sh", "sig"), "sh").select("key", "sh", "sig", "m"))

    parts = shuffle_partitions(sketched.sparkSession)
    found = []
    for d in range(1, depth + 1):
        ready, more = level.filter(F.col("m") <= small).select("key", "sh", "sig"), level.filter(F.col("m") > small)
        over = more.isEmpty()
        if d == depth and not over:  # blocks of about `small` sets; every pair of blocks is a node
            n, own = F.ceil(F.col("m") / small).cast("bigint"), F.col("own")
            blocks = more.withColumn("own", F.pmod(F.xxhash64("sh", "key"), n)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
            ready = ready.unionByName(blocks.select(F.xxhash64("key", F.least(own, "other"), F.greatest(own, "other")).alias("key"), "sh", "sig"))
        ready = ready.repartition(parts, "key").sortWithinPartitions("key", "sh")
        found.append(ready.mapInArrow(_compare_batches(threshold), "a bigint, b bigint"))
        if over or d == depth:
            break
        grown = more.select("key", "sh", "sig").mapInArrow(_branch_batches(threshold), "key bigint, sh bigint, sig binary").dropDuplicates(["key", "sh"])
        counts = grown.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
        level = cut(grown.join(counts, "key").select("key", "sh", "sig", "m"))
    links = found[0]
    for x in found[1:]:
        links = links.unionByName(x)
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root): every id of the links (a, b) but the roots themselves, with the smallest id of its component.
    Alternating large-star and small-star steps: each shuffles the links, none gathers them."""
    edges = cut(links)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").distinct()
        down = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        joined = large.join(down, F.col("b") == F.col("u"))
        small = joined.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(down.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
        mark = now


def members(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """(id, th, n, keep): every text of a group of more than one row, how often it occurs with its id, and the text (id, th) that stays: the one
    with the smallest id and, of texts with that id, the smallest hash."""
    sketched = cut(sketches(df, text_col, id_col, threshold, trees_for(recall, threshold, depth)))
    roots = components(near_links(sketched, threshold, small, depth)).withColumnRenamed("id", "sh")
    rows = sketched.groupBy("id", "th", "sh").agg(F.count("*").alias("n")).join(roots, "sh", "left").select("id", "th", "n", F.coalesce("root", "sh").alias("c"))
    keep = rows.groupBy("c").agg(F.min(F.struct("id", "th")).alias("keep"), F.sum("n").alias("total")).filter("total > 1").select("c", "keep")
    return cut(rows.join(keep, "c").select("id", "th", "n", "keep"))


def near_groups(df: DataFrame, **how) -> DataFrame:
    """(id, root): the ids of each group of near duplicates but the smallest, and the smallest. An id with several texts may be in several groups."""
    return members(df, **how).filter("id <> keep.id").select("id", F.col("keep.id").alias("root")).distinct()


def near_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, **how) -> DataFrame:
    """One row of each group of near duplicates, all columns unchanged.

    Two texts are near duplicates where the Jaccard similarity of their sets of word 3-grams reaches `threshold`, as estimated on `COORDS` minwise
    tokens of a byte each: the sets themselves aren't compared, so the estimate's standard error is 0.03, and pairs within two of it of the
    threshold may fall on either side. A pair at the threshold is compared with probability `recall` (0.95) at least, whatever the number of documents. ASCII
    case and punctuation don't count, repeated 3-grams count once, texts count whole however long. Groups are connected components, and the row with
    the smallest id stays. Rows that share an id but not the text are texts of their own, each in its own group; where one id has several
    texts in a group the one with the smallest hash stays, and of rows equal in id and text the first by the other columns. A text of one or two words is one
    shingle; a null or empty text, or one without words, is like no other and stays, as does a row without an id. An empty table
    gives an empty table; helper columns take free names.
    """
    grouped = members(df, text_col, id_col, threshold, **how)
    stays = (F.col("id") == F.col("keep.id")) & (F.col("th") == F.col("keep.th"))
    losers, again = grouped.filter(~stays).select("id", "th"), grouped.filter(stays & (F.col("n") > 1)).select("id", "th")
    keys = [quoted(id_col).cast("bigint"), F.xxhash64(quoted(text_col).cast("string"))]

    def among(rows: DataFrame, these: DataFrame, how: str) -> DataFrame:
        a, b = fresh(rows, "id", "th")
        those = these.toDF(a, b)
        return rows.join(those, (keys[0] == those[a]) & (keys[1] == those[b]), how)

    passed, held = split_rows(df, keys, losers)
    held = among(held, losers, "left_anti")
    kept = held if passed is None else passed.unionByName(held)
    if again.isEmpty():
        return kept
    nth = fresh(df, "nth")[0]
    first = Window.partitionBy(*keys).orderBy(*row_order(df, [text_col]))
    passed, held = split_rows(kept, keys, again)
    once = among(held, again, "left_semi").withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1).drop(nth)
    rest = among(held, again, "left_anti").unionByName(once)
    return rest if passed is None else passed.unionByName(rest)
