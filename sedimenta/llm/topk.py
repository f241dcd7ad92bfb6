"""Exact nearest neighbours of every vector by pivot-table elimination.

The distances of all vectors to many pivots are computed once. By the triangle inequality the largest difference between two
vectors' pivot distances is a lower bound of their own distance. Vectors lie in groups: those with one nearest pivot, cut by their distance
to it. The groups lie once in the shared folder, and no vector is sent anywhere else: a task takes the queries of a group, searches that group first and
then reads the others in the order of their bounds, each for the queries whose own k-th best distance so far isn't below the bound. There a query
evaluates candidates in the order of their bounds, and stops when the next bound is above that distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm.common import cut, opened, quoted, removed, shuffle_partitions, split_rows, written

PIVOTS = 48
GROUP = 8192
PLACES = 9  # distances are rounded to so many places
TIE = 1.01 * 10.0**-PLACES  # distances closer than this may be equal once rounded


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those before it."""
    if not len(sample):
        return sample
    picked = [0]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(picked) < min(n, len(sample)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[picked[-1]], axis=1))
    return sample[picked]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, from the differences: good to a few units in the last place whatever the vectors' lengths."""
    out = np.empty((len(a), len(b)))
    for k, v in enumerate(b):
        out[:, k] = np.linalg.norm(a - v, axis=1)
    return out


def given_way(tau: np.ndarray, reach: float) -> np.ndarray:
    """`tau` and what rounding may hide: a tie at the last place, and errors of float64 distances up to `reach`."""
    return tau + TIE + 1e-13 * (reach + np.where(np.isfinite(tau), tau, 0.0))


class Tile:
    """Candidates that many queries search: their pivot distances as shares of `reach` in single precision."""

    def __init__(self, xp: np.ndarray, reach: float) -> None:
        self.reach = reach
        self.p = np.ascontiguousarray((xp / reach).astype(np.float32).T)

    def bounds(self, qp: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Lower bounds (queries x candidates) of the distances, as shares of `reach`. Pivots are added while they still rule candidates out."""
        q = (qp / self.reach).astype(np.float32)
        out = np.zeros((len(q), self.p.shape[1]), np.float32)
        part = np.empty_like(out)
        left = out.size
        for k in range(len(self.p)):
            np.subtract(q[:, k, None], self.p[k], out=part)
            np.abs(part, out=part)
            np.maximum(out, part, out=out)
            if k % 12 == 11 and k + 1 < len(self.p) and np.isfinite(limit).all():
                now = np.count_nonzero(out <= limit[:, None])
                if now > 0.97 * left or not now:
                    break
                left = now
        return out


class Form:
    """Squared distances of queries and candidates as one matrix product, in units of `scale`: vectors relative to `centre` and no longer than one unit,
    in single or double precision. No square is off by more than `loose`."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, scale: float, kind: type) -> None:
        self.kind, self.centre, self.scale, self.n = kind, centre, scale, len(x)
        self.loose = 8 * (x.shape[1] + 4) * float(np.finfo(kind).eps) / 2
        self.form = np.zeros((x.shape[1] + 1, -(-len(x) // 8) * 8), kind)  # places up to a multiple of 8 are infinitely far
        y = ((x - centre) / scale).astype(kind)
        self.form[:-1, : self.n] = -2 * y.T
        self.form[-1] = np.inf
        self.form[-1, : self.n] = (y.astype(float) ** 2).sum(axis=1)
        self.room = np.empty((0, self.form.shape[1]), kind), np.empty((0, self.form.shape[1]), bool)

    def squares(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The squares less those of the queries, in a matrix that the next call takes again; the squares of the queries."""
        q = np.concatenate([((q - self.centre) / self.scale).astype(self.kind), np.ones((len(q), 1), self.kind)], axis=1)
        if len(self.room[0]) < len(q):
            self.room = tuple(np.empty((len(q), a.shape[1]), a.dtype) for a in self.room)
        return np.matmul(q, self.form, out=self.room[0][: len(q)]), (q[:, :-1].astype(float) ** 2).sum(axis=1)

    def kth(self, q: np.ndarray, k: int) -> np.ndarray:
        """A distance that isn't below that of the query's k + 1-th nearest candidate, which there must be."""
        square, own = self.squares(q)
        return self.scale * np.sqrt(np.maximum(np.partition(square, k, axis=1)[:, k] + own, 0) + self.loose)

    def near(self, q: np.ndarray, limit: np.ndarray, reach: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query row, candidate), ordered by row, of all that may lie within `limit`, and a limit as in `kth` where so many were found. Of
        many pairs those beyond it are left out."""
        square, own = self.squares(q)

        def most(limit: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                return ((given_way(limit, reach) / self.scale) ** 2 + self.loose).astype(self.kind)

        flag = np.less_equal(square, (most(limit) - own).astype(self.kind)[:, None], out=self.room[1][: len(q)])
        word = np.flatnonzero(flag.view(np.uint64))  # hits are rare
        at, bit = np.nonzero(flag.reshape(-1, 8)[word])
        r, c = np.divmod(8 * word[at] + bit, flag.shape[1])
        r, c = r[c < self.n], c[c < self.n]
        least = np.full(len(q), np.inf)
        if len(r) > 2 * k * len(q):
            value = square[r, c] + own[r]
            order = np.lexsort((value, r))
            last = np.flatnonzero(np.arange(len(r)) - np.searchsorted(r, r) == k)  # the k + 1-th of a row stands there
            least[r[last]] = self.scale * np.sqrt(np.maximum(value[order[last]], 0) + self.loose)
            keep = value <= most(least)[r]
            r, c = r[keep], c[keep]
        return r, c, least


ULP = np.float32(4 * 2.0**-24)  # by which a single-precision bound may be too high, as a share of `reach`
FEW = 16  # a query whose bounds leave less than one in so many candidates takes them in order; else all are evaluated at once
WIDE = 4  # more than one in so many: not even their order is asked for
PROBE = 512  # candidates that give a first k-th distance


def search(q: np.ndarray, qid: np.ndarray, qp: np.ndarray, tau: np.ndarray, x: np.ndarray, xid: np.ndarray, xp: np.ndarray, k: int, batch: int = 32, step: int = 32):
    """The k best candidates of each query that may lie within its `tau`: (query row, candidate row, distance), and how
    many pairs were evaluated. Equal ids aren't neighbours. A query without a k-th best distance takes it from some of the candidates. Then
    it takes those below that distance in the order of their bounds, in growing steps, until the next bound is above it; where bounds leave many, or those
    of every `FEW`-th candidate show that they will, all candidates are evaluated at once and the near ones again, exactly."""
    out_q, out_x, out_d, evaluated = [], [], [], 0
    reach = max(float(np.abs(qp).max(initial=0.0)), float(np.abs(xp).max(initial=0.0)), 1e-300)
    n = len(x)
    size = min(n, max(step, 2 * k))
    if n and len(q):
        tile, probe = Tile(xp, reach), Tile(xp[::FEW], reach)
        centre = x.mean(axis=0)
        scale = max(1e-300, *(float(np.sqrt(((y - centre) ** 2).sum(axis=1).max())) for y in (x, q)))
        some = x[:: max(1, n // max(PROBE, 8 * (k + 1)))]
        forms: dict = {}

        def form(*key):
            if key not in forms:
                forms[key] = Form(some if key[1] else x, centre, scale, key[0])
            return forms[key]

    for lo in range(0, len(q) if n else 0, batch):
        rows = np.arange(lo, min(len(q), lo + batch))
        t = tau[rows].astype(float)  # the k-th best distance so far
        best_d, best_x = np.full((len(rows), k), np.inf), np.full((len(rows), k), -1, np.int64)

        def take(r: np.ndarray, c: np.ndarray) -> None:
            """Evaluates pairs of rows of the batch and candidates, ordered by row."""
            if not len(r):
                return
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            width = int(nth.max()) + 1
            cols, d = np.full((len(rows), width), -1, np.int64), np.full((len(rows), width), np.inf)
            cols[r, nth] = c
            for a in range(0, len(r), 1 << 13):
                part = slice(a, a + (1 << 13))
                gap = x[c[part]] - q[rows[r[part]]]
                d[r[part], nth[part]] = np.round(np.sqrt((gap * gap).sum(axis=1)), PLACES)
            all_d, all_x = np.concatenate([best_d, d], axis=1), np.concatenate([best_x, cols], axis=1)
            order = np.lexsort((np.where(all_x < 0, 1 << 62, xid[all_x]), all_d), axis=1)[:, :k]
            best_d[:], best_x[:] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_x, order, 1)
            np.minimum(t, best_d[:, -1], out=t)

        def others(r: np.ndarray, c: np.ndarray) -> np.ndarray:
            return qid[rows[r]] != xid[c]

        limit = lambda: (given_way(t, reach) / reach + ULP).astype(np.float32)  # noqa: B023, E731
        if n > k + 1 and len(new := np.flatnonzero(np.isinf(t))):  # one of the k + 1 nearest may be the query itself
            t[new] = form(np.float64, True).kth(q[rows[new]], k)
            evaluated += len(new) * len(some)
        wide = np.count_nonzero(probe.bounds(qp[rows], limit()) <= limit()[:, None], axis=1) * WIDE > probe.p.shape[1]
        few, many = np.flatnonzero(~wide), np.flatnonzero(wide)
        if len(few):
            bound = tile.bounds(qp[rows[few]], limit()[few])
            open_ = bound <= limit()[few, None]
            left = np.count_nonzero(open_, axis=1)
            if len(again := np.flatnonzero(left * FEW > n)):  # those of lowest bounds may bring a smaller limit
                cols = np.sort(np.argpartition(bound[again], size - 1, axis=1)[:, :size], axis=1)
                r, c = np.repeat(few[again], size), cols.ravel()
                ok = others(r, c)
                evaluated += int(ok.sum())
                take(r[ok], c[ok])
                bound[again[:, None], cols] = np.nan  # below no limit
                open_ = bound <= limit()[few, None]
                left = np.count_nonzero(open_, axis=1)
            r, c = np.nonzero(open_ & (left * FEW <= n)[:, None])
            b, r = bound[r, c], few[r]
            many = np.sort(np.concatenate([many, few[left * FEW > n]]))
            order = np.lexsort((b, r))
            order = order[others(r[order], c[order])]
            r, c, b = r[order], c[order], b[order]
            nth, begin, width = np.arange(len(r)) - np.searchsorted(r, r), 0, size
            while begin <= nth.max(initial=-1):
                now = (nth >= begin) & (nth < begin + width) & (b <= limit()[r])
                if not now.any():
                    break
                evaluated += int(now.sum())
                take(r[now], c[now])
                begin, width = begin + width, 4 * width
        if len(many):
            # single precision, unless its error is large against the distances that are looked for
            single = np.median(t[many]) ** 2 > 64 * 8 * (x.shape[1] + 4) * 2.0**-24 * scale**2
            f = form(np.float32 if single else np.float64, False)
            evaluated += len(many) * n
            best_d[many], best_x[many] = np.inf, -1
            r, c, least = f.near(q[rows[many]], t[many], reach, k)
            t[many] = np.minimum(t[many], least)
            r = many[r]
            ok = others(r, c)
            take(r[ok], c[ok])
        r, c = np.nonzero((best_x >= 0) & (best_d <= given_way(tau[rows], reach)[:, None]))
        out_q.append(rows[r])
        out_x.append(best_x[r, c])
        out_d.append(best_d[r, c])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), evaluated
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_d), evaluated


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _by_key(batches):
    """Tables of the rows with one value in the first column; the rows come sorted by it."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        key = t.column(0).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        for a, b in zip(edges[:-1], edges[1:]):
            if held and held[0].column(0)[0].as_py() != key[a]:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def may_hold(gap, limit, reach):
    """Whether vectors at so large a gap may lie within the limit. What rounding may hide gives way as in `search`."""
    return gap <= limit + TIE + 1e-12 * (limit + reach)



def placed(batch: pa.RecordBatch, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector of the column `v`, and its distance."""
    d = distances(_matrix(batch.column("v")).astype(float), pivots)
    return d.argmin(axis=1), d.min(axis=1)


def spread(ids: np.ndarray) -> np.ndarray:
    """A hash of ids that isn't below zero."""
    h = ids.astype(np.int64).view(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


class Best:
    """The k nearest so far of each of n queries, in the order of distance and id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.d, self.x = k, np.full((n, k), np.inf), np.zeros((n, k), np.int64)

    def add(self, r: np.ndarray, x: np.ndarray, d: np.ndarray) -> None:
        rows = np.unique(r)
        r, x, d = np.concatenate([np.repeat(rows, self.k), r]), np.concatenate([self.x[rows].ravel(), x]), np.concatenate([self.d[rows].ravel(), d])
        order = np.lexsort((x, d, r))
        r, x, d = r[order], x[order], d[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        keep = nth < self.k
        self.x[r[keep], nth[keep]], self.d[r[keep], nth[keep]] = x[keep], d[keep]


def loaded(path: str, files: list[str], dim: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and pivot distances of a group, from its files."""
    system, root = opened(path)
    columns = {"ids": [], "vs": [], "ps": []}
    for f in files:
        t = pq.read_table(f"{root}/{f}", columns=list(columns), filesystem=system, partitioning=None)
        for c, held in columns.items():
            held += [np.frombuffer(b.as_buffer(), {"ids": "<i8", "vs": kind, "ps": "<f8"}[c]) for b in t.column(c)]
    ids = np.concatenate(columns["ids"])
    return ids, np.concatenate(columns["vs"]).reshape(-1, dim).astype(float), np.concatenate(columns["ps"]).reshape(len(ids), -1)


def nearest(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, group: int = GROUP) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest other vectors of every vector, Euclidean, exact.

    Distances are computed from the differences of the vectors in float64, whatever their magnitude, and rounded to 9 places; equal ones go to the smaller
    id. A row takes part, as query and as candidate, if it has an id and a vector of the commonest length without null or NaN or infinite elements (of
    equally common lengths the largest); other rows get no result. Rows that repeat an id count once, with the smallest vector. With fewer than
    k others all are returned. An empty table gives an empty table; further columns aren't read, so their names don't matter. Squared distances
    must not overflow float64 (elements up to about 1e150). The shared folder holds the vectors and their pivot distances once while this runs, then the
    result; Python workers read it (see `opened`).
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    source = vectors.select(quoted(vector_col).alias("v")).schema["v"].dataType
    single = isinstance(source, T.ArrayType) and isinstance(source.elementType, T.FloatType)  # stays as it is where it is stored
    rows = vectors.select(quoted(id_col).cast("bigint").alias("id"), quoted(vector_col).cast("array<float>" if single else "array<double>").alias("v")).filter("id is not null and v is not null")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size("v") > 0))
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    schema = "vec_id bigint, rank int, neighbour_id bigint, distance double"
    if common is None:
        return spark.createDataFrame([], schema)
    dim, kind = common[0], "<f4" if single else "<f8"
    rows = rows.filter(F.size("v") == dim)
    # only rows whose ids repeat shuffle for it
    once, held = split_rows(rows, [F.col("id")], cut(rows.groupBy("id").count().filter("count > 1").select("id")))
    held = held.groupBy("id").agg(F.min("v").alias("v"))
    rows = held if once is None else once.unionByName(held)
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(16 * pivots).select("v").collect()], float)
    shared = sc.broadcast(choose_pivots(sample, pivots))

    # the vectors of one nearest pivot are cut at quantiles of their distance to it; those that still are too many, at equal distances say, by a hash
    def spot(batches):
        for batch in batches:
            if batch.num_rows:
                home, far = placed(batch, shared.value)
                yield pa.RecordBatch.from_pydict({"home": pa.array(home.astype(np.int32)), "far": pa.array(far)})

    spots = cut(rows.mapInArrow(spot, "home int, far double"))
    sizes = {r[0]: r[1] for r in spots.groupBy("home").agg(F.count("*")).collect()}  # at most one row a pivot
    most = max(2, -(-max(sizes.values()) // group))
    shares = [F.lit(j / most) for j in range(1, most)]
    cuts = [np.zeros(0)] * len(shared.value)  # about a number a group
    for h, edges in spots.groupBy("home").agg(F.percentile_approx("far", F.array(*shares), F.lit(100 * most))).collect():
        step = -(-most // -(-sizes[h] // group))  # a home with fewer vectors takes every step-th edge
        cuts[h] = np.array(edges[step - 1 :: step])
    edges_of = sc.broadcast(cuts)

    def ring_of(home: np.ndarray, far: np.ndarray) -> np.ndarray:
        ring = np.zeros(len(home), np.int64)
        for h in np.unique(home):
            ring[home == h] = np.searchsorted(edges_of.value[h], far[home == h])
        return ring

    def rings(batches):
        for batch in batches:
            if batch.num_rows:
                home, far = (c.to_numpy() for c in batch.columns)
                both, m = np.unique(np.stack([home, ring_of(home, far)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_pydict({"home": pa.array(both[0].astype(np.int32)), "ring": pa.array(both[1].astype(np.int32)), "m": pa.array(m.astype(np.int64))})

    counted = spots.mapInArrow(rings, "home int, ring int, m bigint").groupBy("home", "ring").agg(F.sum("m").alias("m")).collect()  # about one row a group
    first, parts_of, at, room = [np.zeros(len(c) + 1, np.int64) for c in cuts], [np.ones(len(c) + 1, np.int64) for c in cuts], -1, 0
    for h, r, m in sorted(tuple(x) for x in counted):  # small ones share a group
        parts = -(-m // (group + group // 2))
        if m > room:
            at, room = at + 1, group + group // 4
        first[h][r], parts_of[h][r] = at, parts
        room -= m
        if parts > 1:
            at, room = at + parts - 1, 0
    groups, places = at + 1, sc.broadcast((first, parts_of))

    def grouped(batches):
        for batch in batches:
            if batch.num_rows:
                home, far = placed(batch, shared.value)
                ring, h, g = ring_of(home, far), spread(batch.column("id").to_numpy()), np.empty(len(home), np.int32)
                for a in np.unique(home):
                    mine = home == a
                    g[mine] = places.value[0][a][ring[mine]] + h[mine] % places.value[1][a][ring[mine]]
                yield pa.RecordBatch.from_pydict({"g": pa.array(g), "id": batch.column("id"), "v": batch.column("v")})

    def packed(batches):
        """A group as rows of about a megabyte: bytes of ids, vectors and pivot distances, and the least and the largest distance to each pivot."""
        for t in _by_key(batches):
            ids, v = t.column("id").to_numpy(), _matrix(t.column("v"))
            many = max(1, 1_000_000 // (8 * (dim + len(shared.value))))
            for a in range(0, len(ids), many):
                part = v[a : a + many]
                p = distances(part.astype(float), shared.value)
                blobs = {"ids": ids[a : a + many].astype("<i8"), "vs": part.astype(kind), "ps": p.astype("<f8")}
                sides = {"lo": pa.array([p.min(axis=0).tolist()]), "hi": pa.array([p.max(axis=0).tolist()])}
                yield pa.RecordBatch.from_pydict({"g": pa.array([t.column(0)[0].as_py()], pa.int32()), "n": pa.array([len(part)], pa.int32())} | {c: pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for c, b in blobs.items()} | sides)

    table = rows.mapInArrow(grouped, f"g int, id bigint, v array<{'float' if single else 'double'}>").repartition(min(groups, 1 << 20), "g").sortWithinPartitions("g")
    table = table.mapInArrow(packed, "g int, n int, ids binary, vs binary, ps binary, lo array<double>, hi array<double>")
    path = written(table, "g", compression="none", **{"parquet.enable.dictionary": "false"})
    try:
        held_in = spark.read.parquet(path).select("g", "n", "lo", "hi", F.col("_metadata.file_name").alias("file"))
        sides = [F.array(*[f(F.col(c)[j]) for j in range(len(shared.value))]).alias(c) for c, f in (("lo", F.min), ("hi", F.max))]
        there = sorted(tuple(r) for r in held_in.groupBy("g").agg(F.sum("n"), *sides, F.collect_set("file")).collect())  # a row a group
        names, number = [[f"g={r[0]}/{f}" for f in sorted(r[4])] for r in there], [r[1] for r in there]
        index = sc.broadcast((names, np.array([r[2] for r in there], float), np.array([r[3] for r in there], float)))
        # the queries of a group are cut into tasks where there are fewer groups than would keep all cores busy
        pieces = max(1, -(-2 * max(sc.defaultParallelism, shuffle_partitions(spark)) // len(there)))
        jobs = [(g, a, b) for g, m in enumerate(number) for n in [min(pieces, -(-m // 256))] for a, b in [(m * j // n, m * (j + 1) // n) for j in range(n)]]
        todo = sc.broadcast(jobs)

        def searched(batches):
            for batch in batches:
                for job in batch.column(0).to_pylist():
                    g, a, b = todo.value[job]
                    names, lo, hi = index.value
                    qid, q, qp = (x[a:b] for x in loaded(path, names[g], dim, kind))
                    best = Best(len(qid), k)
                    # the largest gap at any pivot between the ranges of the queries and a group is a lower bound; the own group first, then in its order
                    far = np.maximum(lo - qp.max(axis=0), qp.min(axis=0) - hi).max(axis=1)
                    far[g] = -np.inf
                    reach = np.maximum(qp.max(), hi.max(axis=1))
                    for x in np.argsort(far, kind="stable"):
                        tau = best.d[:, -1]
                        if not may_hold(far[x], tau.max(), reach[x]):
                            continue
                        own = np.maximum(lo[x] - qp, qp - hi[x]).max(axis=1)
                        rows = np.flatnonzero(may_hold(own, tau, reach[x]))
                        if len(rows):
                            xid, v, p = loaded(path, names[x], dim, kind)
                            r, c, d, _ = search(q[rows], qid[rows], qp[rows], tau[rows], v, xid, p, k, batch=128)
                            best.add(rows[r], xid[c], d)
                    r, c = np.nonzero(np.isfinite(best.d))
                    yield pa.RecordBatch.from_pydict({"vec_id": pa.array(qid[r]), "rank": pa.array((c + 1).astype(np.int32)), "neighbour_id": pa.array(best.x[r, c]), "distance": pa.array(best.d[r, c])})

        return cut(spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(searched, schema))
    finally:
        removed(spark, path)
