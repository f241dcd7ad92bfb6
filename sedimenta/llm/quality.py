"""Document quality by a linear-chain conditional random field over lines.

Every line that isn't blank gets shape features of its own and of its neighbours. The field, trained on lines that inherit
their document's label, labels lines good or bad; forward-backward marginals, weighted by the lines' lengths, give the quality.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm.common import quoted
from sedimenta.llm.labelled import labelled_sample
from sedimenta.llm.textkit import mix, spans, string_buffers, words

MAX_DOCS = 1500  # labelled documents of each class that train the field
REJECT = 0.5
STEPS = 120

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 symbol, 6 sentence mark
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
for _c in b" \t\r\f\v":
    _CLASS[_c] = 4
for _c in b"#$%&*@^~+=<>\\{}[]_/`":
    _CLASS[_c] = 5
for _c in b".,;:?'\"()-":
    _CLASS[_c] = 6
_SINGLE = (ord("!"), ord("|"))
OWN = 15


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first line of each row and the total) of the lines that aren't blank."""
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return starts, starts, np.zeros(len(offs), np.int64)
    ends = np.concatenate([starts[1:], [len(data)]])
    ends = ends - (data[ends - 1] == 10)
    solid = np.concatenate([[0], np.cumsum((_CLASS[data] != 4) & (data != 10))])
    keep = solid[ends] > solid[starts]
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offs)


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features: lines x (3 OWN + 3), lengths, first line of each row)."""
    starts, ends, first = lines(data, offs)
    n = len(starts)
    length = (ends - starts).astype(np.float64)
    own = np.zeros((n, OWN))
    if n:
        cls = _CLASS[data]
        masks = [cls == c for c in range(1, 7)] + [data == c for c in _SINGLE]
        for k, m in enumerate(masks):
            total = np.concatenate([[0], np.cumsum(m, dtype=np.int32)])
            own[:, k] = (total[ends] - total[starts]) / length
        ws, we, h, _ = words(data, offs, lower=False)
        lo, hi = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
        count = (hi - lo).astype(np.float64)
        size = np.concatenate([[0], np.cumsum(we - ws)])
        own[:, 8] = np.log1p(length) / 5
        own[:, 9] = (size[hi] - size[lo]) / np.maximum(count, 1) / 10
        line_of = np.repeat(np.arange(n), hi - lo)
        h = h[ragged_index(lo, hi)]
        for k, lag in ((10, 1), (11, 2), (12, 3)):
            if len(h) > lag:
                same = np.zeros(len(h))
                same[lag:] = (h[lag:] == h[:-lag]) & (line_of[lag:] == line_of[:-lag])
                own[:, k] = np.bincount(line_of, same, n) / np.maximum(count, 1)
        own[:, 13] = 1.0
        if len(h):
            distinct = _distinct(line_of, h, n)
            own[:, 13] = distinct / np.maximum(count, 1)
        own[:, 14] = np.log1p(count) / 5
    at = np.arange(n)
    row_start, row_end = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    has_prev, has_next = at > row_start, at + 1 < row_end
    prev, nxt = np.zeros_like(own), np.zeros_like(own)
    prev[has_prev] = own[at[has_prev] - 1]
    nxt[has_next] = own[at[has_next] + 1]
    return np.concatenate([own, prev, nxt, has_prev[:, None], has_next[:, None], np.ones((n, 1))], axis=1), length, first


def ragged_index(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    start = np.cumsum(n) - n
    return np.repeat(lo - start, n) + np.arange(int(n.sum()))


def _distinct(line_of: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different words each line has."""
    key = np.sort((line_of.astype(np.uint64) << np.uint64(44)) | (mix(h) >> np.uint64(20)))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=n)


def _lse(x: np.ndarray) -> np.ndarray:
    m = x.max(axis=-1)
    return m + np.log(np.exp(x - m[..., None]).sum(axis=-1))


@dataclass
class Crf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # score of "good"
    transition: np.ndarray  # 2 x 2

    def unary(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights


def chains(first: np.ndarray, most: int = 1 << 18):
    """Groups of rows of like numbers of lines: (rows, positions rows x lines, mask)."""
    n = np.diff(first)
    rows = np.argsort(n, kind="stable")
    rows = rows[n[rows] > 0]
    lo = 0
    while lo < len(rows):
        hi = lo + 1
        while hi < len(rows) and n[rows[hi]] <= 1.3 * n[rows[lo]] + 2 and n[rows[hi]] * (hi + 1 - lo) <= most:
            hi += 1
        part = rows[lo:hi]
        width = int(n[part].max())
        at = first[part][:, None] + np.arange(width)
        mask = np.arange(width) < n[part][:, None]
        yield part, np.where(mask, at, 0), mask
        lo = hi


def forward_backward(good: np.ndarray, mask: np.ndarray, transition: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of "good" (rows x lines), log partition sums, and expected transitions summed over the rows by their weights (2 x 2).
    `good` is each line's score for "good" against "bad"."""
    weight = np.ones(len(good)) if weight is None else weight
    r, n = good.shape
    unary = np.stack([np.zeros_like(good), good], axis=2)
    fwd = np.empty((r, n, 2))
    fwd[:, 0] = unary[:, 0]
    for t in range(1, n):
        step = _lse((fwd[:, t - 1, :, None] + transition).transpose(0, 2, 1)) + unary[:, t]
        fwd[:, t] = np.where(mask[:, t, None], step, fwd[:, t - 1])
    logz = _lse(fwd[:, -1])
    bwd = np.zeros((r, n, 2))
    pairs = np.zeros(4)
    for t in range(n - 2, -1, -1):
        nxt = unary[:, t + 1] + bwd[:, t + 1]
        step = _lse(transition + nxt[:, None, :])
        live = mask[:, t + 1]
        bwd[:, t] = np.where(live[:, None], step, 0.0)
        joint = np.exp(fwd[:, t, :, None] + transition + nxt[:, None, :] - logz[:, None, None])
        pairs += weight[live] @ joint[live].reshape(-1, 4) if live.any() else 0.0
    marginal = np.exp(fwd + bwd - logz[:, None, None])[:, :, 1]
    return np.where(mask, marginal, 0.0), logz, pairs.reshape(2, 2)


def objective(w: np.ndarray, tr: np.ndarray, x: np.ndarray, first: np.ndarray, y: np.ndarray, doc_weight: np.ndarray, ridge: float, groups: list | None = None) -> tuple[float, np.ndarray]:
    """The weighted negative log-likelihood of chains whose lines all have their document's label, with a ridge, and its gradient."""
    good, n = x @ w, np.diff(first)
    loss, residual, grad_tr = 0.0, np.zeros(len(x)), np.zeros((2, 2))
    for rows, at, mask in chains(first) if groups is None else groups:
        m, logz, pairs = forward_backward(good[at], mask, tr, doc_weight[rows])
        residual[at[mask]] = m[mask]
        label, steps = y[rows], doc_weight[rows] * (n[rows] - 1)
        seen = np.diag([steps[label == 0].sum(), steps[label == 1].sum()])
        grad_tr += pairs - seen
        loss += doc_weight[rows] @ (logz - label * np.where(mask, good[at], 0.0).sum(axis=1)) - (seen * tr).sum()
    by_line = np.repeat(doc_weight, n)
    grad = x.T @ ((residual - np.repeat(y, n)) * by_line) + ridge * w
    return loss + ridge / 2 * ((w**2).sum() + (tr**2).sum()), np.concatenate([grad, (grad_tr + ridge * tr).ravel()])


def train(features: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = STEPS, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood by full-batch Adam; each document weighs the same however many lines it has, and so does each class."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0.0, 1.0
    x = np.clip((features - mean) / scale, -8, 8)
    share = np.array([max(1, (y == c).sum()) for c in (0, 1)])
    doc_weight = 1 / (np.maximum(np.diff(first), 1) * share[y] * 2)
    w, tr = np.zeros(x.shape[1]), np.zeros((2, 2))
    state = [np.zeros(x.shape[1] + 4) for _ in range(2)]
    groups = list(chains(first))
    for step in range(1, steps + 1):
        grad = objective(w, tr, x, first, y, doc_weight, ridge, groups)[1]
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-9)
        w, tr = w - move[:-4], tr - move[-4:].reshape(2, 2)
    return Crf(mean, scale, w, tr)


def quality_of(model: Crf, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The quality of each row, NaN for a row without lines."""
    features, length, first = line_features(data, offs)
    out = np.full(len(offs) - 1, np.nan)
    if len(features):
        good = np.clip((features - model.mean) / model.scale, -8, 8) @ model.weights
        for rows, at, mask in chains(first):
            m, _, _ = forward_backward(good[at], mask, model.transition)
            weight = np.where(mask, length[at], 0.0)
            out[rows] = (m * weight).sum(axis=1) / weight.sum(axis=1)
    return out


def _sample_features(batches):
    for batch in batches:
        data, offs = string_buffers(batch.column(2))
        f, _, first = line_features(data, offs)
        f = f.astype(np.float32)
        yield pa.RecordBatch.from_pydict({"id": batch.column(0), "y": batch.column(1), "f": pa.array([f[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_docs: int = MAX_DOCS) -> Crf | None:
    """The field from at most `max_docs` labelled documents of each class; None without both classes."""
    sample = labelled_sample(docs, labels, "quality", max_docs, text_col, id_col)
    rows = sample.select("id", "y", "text").mapInArrow(_sample_features, "id bigint, y int, f binary").toPandas().sort_values("id", ignore_index=True)
    width = 3 * OWN + 3
    parts = [np.frombuffer(x, np.float32).reshape(-1, width).astype(np.float64) for x in rows["f"]]
    keep = [k for k, p in enumerate(parts) if len(p)]
    y = rows["y"].to_numpy(np.int64)[keep] if keep else np.zeros(0, np.int64)
    if len(np.unique(y)) < 2:
        return None
    first = np.concatenate([[0], np.cumsum([len(parts[k]) for k in keep])])
    return train(np.concatenate([parts[k] for k in keep]), first, y)


def _scorer(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, max_docs: int):
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col, id_col, max_docs))

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        data, offs = string_buffers(texts)
        out = np.full(len(offs) - 1, np.nan)
        if shared.value is not None:
            for lo, hi in spans(offs):
                out[lo:hi] = quality_of(shared.value, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        return pa.array(out, from_pandas=True)

    return score


def quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", reject: float = REJECT, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, quality, is_good) of every row of `docs`.

    `quality` is the length-weighted probability that the document's lines are good, `is_good` whether it reaches `reject`. Blank lines
    don't count; a null, empty or blank text has no lines, the quality null and counts as good, as nothing in it is bad. Without labels of both
    classes every quality is null. Each row is scored on its own, so repeated rows and null ids give as many rows; a text may be one
    line of any length. An empty table gives an empty table; further columns aren't read, so their names don't matter.
    """
    docs = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    score = _scorer(docs, labels, "text", "doc_id", max_docs)
    return docs.select("doc_id", score(F.col("text")).alias("quality")).withColumn("is_good", F.coalesce(F.col("quality") >= reject, F.lit(True)))


def only_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", reject: float = REJECT, max_docs: int = MAX_DOCS) -> DataFrame:
    """The rows of `docs` that `quality` calls good, all columns unchanged, repeated rows as often as they come. A null quality stays: null, empty and blank texts,
    and all texts where there are no labels of both classes. A tie with `reject` is good. An empty table stays empty; columns of any name are carried along."""
    score = _scorer(docs, labels, text_col, id_col, max_docs)
    return docs.filter(F.coalesce(score(quoted(text_col)) >= reject, F.lit(True)))
