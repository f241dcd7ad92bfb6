"""Masked pseudo-likelihood of documents under a bidirectional window network.

Tokens are words and runs of punctuation, ASCII case folded, as hashes of `TOKEN_BITS` bits; the first `CLASS_BITS` of them are the token's class. A network
sees the three tokens on either side of a masked one and predicts its class: an embedding for each place and hashed token, one tanh layer, a softmax
in two levels. Within its class a token has its share of the corpus, counted over all documents. Every window of every document trains the
network once: in each round the partitions train on their part of the documents where these lie, and their changes are averaged, each embedding by
how often a partition saw it. A document's score is the sum of the log-probabilities of all its tokens, each given both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import quoted
from sedimenta.llm.textkit import _LOWER, _WORD, run_hashes, spans, string_buffers

HIDDEN = 16
ROUNDS = 3
BATCH = 16384
RATE = 0.08
SIDES = (3, 2, 1, -1, -2, -3)  # how far left of the masked token
PLACE_BITS = 13  # context tokens are told apart by so many bits of their hash
CLASS_BITS = 8
TOKEN_BITS = 22
LEAST = 0.01  # what is added to the count of every token
PLACES, CLASSES, TOKENS, LEVEL = 1 << PLACE_BITS, 1 << CLASS_BITS, 1 << TOKEN_BITS, 1 << CLASS_BITS // 2
INSIDE = TOKENS // CLASSES
BLOCK = 1024  # rows of parameters that travel together

_KIND = np.where(_WORD, 1, 2).astype(np.uint8)  # 0 space, 1 word, 2 punctuation
_KIND[:33] = 0
_KIND[127] = 0


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all rows as hashes of `TOKEN_BITS` bits, and the first of each row (and the total)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = np.take(_KIND, data)
    edge = np.empty(len(data) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offs] = edge[0] = edge[-1] = True
    starts = np.flatnonzero(edge)
    starts, ends = starts[:-1], starts[1:]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    return (run_hashes(np.take(_LOWER, data), starts, ends) >> np.uint64(64 - TOKEN_BITS)).astype(np.int64), np.searchsorted(starts, offs)


def contexts(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Tokens x `SIDES`: rows of the embedding table of each token's context; beyond the text's ends stands the place's hash 0."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin, end = first[row], first[row + 1]
    at, place = np.arange(len(token)), (token >> (TOKEN_BITS - PLACE_BITS)).astype(np.int32)
    out = np.empty((len(token), len(SIDES)), np.uint16)
    for k, back in enumerate(SIDES):
        other = at - back
        inside = (other >= begin) & (other < end)
        out[:, k] = np.where(inside, place[np.clip(other, 0, max(0, len(token) - 1))], 0) + k * PLACES
    return out


@dataclass
class Network:
    embed: np.ndarray  # (places x PLACES) x H
    hidden: np.ndarray  # H
    upper: np.ndarray  # H x LEVEL, scores of the first half of a class
    upper_bias: np.ndarray
    lower: np.ndarray  # LEVEL x H x LEVEL, scores of the second half given the first
    lower_bias: np.ndarray

    @classmethod
    def fresh(cls, class_counts: np.ndarray, hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        n = class_counts.reshape(LEVEL, LEVEL) + 0.5
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        return cls(draw(0.1, len(SIDES) * PLACES, hidden), np.zeros(hidden, np.float32), draw(0.1, hidden, LEVEL), np.log(n.sum(axis=1) / n.sum()).astype(np.float32), draw(0.1, LEVEL, hidden, LEVEL), np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.hidden, self.upper, self.upper_bias, self.lower, self.lower_bias]

    def copy(self) -> Network:
        return Network(*[p.copy() for p in self.parts()])

    def layer(self, context: np.ndarray) -> np.ndarray:
        z = np.take(self.embed, context[:, 0], axis=0, mode="clip")
        held = np.empty_like(z)
        for k in range(1, context.shape[1]):
            z += np.take(self.embed, context[:, k], axis=0, out=held, mode="clip")
        z += self.hidden
        return np.tanh(z, out=z)

    def levels(self, h: np.ndarray, edges: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(scores, their exponentials, sums of these) of both levels for rows sorted by the first half of their class; edges[g] is the first
        row of half g."""
        a = h @ self.upper
        a += self.upper_bias
        b = np.empty((len(h), LEVEL), h.dtype)
        for g in np.flatnonzero(np.diff(edges)):
            rows = slice(edges[g], edges[g + 1])
            np.matmul(h[rows], self.lower[g], out=b[rows])
            b[rows] += self.lower_bias[g]
        out = []
        for x in (a, b):
            if not np.abs(x).max(initial=0) < 60:
                x -= x.max(axis=1, keepdims=True)
            e = np.exp(x)
            out.append((x, e, e @ np.ones(LEVEL, x.dtype)))
        return out

    def log_prob(self, context: np.ndarray, klass: np.ndarray) -> np.ndarray:
        """Log-probability of each row's class given its context."""
        out = np.empty(len(klass))
        for lo in range(0, len(klass), BATCH):
            c = klass[lo : lo + BATCH]
            order = np.argsort(c, kind="stable")
            mine = c[order]
            top, low = mine // LEVEL, mine % LEVEL
            (a, _, za), (b, _, zb) = self.levels(self.layer(context[lo : lo + BATCH][order]), np.searchsorted(top, np.arange(LEVEL + 1)))
            at = np.arange(len(mine))
            out[lo + order] = a[at, top] + b[at, low] - np.log(za) - np.log(zb)
        return out

    def gradient(self, context: np.ndarray, klass: np.ndarray) -> tuple[float, list]:
        """Mean negative log-probability of a batch and its gradient: (rows, values, occurrences) for the embeddings, then one array a parameter."""
        order = np.argsort(klass, kind="stable")
        context, klass = context[order], klass[order]
        top, low, at, n = klass // LEVEL, klass % LEVEL, np.arange(len(klass)), len(klass)
        edges = np.searchsorted(top, np.arange(LEVEL + 1))
        h = self.layer(context)
        (a, ea, za), (b, eb, zb) = self.levels(h, edges)
        loss = float((np.log(za) + np.log(zb) - a[at, top] - b[at, low]).sum()) / n
        for e, z, y in ((ea, za, top), (eb, zb, low)):
            e *= (1 / (n * z))[:, None]
            e[at, y] -= e.dtype.type(1 / n)
        back = ea @ self.upper.T
        lower, lower_bias = np.zeros_like(self.lower), np.zeros_like(self.lower_bias)
        for g in np.flatnonzero(np.diff(edges)):
            rows = slice(edges[g], edges[g + 1])
            back[rows] += eb[rows] @ self.lower[g].T
            lower[g] = h[rows].T @ eb[rows]
            lower_bias[g] = eb[rows].sum(axis=0)
        back *= 1 - h * h
        flat = context.ravel()
        by = np.argsort(flat, kind="stable")
        sorted_ = flat[by]
        last = np.flatnonzero(np.concatenate([sorted_[1:] != sorted_[:-1], [True]]))
        run = np.cumsum(np.take(back.astype(np.float64), by // context.shape[1], axis=0), axis=0)[last]
        total = np.diff(run, axis=0, prepend=0)
        seen = np.diff(last, prepend=-1)
        return loss, [(sorted_[last], total.astype(h.dtype), seen), back.sum(axis=0), h.T @ ea, ea.sum(axis=0), lower, lower_bias]


class Trainer:
    """Adagrad over batches of windows, one accumulator a row of embeddings."""

    def __init__(self, net: Network, rate: float) -> None:
        self.net, self.rate = net.copy(), rate
        self.row_sum = np.full(len(net.embed), 1e-8, np.float32)
        self.sums = [np.full_like(p, 1e-8) for p in self.net.parts()[1:]]
        self.seen = np.zeros(len(net.embed), np.float32)
        self.windows = 0

    def learn(self, context: np.ndarray, klass: np.ndarray) -> float:
        loss, ((rows, g, seen), *rest) = self.net.gradient(context, klass)
        self.row_sum[rows] += (g * g).mean(axis=1)
        self.net.embed[rows] -= self.rate * g / np.sqrt(self.row_sum[rows])[:, None]
        for p, s, d in zip(self.net.parts()[1:], self.sums, rest):
            s += d * d
            p -= self.rate / 4 * d / np.sqrt(s)
        self.seen[rows] += seen
        self.windows += len(klass)
        return loss

    def changes(self, start: Network):
        """(part, weights of its rows, changes of its rows) of all parameters, in half precision."""
        yield from blocks([new - old for new, old in zip(self.net.parts(), start.parts())], self.seen, self.windows)


def blocks(parts: list[np.ndarray], seen: np.ndarray, windows: float):
    for lo in range(0, len(parts[0]), BLOCK):
        yield lo // BLOCK, seen[lo : lo + BLOCK], parts[0][lo : lo + BLOCK].astype(np.float16).ravel()
    rest = np.concatenate([p.ravel() for p in parts[1:]])
    yield -(-len(parts[0]) // BLOCK), np.array([windows], np.float32), rest.astype(np.float16)


def moved(net: Network, changes: dict[int, np.ndarray]) -> Network:
    """The network with averaged changes applied."""
    out = net.copy()
    end = -(-len(net.embed) // BLOCK)
    for k, values in changes.items():
        if k < end:
            out.embed[k * BLOCK : (k + 1) * BLOCK] += values.reshape(-1, net.embed.shape[1])
        else:
            at = 0
            for p in out.parts()[1:]:
                p += values.ravel()[at : at + p.size].reshape(p.shape)
                at += p.size
    return out


def _each(column):
    """(tokens, first token of each row) of spans of a text column, with the rows they come from."""
    data, offs = string_buffers(column)
    for lo, hi in spans(offs):
        yield lo, hi, *tokens(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


def gather(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each of the `TOKENS` hashes occurs in all texts: summed by shuffles; the driver gets dense blocks, the same number for any corpus."""

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, token, _ in _each(batch.column(0)):
                held.append(token)
                size += len(token)
                if size > 1 << 22:
                    yield rows(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield rows(np.concatenate(held))

    def rows(token):
        t, n = np.unique(token, return_counts=True)
        return pa.RecordBatch.from_pydict({"token": pa.array(t.astype(np.int32)), "n": pa.array(n.astype(np.int64))})

    def dense(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            t, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(t // (1 << 16)):
                own = t // (1 << 16) == k
                total.setdefault(int(k), np.zeros(1 << 16, np.int64))[t[own] % (1 << 16)] = n[own]
        for k, n in total.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "n": pa.array([n.tobytes()], pa.binary())})

    counted = docs.select(quoted(text_col)).mapInArrow(count, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    out = np.zeros(TOKENS, np.int64)
    for k, n in counted.repartition(min(64, TOKENS >> 16), F.shiftright("token", 16)).mapInArrow(dense, "k int, n binary").collect():
        out[k << 16 : (k + 1) << 16] = np.frombuffer(n, np.int64)
    return out


def inside_class(counts: np.ndarray) -> np.ndarray:
    """Log-share of each token in its class."""
    n = counts.reshape(CLASSES, INSIDE) + LEAST
    return np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32).ravel()


def train(docs: DataFrame, counts: np.ndarray, rounds: int = ROUNDS, text_col: str = "text", rate: float = RATE) -> Network:
    """The network after every document has trained it, in one of the rounds by its text's hash."""
    spark, net = docs.sparkSession, Network.fresh(counts.reshape(CLASSES, INSIDE).sum(axis=1))
    text = quoted(text_col)
    for r in range(rounds):
        start = spark.sparkContext.broadcast(net)

        def learn(batches, start=start, r=r):
            trainer, rng = Trainer(start.value, rate / (1 + r) ** 0.5), np.random.default_rng(r)
            for batch in batches:
                for _, _, token, first in _each(batch.column(0)):
                    context, klass = contexts(token, first), (token >> (TOKEN_BITS - CLASS_BITS)).astype(np.int16)
                    order = rng.permutation(len(token))
                    for lo in range(0, len(order), BATCH):
                        trainer.learn(context[order[lo : lo + BATCH]], klass[order[lo : lo + BATCH]])
            if trainer.windows:
                k, w, v = zip(*trainer.changes(start.value))
                yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32()), "w": pa.array([x.tobytes() for x in w], pa.binary()), "v": pa.array([x.tobytes() for x in v], pa.binary())})

        def average(batches):
            total: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for k, w, v in zip(*(c.to_pylist() for c in batch.columns)):
                    w = np.frombuffer(w, np.float32).astype(float)
                    v = np.frombuffer(v, np.float16).astype(float).reshape(len(w), -1)
                    held = total.setdefault(k, [np.zeros_like(w), np.zeros_like(v)])
                    held[0] += w
                    held[1] += w[:, None] * v
            for k, (w, v) in sorted(total.items()):
                mean = (v / np.maximum(w, 1e-9)[:, None]).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "v": pa.array([mean.tobytes()], pa.binary())})

        part = docs.filter(F.pmod(F.xxhash64(text), F.lit(rounds)) == r).select(text)
        changed = part.mapInArrow(learn, "k int, w binary, v binary").repartition(16, "k").mapInArrow(average, "k int, v binary")
        net = moved(net, {k: np.frombuffer(v, np.float32) for k, v in changed.collect()})
        start.unpersist()
    return net


def row_scores(net: Network, inside: np.ndarray, token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of log-probabilities of the tokens of each row."""
    value = net.log_prob(contexts(token, first), (token >> (TOKEN_BITS - CLASS_BITS)).astype(np.int16)) + inside[token]
    total = np.concatenate([[0], np.cumsum(value)])
    return total[first[1:]] - total[first[:-1]]


def lm_score(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_prob) of every row of `docs`.

    The network is trained on all of `docs`. Tokens are the words and runs of punctuation of the whole text, however long. A text without any, a null, empty or blank
    one, has 0 tokens, log-likelihood 0 and mean null. Each row is scored on its own, so repeated rows and null ids give as many rows (and repeated
    texts count as often in the training). Tokens are known by a hash of 22 bits, so different words may count as one. An empty table gives an
    empty table; further columns aren't read, so their names don't matter.
    """
    docs = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    counts = gather(docs)
    net = train(docs, counts, rounds) if counts.any() else Network.fresh(np.zeros(CLASSES))
    shared = docs.sparkSession.sparkContext.broadcast((net, inside_class(counts)))

    def run(batches):
        model, inside = shared.value
        for batch in batches:
            out, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for lo, hi, token, first in _each(batch.column(1)):
                if len(token):
                    out[lo:hi], n[lo:hi] = row_scores(model, inside, token, first), np.diff(first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(out), pa.array(out / np.maximum(n, 1), mask=n == 0)], ["doc_id", "n_tokens", "log_likelihood", "mean_log_prob"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, log_likelihood double, mean_log_prob double")
