"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The vocabulary holds the words whose document frequency differs between the toxic and the clean examples
(chi-squared test); their idf comes from all documents. Examples lie in an inverted index of blocks that knows each
word's largest weight in each block. A query visits blocks in the order of the bounds these give and stops when no bound
reaches its k-th best cosine, so the neighbours are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm.common import quoted
from sedimenta.llm.labelled import labelled_sample
from sedimenta.llm.textkit import mix, spans, string_buffers, words

MAX_EXAMPLES = 2000  # of each class, for the index; as many again of each for the calibration
NEIGHBOURS = 10
BLOCK = 64
CHI2 = 15.0  # a word is in the vocabulary if its chi-squared statistic between the classes reaches this
MIN_DOCS = 4  # and so many examples have it
ALIKE = 0.5  # labelled texts of one class whose word sets have this Jaccard similarity count once
REJECT = 0.5
DRAWS = 4  # samples of the labels at most, the first among them


@dataclass
class BlockMaxIndex:
    """Unit example vectors (n x words) in blocks, with every word's largest weight in each block."""

    weights: np.ndarray
    bounds: np.ndarray
    terms: list[np.ndarray]  # the words that occur in each block
    postings: list[np.ndarray]  # their weights: words x examples of the block
    block: int = BLOCK

    @classmethod
    def build(cls, weights: np.ndarray, block: int = BLOCK) -> BlockMaxIndex:
        starts = np.arange(0, len(weights), block)
        bounds = np.maximum.reduceat(weights, starts, axis=0) if len(weights) else np.zeros((0, weights.shape[1]))
        terms = [np.flatnonzero(b) for b in bounds]
        return cls(weights, bounds, terms, [np.ascontiguousarray(weights[lo : lo + block][:, t].T) for lo, t in zip(starts, terms)], block)

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (rows x k, -1 where there is none) and cosines of the k nearest examples that share a word with
        the query. Equal cosines (to 12 places) go to the smaller position."""
        n = len(q)
        best = np.full((n, k), -1, np.int64)
        score = np.zeros((n, k))
        if not n or not len(self.weights):
            return best, score
        upper = q @ self.bounds.T
        order = np.argsort(-upper, axis=1, kind="stable")
        alive = np.arange(n)
        for r in range(order.shape[1]):
            nxt = upper[alive, order[alive, r]]
            alive = alive[(nxt > 0) & (nxt + 1e-9 >= score[alive, -1])]
            if not len(alive):
                break
            blocks = order[alive, r]
            by_block = np.argsort(blocks, kind="stable")
            edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks[by_block])) + 1, [len(alive)]])
            for at, end in zip(edges[:-1], edges[1:]):
                rows = alive[by_block[at:end]]
                b = int(blocks[by_block[at]])
                lo = b * self.block
                got = np.round(q[rows][:, self.terms[b]] @ self.postings[b], 12)
                better = np.flatnonzero(got.max(axis=1) >= np.maximum(score[rows, -1], 1e-12))
                if not len(better):
                    continue
                rows, got = rows[better], got[better]
                ids = np.where(got > 0, np.arange(lo, lo + got.shape[1]), -1)
                all_s = np.concatenate([score[rows], got], axis=1)
                all_i = np.concatenate([best[rows], ids], axis=1)
                rank = np.lexsort((np.where(all_i < 0, 1 << 60, all_i), -all_s), axis=1)[:, :k]
                score[rows] = np.take_along_axis(all_s, rank, 1)
                best[rows] = np.take_along_axis(all_i, rank, 1)
        return best, np.where(best >= 0, score, 0.0)


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray  # sorted hashes of words
    idf: np.ndarray
    index: BlockMaxIndex
    ids: np.ndarray
    toxic: np.ndarray
    neighbours: int
    slope: float
    shift: float
    base: float  # rate of toxic documents among those that share no word with an example

    def counts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return term_counts(data, offs, self.vocabulary)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        w = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0) * self.idf
        return w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)

    def vote(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weighted share of toxic neighbours (NaN without any), their positions and cosines."""
        best, score = self.index.search(self.vectors(counts), self.neighbours)
        weight = np.where(best >= 0, 1 / (1 - np.minimum(score, 1) + 0.05), 0.0)
        total = weight.sum(axis=1)
        with np.errstate(invalid="ignore"):
            return np.where(total > 0, (weight * self.toxic[best]).sum(axis=1) / total, np.nan) if len(self.toxic) else np.full(len(counts), np.nan), best, score

    def calibrated(self, vote: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            p = 1 / (1 + np.exp(-(self.slope * vote + self.shift)))
        return np.where(np.isnan(vote), self.base, p)

    def score(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability, positions of the evidence, cosines) of each text."""
        data, offs = string_buffers(texts)
        n = len(offs) - 1
        p, best, cosine = np.full(n, self.base), np.full((n, self.neighbours), -1, np.int64), np.zeros((n, self.neighbours))
        rows, held = [], []
        for lo, hi in spans(offs):
            counts = self.counts(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            some = np.flatnonzero(counts.any(axis=1))
            rows.append(lo + some)
            held.append(counts[some].astype(np.int32))
            if hi == n or sum(map(len, held)) * len(self.vocabulary) > 1 << 23:
                at, counts = np.concatenate(rows), np.concatenate(held)
                rows, held = [], []
                if len(at):  # texts with the same counts share one search
                    _, first, back = np.unique(row_keys(counts), return_index=True, return_inverse=True)
                    vote, found, score = self.vote(counts[first])
                    p[at], best[at], cosine[at] = self.calibrated(vote)[back], found[back], score[back]
        return p, best, cosine


def row_keys(counts: np.ndarray) -> np.ndarray:
    """A number for each row, the same for equal rows only; a hash, or the row's own number if that fails."""
    weights = mix(np.arange(1, counts.shape[1] + 1, dtype=np.uint64))
    key = counts.astype(np.uint64) @ weights
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    return key if (counts == counts[first][back]).all() else np.arange(len(counts))


def term_counts(data: np.ndarray, offs: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Rows x words: how often each word of the vocabulary occurs in each row."""
    n, v = len(offs) - 1, len(vocabulary)
    if not v:
        return np.zeros((n, 0), np.int64)
    _, _, h, first = words(data, offs)
    near = np.zeros(1 << 16, bool)
    near[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(near[(h >> np.uint64(48)).astype(np.int64)])
    term = np.minimum(np.searchsorted(vocabulary, h[at]), v - 1)
    ok = vocabulary[term] == h[at]
    row = np.searchsorted(first, at[ok], side="right") - 1
    return np.bincount(row * v + term[ok], minlength=n * v).reshape(n, v)


def _word_sets(batches):
    """(id, y, text) -> (id, y, hashes): the distinct words of each sampled text with their counts."""
    for batch in batches:
        data, offs = string_buffers(batch.column(2))
        _, _, h, first = words(data, offs)
        out = [np.unique(h[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_pydict({"id": batch.column(0), "y": batch.column(1), "h": pa.array([x.tobytes() for x, _ in out], pa.binary()), "n": pa.array([c.astype(np.int32).tobytes() for _, c in out], pa.binary())})


def independent(sets: list[np.ndarray], alike: float = ALIKE) -> np.ndarray:
    """Marks one of each group of texts whose word sets are alike (Jaccard, found by banded minwise hashes and then computed): many
    copies of one labelled text are one piece of evidence, not many, for what a word says."""
    bands, width = 16, 4
    salts = mix(np.arange(1, bands * width + 1, dtype=np.uint64))
    keep = np.ones(len(sets), bool)
    some = [k for k, s in enumerate(sets) if len(s)]
    if not some:
        return keep
    buckets: dict[tuple[int, int], list[int]] = {}
    for lo in range(0, len(some), 256):  # a part at a time: the driver holds little more than the sample itself
        part = some[lo : lo + 256]
        flat = np.concatenate([sets[k] for k in part])
        starts = np.cumsum([0] + [len(sets[k]) for k in part])[:-1]
        for b in range(bands):
            key = np.zeros(len(part), np.uint64)
            for c in range(width):
                key = mix(key + np.minimum.reduceat(mix(flat + salts[b * width + c]), starts))
            for k, x in zip(part, key.tolist()):
                buckets.setdefault((b, x), []).append(k)
    for group in buckets.values():
        while len(group) > 1:  # the first stands for those like it; the others go on among themselves
            first, rest = group[0], []
            for k in group[1:] if keep[first] else []:
                if keep[k]:
                    shared = len(np.intersect1d(sets[first], sets[k], assume_unique=True))
                    if shared >= alike * (len(sets[first]) + len(sets[k]) - shared):
                        keep[k] = False
                    else:
                        rest.append(k)
            group = rest if keep[first] else group[1:]
    return keep


def evidence(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, per_class: int, alike: float = ALIKE) -> pd.DataFrame:
    """(id, y, h, n) of up to `per_class` labelled documents of each class, by id, near copies of one another within a class counted once; of a
    toxic and a clean text that are alike both stay. Places that copies took are drawn again, in at most `DRAWS` samples."""
    kept: list[pd.DataFrame | None] = [None, None]
    want, taken = [per_class, per_class], [0, 0]
    for _ in range(DRAWS):
        if not any(want):
            break
        sample = labelled_sample(docs, labels, "toxic", tuple(want), text_col, id_col, tuple(taken))
        rows = sample.select("id", "y", "text").mapInArrow(_word_sets, "id bigint, y int, h binary, n binary").toPandas().sort_values("id", ignore_index=True)
        for y in (0, 1):
            new = rows[rows["y"] == y]
            both = new if kept[y] is None else pd.concat([kept[y], new])
            had = 0 if kept[y] is None else len(kept[y])
            kept[y] = both[independent([np.frombuffer(x, np.uint64) for x in both["h"]], alike)].head(per_class)
            missing, rate = per_class - len(kept[y]), (len(kept[y]) - had) / max(1, len(new))
            taken[y] += want[y]
            want[y] = min(per_class, int(np.ceil(missing / max(rate, 0.05)))) if want[y] and len(new) == want[y] else 0
    return pd.concat(kept).sort_values("id", ignore_index=True)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_examples: int = MAX_EXAMPLES, neighbours: int = NEIGHBOURS, chi2: float = CHI2, min_docs: int = MIN_DOCS, alike: float = ALIKE) -> ToxicityModel:
    """The model from at most 2 x `max_examples` labelled documents of each class, near copies of one another in it counted once: by the
    hash of their ids every other one is an example, the others calibrate. Document frequencies count all of `docs`."""
    rows = evidence(docs, labels, text_col, id_col, 2 * max_examples, alike)
    sets = [np.frombuffer(x, np.uint64) for x in rows["h"]]
    y = rows["y"].to_numpy(np.int64)
    turn = (rows["id"].to_numpy(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)).astype(int) if len(rows) else np.zeros(0, int)
    example, held_out = turn == 0, turn == 1
    held = [(np.concatenate([s for s, e, c in zip(sets, example, y) if e and c == label] or [np.zeros(0, np.uint64)])) for label in (0, 1)]
    n0, n1 = int((example & (y == 0)).sum()), int((example & (y == 1)).sum())
    vocabulary, inverse = np.unique(np.concatenate(held), return_inverse=True)
    c0, c1 = (np.bincount(part, minlength=len(vocabulary)).astype(float) for part in (inverse[: len(held[0])], inverse[len(held[0]) :]))
    seen, total = c0 + c1, max(1, n0 + n1)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = total * (c1 * (n0 - c0) - c0 * (n1 - c1)) ** 2 / (seen * (total - seen) * max(n0, 1) * max(n1, 1))
    pick = (seen >= min_docs) & (np.nan_to_num(apart, nan=0.0, posinf=0.0) >= chi2)
    vocabulary = vocabulary[pick]

    df, n_docs = _document_frequencies(docs, text_col, vocabulary)
    model = ToxicityModel(vocabulary, np.log((1 + n_docs) / (1 + df)) + 1, BlockMaxIndex.build(np.zeros((0, len(vocabulary)))), np.zeros(0, np.int64), np.zeros(0), neighbours, 1.0, 0.0, 0.0)
    counts = np.zeros((len(rows), len(vocabulary)), np.int64)
    for k, (s, c) in enumerate(zip(sets, rows["n"])):
        at = np.searchsorted(s, vocabulary)
        hit = np.flatnonzero((at < len(s)) & (s[np.minimum(at, max(0, len(s) - 1))] == vocabulary)) if len(s) else []
        counts[k, hit] = np.frombuffer(c, np.int32)[at[hit]] if len(s) else 0
    use = np.flatnonzero(example & counts.any(axis=1))
    vectors = model.vectors(counts[use])
    order = np.lexsort((rows["id"].to_numpy()[use], y[use], vectors.argmax(axis=1) if len(use) and len(vocabulary) else use))  # alike examples share blocks
    model.index, model.ids, model.toxic = BlockMaxIndex.build(vectors[order]), rows["id"].to_numpy(np.int64)[use][order], y[use][order].astype(float)
    _calibrate(model, counts[held_out], y[held_out])
    return model


def _document_frequencies(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each word occurs, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        total, n = np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            data, offs = string_buffers(batch.column(0))
            n += len(offs) - 1
            for lo, hi in spans(offs):
                total += (term_counts(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], shared.value) > 0).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.arange(-1, len(total)), pa.int32()), "n": pa.array(np.concatenate([[n], total]), pa.int64())})

    rows = docs.select(quoted(text_col)).mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = {r[0]: r[1] for r in rows}
    return np.array([out.get(k, 0) for k in range(len(vocabulary))], float), out.get(-1, 0)


def _calibrate(model: ToxicityModel, counts: np.ndarray, y: np.ndarray) -> None:
    """Logistic scaling of the vote on the held-out sample, both classes weighing the same; and the base rate."""
    some = counts.any(axis=1) if len(counts) else np.zeros(0, bool)
    model.base = float(((y[~some] == 1).sum() + 0.5) / ((~some).sum() + 1)) if len(y) else 0.0
    vote = model.vote(counts[some])[0] if some.any() else np.zeros(0)
    ok = ~np.isnan(vote)
    x, t = np.stack([vote[ok], np.ones(ok.sum())], axis=1), y[some][ok].astype(float)
    w = np.zeros(2) if len(t) and 0 < t.mean() < 1 else np.array([8.0, -4.0])
    if len(t) and 0 < t.mean() < 1:
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 0.05
            w = w - np.clip(np.linalg.solve(h, x.T @ (p - t) + 0.05 * w), -2, 2)
    model.slope, model.shift = float(w[0]), float(w[1])


def toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", reject: float = REJECT, max_examples: int = MAX_EXAMPLES, **how) -> DataFrame:
    """(doc_id, toxicity, is_toxic, evidence) of every row of `docs`.

    `toxicity` is the calibrated probability, `is_toxic` whether there is evidence and it reaches `reject`, `evidence` the examples that voted
    (example_id, similarity, toxic), nearest first; of equal cosines (to 12 places) the one first in the index. The cosine is over the words of the vocabulary:
    those that tell the classes of the labelled sample apart (`chi2`, `min_docs`), counted over the whole text, however long. A text with none of them, a null or
    empty one too, has no evidence, so it isn't called toxic; its `toxicity` is the rate of toxic ones among held-out labelled texts without evidence. Each row is
    scored on its own, so repeated rows and null ids give as many rows. Without labels of both classes nothing is toxic.
    An empty table gives an empty table; further columns aren't read, so their names don't matter.
    """
    docs = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_examples=max_examples, **how))

    def run(batches):
        model = shared.value
        for batch in batches:
            p, best, cosine = model.score(batch.column(1))
            some = best >= 0
            at = best[some]
            evidence = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum(some.sum(axis=1))]).astype(np.int32),
                pa.StructArray.from_arrays([pa.array(model.ids[at]), pa.array(cosine[some]), pa.array(model.toxic[at].astype(np.int32))], ["example_id", "similarity", "toxic"]),
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= reject) & some[:, 0]), evidence], ["doc_id", "toxicity", "is_toxic", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, toxicity double, is_toxic boolean, evidence array<struct<example_id bigint, similarity double, toxic int>>")


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", reject: float = REJECT, max_examples: int = MAX_EXAMPLES, **how) -> DataFrame:
    """The rows of `docs` that `toxicity` doesn't call toxic, all columns unchanged, repeated rows as often as they come. Texts without evidence stay: null and empty
    ones, those without a word of the vocabulary, and all of them where there are no labels of both classes. A tie with `reject` is toxic. An empty
    table stays empty; columns of any name are carried along."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col, id_col, max_examples, **how))

    @F.arrow_udf(T.BooleanType())
    def toxic(texts: pa.Array) -> pa.Array:
        p, best, _ = shared.value.score(texts)
        return pa.array((p >= reject) & (best[:, 0] >= 0))

    return docs.filter(~toxic(quoted(text_col)))
