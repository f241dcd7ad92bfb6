"""Byte-level BPE over numpy matrices.

Texts are cut by the vocabulary's pattern. The distinct pieces of a batch become rows of padded matrices, bucketed by
length; in each round every row merges its leftmost pair of minimum rank, found in a hash table of pairs, closes the gap, and rows
without a pair left drop out of the matrix.
"""

from __future__ import annotations

import base64
import heapq
import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sedimenta.llm.common import quoted
from sedimenta.llm.textkit import ragged_gather, spans, string_buffers

VOCABULARY = os.environ.get("SEDIMENTA_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
WIDEST = 2048  # longer pieces keep their pairs in a heap instead of a matrix row: the same merges
CACHE = 300_000


@dataclass
class Bpe:
    ranks: dict[bytes, int]
    pattern: str = PATTERN
    byte_id: np.ndarray = field(init=False)
    keys: np.ndarray = field(init=False)
    vals: np.ndarray = field(init=False)
    size: int = field(init=False)

    def __post_init__(self) -> None:
        self.size = max(self.ranks.values()) + 1
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        pairs = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self._fill(pairs, np.array(rank, np.int32))
        order = sorted(self.ranks.items(), key=lambda x: x[1])
        pieces = {r: t for t, r in order}
        texts = [pieces.get(r, "�".encode()) for r in range(self.size)] + ["�".encode()]
        self.token_len = np.array([len(t) for t in texts], np.int64)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.split = None
        self._reset()

    @classmethod
    def load(cls, path: str = VOCABULARY, pattern: str = PATTERN) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "pattern": self.pattern}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    # -------------------------------------------------- the table of pairs

    def _fill(self, pairs: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing with linear probing; every free place takes the first of the pairs that want it."""
        self.bits = int(np.ceil(np.log2(max(2, len(pairs))))) + 2
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        at, left = self._slot(pairs), np.arange(len(pairs))
        self.longest = 1
        while len(left):
            free = self.keys[at] == np.uint64(2**64 - 1)
            place, who = np.unique(at[free], return_index=True)
            winners = np.flatnonzero(free)[who]
            self.keys[place], self.vals[place] = pairs[left[winners]], ranks[left[winners]]
            keep = np.ones(len(left), bool)
            keep[winners] = False
            left, at = left[keep], (at[keep] + 1) & ((1 << self.bits) - 1)
            self.longest += bool(len(left))

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of ids, NONE where they don't merge or one of them is -1."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        key = (left.astype(np.int64).view(np.uint64) << np.uint64(32)) | (right.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF))
        out = np.full(len(key), NONE, np.int32)
        at = self._slot(key)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = at[todo]
        for _ in range(self.longest):
            got = self.keys[at]
            hit = got == key[todo]
            out[todo[hit]] = self.vals[at[hit]]
            go = ~hit & (got != np.uint64(2**64 - 1))
            if not go.any():
                break
            todo, at = todo[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)

    # -------------------------------------------------- merging

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and how many each has."""
        n = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.cumsum(lens) - lens
        results: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (rows, lengths, flat ids)
        bucket = np.ceil(np.log2(np.maximum(lens, 1))).astype(int)
        for b in np.unique(bucket):
            rows = np.flatnonzero((bucket == b) & (lens > 0) & (lens <= WIDEST))
            step = max(1, (1 << 20) >> max(0, int(b)))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                width = int(lens[part].max())
                col = np.arange(width)
                inside = col < lens[part][:, None]
                m = np.where(inside, self.byte_id[raw[np.minimum(starts[part][:, None] + col, len(raw) - 1)]], np.int32(-1))
                results += self._rounds(part, m, lens[part])
        for row in np.flatnonzero(lens > WIDEST):
            ids = self._heap(raw[starts[row] : starts[row] + lens[row]])
            results.append((np.array([row]), np.array([len(ids)]), ids))
        count = np.zeros(n, np.int64)
        if not results:
            return np.zeros(0, np.int32), count
        all_rows = np.concatenate([r[0] for r in results])
        all_lens = np.concatenate([r[1] for r in results])
        flat = np.concatenate([r[2] for r in results])
        count[all_rows] = all_lens
        where = np.zeros(n, np.int64)
        where[all_rows] = np.cumsum(all_lens) - all_lens
        return ragged_gather(flat, where, count), count

    def _rounds(self, rows: np.ndarray, m: np.ndarray, lens: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        lens = lens.copy()
        rank = self.rank_of(m[:, :-1], m[:, 1:]) if m.shape[1] > 1 else np.zeros((len(m), 0), np.int32)
        while len(rows):
            if rank.shape[1] == 0:
                live = np.zeros(len(rows), bool)
            else:
                pos = rank.argmin(axis=1)  # the first of equal ones: the leftmost
                best = rank[np.arange(len(rows)), pos]
                live = best != NONE
            if not live.all():
                done = ~live
                inside = np.arange(m.shape[1]) < lens[done][:, None]
                out.append((rows[done], lens[done], m[done][inside]))
                if not live.any():
                    break
                rows, m, rank, lens, pos, best = rows[live], m[live], rank[live], lens[live], pos[live], best[live]
            lens -= 1
            width = m.shape[1] - 1
            col = np.arange(width)
            at = np.arange(len(rows))
            after = col > pos[:, None]
            m = np.where(after, m[:, 1:], m[:, :-1])
            m[at, pos] = best
            rank = np.where(col[:-1] > pos[:, None] - 1, rank[:, 1:], rank[:, :-1]) if width > 1 else np.zeros((len(rows), 0), np.int32)
            if width > 1:
                has_right = pos < width - 1
                rank[at[has_right], pos[has_right]] = self.rank_of(m[at[has_right], pos[has_right]], m[at[has_right], pos[has_right] + 1])
                has_left = pos > 0
                rank[at[has_left], pos[has_left] - 1] = self.rank_of(m[at[has_left], pos[has_left] - 1], m[at[has_left], pos[has_left]])
            widest = int(lens.max())
            if widest < m.shape[1]:
                m, rank = m[:, :widest], rank[:, : max(0, widest - 1)]
        return out

    def _heap(self, raw: np.ndarray) -> np.ndarray:
        ids = self.byte_id[raw].tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.rank_of(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), int(i)) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        current = {i: r for r, i in heap}

        def pair(i: int) -> None:
            j = nxt[i]
            current.pop(i, None)
            if j < n:
                r = self.pair_rank(ids[i], ids[j])
                if r is not None:
                    current[i] = r
                    heapq.heappush(heap, (r, i))

        alive = [True] * n
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or current.get(i) != r:
                continue
            j = nxt[i]
            ids[i], nxt[i], alive[j] = r, nxt[j], False
            current.pop(j, None)
            if nxt[i] < n:
                prv[nxt[i]] = i
            pair(i)
            if prv[i] >= 0:
                pair(prv[i])
        return np.array([t for t, a in zip(ids, alive) if a], np.int32)

    def pair_rank(self, a: int, b: int) -> int | None:
        r = int(self.rank_of(np.array([a]), np.array([b]))[0])
        return None if r == NONE else r

    # -------------------------------------------------- texts

    def _reset(self) -> None:
        self.cache: dict[str, int] = {}
        self.store = np.zeros(0, np.int32)
        self.store_start, self.store_len = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has. Control strings are text like any."""
        if self.split is None:
            self.split = regex.compile(self.pattern).findall
        if len(self.cache) > CACHE:
            self._reset()
        pieces: list[str] = []
        ends = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            pieces += self.split(t)
            ends[k] = len(pieces)
        new = [w for w in dict.fromkeys(pieces) if w not in self.cache]
        if new:
            ids, count = self.merge([w.encode() for w in new])
            base = len(self.store_len)
            self.cache.update(zip(new, range(base, base + len(new))))
            self.store_start = np.concatenate([self.store_start, len(self.store) + np.cumsum(count) - count])
            self.store_len = np.concatenate([self.store_len, count])
            self.store = np.concatenate([self.store, ids])
        at = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
        lens = self.store_len[at]
        total = np.concatenate([[0], np.cumsum(lens)])
        return ragged_gather(self.store, self.store_start[at], lens), np.diff(total[ends], prepend=0)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> pa.Array:
        """Texts of the ids; an id out of the vocabulary and bytes that aren't UTF-8 become U+FFFD."""
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size).astype(np.int64)
        lens = self.token_len[ids]
        raw = ragged_gather(self.token_bytes, self.token_start[ids], lens).tobytes()
        total = np.concatenate([[0], np.cumsum(lens)])
        offs = total[np.concatenate([[0], np.cumsum(count)])]
        try:
            raw.decode()
            starts = np.frombuffer(raw, np.uint8)[np.minimum(offs[1:-1], max(0, len(raw) - 1))] if len(offs) > 2 and raw else np.zeros(0, np.uint8)
            clean = not ((starts & 0xC0) == 0x80).any()  # no text starts within a character
        except UnicodeDecodeError:
            clean = False
        if clean and len(raw) < 2**31:
            return pa.Array.from_buffers(pa.string(), len(count), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(raw)])
        return pa.array([raw[a:b].decode(errors="replace") for a, b in zip(offs[:-1], offs[1:])], pa.string())


def encode_decode(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids, n_tokens, decoded): the text's token ids and the text that these decode to.

    The ids are those of the rank file at `path`; strings of control tokens in a text are ordinary text. An empty text has no
    tokens; a null text has null in all three columns. A text is one unit however long, and so is a piece of it without a
    break. Each row stands on its own, so repeated rows and null ids give as many rows; an empty table gives an
    empty table; further columns aren't read, so their names don't matter.
    """
    docs = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Bpe.load(path))

    def run(batches):
        bpe = shared.value
        for batch in batches:
            column = batch.column(1)
            _, offs = string_buffers(column)
            for lo, hi in spans(offs):
                part = column.slice(lo, hi - lo)
                null = np.asarray(part.is_null())
                ids, count = bpe.encode(part.fill_null("").to_pylist() if null.any() else part.to_pylist())
                mask = pa.array(null) if null.any() else None
                decoded = bpe.decode(ids, count)
                at = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                tokens = pa.ListArray.from_arrays(at, pa.array(ids), mask=mask)
                if mask is not None:
                    import pyarrow.compute as pc

                    decoded = pc.if_else(mask, pa.scalar(None, pa.string()), decoded)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), tokens, pa.array(count.astype(np.int32), mask=null), decoded], ["doc_id", "token_ids", "n_tokens", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, token_ids array<int>, n_tokens int, decoded string")
