"""Vectorised text kernels: Arrow string buffers in, numpy arrays out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True

_powers: tuple[np.ndarray, np.ndarray] | None = None


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.string()), False
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def spans(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes come to about `limit`; a longer row stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        out = []
        for base in (_MULT, _INV):
            arr = np.full(size, base, np.uint64)
            arr[0] = 1
            out.append(np.multiply.accumulate(arr))
        if n > 8 * CHUNK:  # one giant text: don't keep its tables
            return out[0], out[1]
        _powers = (out[0], out[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on uint64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run [start, end), the same wherever the run lies."""
    up, down = _pow_tables(len(data) + 1)
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, first word index of each row and the total) of the words: runs of
    ASCII letters, digits and non-ASCII bytes, not crossing rows; ASCII case is folded."""
    n = len(data)
    mask = np.zeros(n + 2, np.int8)
    mask[1:-1] = _WORD[data]
    step = np.diff(mask)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # rows that touch: a word never spans a row border
    inner = offs[1:-1]
    if len(inner):
        inner = inner[(inner > 0) & (inner < n)]
        cut = np.unique(inner[(mask[inner] == 1) & (mask[inner + 1] == 1)])
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    hashes = run_hashes(_LOWER[data] if lower else data, starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, offs)


def ragged_gather(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """values[s:s+l] of all (s, l), one after another."""
    total = int(lens.sum())
    if not total:
        return values[:0]
    out_start = np.cumsum(lens) - lens
    return values[np.repeat(starts - out_start, lens) + np.arange(total)]
