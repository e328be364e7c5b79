"""Words of Arrow text columns as numpy arrays: boundaries and 64-bit hashes, whole batches at a time.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 these bytes never occur inside
another character, so byte words equal code-point words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: For ``letters``: words are runs of ASCII letters, digits and bytes of other characters.
_NO_LETTER = np.ones(256, dtype=bool)
_NO_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A 64-bit value for each byte, made by rule.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 19)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of a batch: byte bounds into ``data``, the hash of each, and where each text's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # text i has the words first[i] to first[i + 1]
    offset: np.ndarray  # text i has the bytes offset[i] to offset[i + 1]


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one plain string array, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that working memory stays bounded."""
    for batch in batches:
        size = np.diff(_bounds(strings(batch.column(column)))) if batch.num_rows else np.zeros(0)
        total, begin = np.cumsum(size), 0
        while begin < batch.num_rows:
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _bounds(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(column.buffers()[1], dtype=np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def words(column: pa.Array | pa.ChunkedArray, lower: bool = False, letters: bool = False) -> Words:
    """All words of the column. ``lower`` lower-cases A-Z only; ``letters`` parts words at ASCII marks also."""
    column = strings(column)
    n = len(column)
    if not n or column.buffers()[2] is None:
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, np.uint8), none, none, np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64))
    offset = _bounds(column)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offset[0] : offset[-1]]
    offset = offset - offset[0]
    if lower:
        data = _LOWER[data]
    inside = ~(_NO_LETTER if letters else _SPACE)[data]
    opens = np.zeros(len(data) + 1, dtype=bool)  # a text begins here
    opens[offset] = True
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | opens[:-1]))
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | opens[1:])) + 1
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    code = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(data, start, end, code, np.searchsorted(start, offset), offset)


def shingles(code: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` neighbouring words; of the whole sequence if it is shorter; none of none."""
    n = len(code)
    if not n:
        return code
    size = min(size, n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        out = (out ^ code[k : n - size + 1 + k]) * U(_BASE) + (out >> U(29))
    return mix(out + U(size))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def sequences(code: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the word sequence from each ``first`` to before the ``last`` beside it."""
    up, down = _power(len(code) + 1)
    total = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(code * up[: len(code)], out=total[1:])
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
