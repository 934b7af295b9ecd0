"""Vectorised work on the UTF-8 bytes of a text column inside an Arrow batch.

Everything here works on slices of a batch that hold about ``SLICE`` bytes, so
temporary arrays stay small whatever the batch holds. A text longer than that
is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 17
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_WHITE = frozenset((32, 9, 10, 11, 12, 13))
#: Tables for bytes.translate: 1 where a byte is part of a word. Words end at \x20 and \x09-\x0D ...
BY_SPACE = bytes(i not in _WHITE for i in range(256))
#: ... or at all ASCII that is neither letter nor digit.
BY_PUNCTUATION = bytes(i >= 128 or chr(i).isalnum() for i in range(256))
SPACE = np.array([i in _WHITE for i in range(256)])
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, SLICE + 1)
        p, q = np.full(size, _P, np.uint64), np.full(size, _PINV, np.uint64)
        p[0] = q[0] = 1
        fresh = np.cumprod(p), np.cumprod(q)
        if n > 4 * SLICE:  # a huge text: not kept
            return fresh
        _powers["p"], _powers["q"] = fresh
    return _powers["p"][:n], _powers["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def slices(text: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows; null is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null(b"" if pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type) else "")
    n = len(text)
    if not n:
        return
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, table: bytes = BY_SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and 64-bit hash (A-Z as a-z) of each word; words never cross rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    raw = data.tobytes()
    inside = np.frombuffer(raw.translate(table), bool)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begin[first] = inside[first]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[last] = inside[last]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1, spans_hash(np.frombuffer(raw.translate(_LOWER), np.uint8) if lower else data, s, e)


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of bytes, by differences of one running polynomial."""
    p, q = _power(len(data))
    c = np.zeros(len(data) + 1, np.uint64)
    v = data.astype(np.uint64)
    v += np.uint64(1)
    v *= p
    np.cumsum(v, out=c[1:])
    return mix((c[end] - c[start]) * q[start] + (end - start).astype(np.uint64))
