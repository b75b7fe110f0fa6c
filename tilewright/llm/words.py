"""Hashes of the words of many texts at once, straight from their UTF-8 bytes."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

_B = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _separators(kind: str) -> np.ndarray:
    sep = np.ones(256, bool)
    if kind == "space":  # words are [^\x20\x09-\x0D]+
        sep[:] = False
        sep[[32, *range(9, 14)]] = True
    else:  # words are runs of ASCII letters, digits and anything beyond ASCII
        for b in (*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)):
            sep[b] = False
    return sep


SEPARATORS = {k: _separators(k) for k in ("space", "sign")}


@functools.cache
def _tables() -> np.ndarray:
    """A random value for each byte; A-Z count as a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_B))
    values[65:91] = values[97:123]
    return values


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            factors = np.ones((2, size + 1), np.uint64)
            factors[0, 1:], factors[1, 1:] = _B, pow(_B, -1, 1 << 64)
            cls.up, cls.down = np.cumprod(factors, axis=1, dtype=np.uint64)
        return cls.up, cls.down


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and the offset of each text; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words start (one longer than the texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATORS[kind][data]
    starts = np.empty(n, bool)
    starts[0], starts[1:] = inside[0], inside[1:] & ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    starts[edges] = inside[edges]
    first = np.flatnonzero(starts)
    up, down = _Powers.upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(np.where(inside, _tables()[data] * up[:n], np.uint64(0)), out=total[1:])
    # Bytes between a word's end and the next start add nothing, so the next start bounds the word.
    after = np.append(first[1:], n)
    return mix((total[after] - total[first]) * down[first]), np.searchsorted(first, offsets)
