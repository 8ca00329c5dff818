"""Words of texts and hashes of word runs, for Arrow batches inside tasks.

A word is a run of ASCII digits, ASCII letters (A-Z lower-cased) and non-ASCII characters, that is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. The rule works byte by byte on
UTF-8, so a batch of texts is handled as one byte array. A slice of texts holds about
``SLICE_BYTES``; a longer text is a slice of its own, hashed in blocks, so memory follows the
longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BLOCK_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1000003)) * _STEP)


_BYTE = numbers(256, 1)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_GRAM = numbers(64, 2) | np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _UP or len(_UP[0]) < n:
        _UP[:] = [_powers(_BASE, n), _powers(_BASE_INV, n)]
    return _UP[0], _UP[1]


@dataclass
class Words:
    """Words of the rows ``lo..hi`` of a batch. ``first[i]`` is the number of the first word of
    row ``lo + i`` and ``rows[i]`` its first byte in ``data`` (lower-cased); ``start`` and ``end``
    are byte positions of the words."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    rows: np.ndarray

    def row(self, i: int) -> bytes:
        """The lower-cased text of row ``lo + i``."""
        return self.data[self.rows[i]:self.rows[i + 1]].tobytes()

    def text(self, a: int, b: int) -> bytes:
        """Words ``a..b`` joined by one space."""
        d, s, e = self.data, self.start, self.end
        return b" ".join(d[s[i]:e[i]].tobytes() for i in range(a, b))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        at = start[i]
        j = max(i + 1, int(np.searchsorted(end, at + BLOCK_BYTES, "right")))
        part = data[at:end[j - 1]]
        up, down = _tables(max(len(part) + 1, BLOCK_BYTES + 1))
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * up[:len(part)], out=total[1:])
        s, e = start[i:j] - at, end[i:j] - at
        out[i:j] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _STEP)
        i = j
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its rows; a null is empty."""
    col = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = (np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None
            else np.zeros(0, dtype=np.uint8))
    return data, offsets


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words_of(column: pa.Array) -> Iterator[Words]:
    data, offsets = text_bytes(column)
    for lo, hi in slices(offsets):
        raw = data[offsets[lo]:offsets[hi]]
        rows = offsets[lo:hi + 1] - offsets[lo]
        inside = IS_WORD[raw]
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[rows] = True
        before = np.zeros(len(raw), dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(raw), dtype=bool)
        after[:-1] = inside[1:]
        start = np.flatnonzero(inside & (~before | cut[:-1]))
        end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        low = LOWER[raw]
        yield Words(lo, hi, low, start, end, _hashes(low, start, end),
                    np.searchsorted(start, rows), rows)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; one for each word that has ``k - 1`` after it."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        out += h[j:j + n] * _GRAM[j]
    return mix64(out)


def lowest(g: np.ndarray, w: int) -> np.ndarray:
    """The smallest of every ``w`` neighbours."""
    n = max(0, len(g) - w + 1)
    out = g[:n].copy()
    for j in range(1, w):
        np.minimum(out, g[j:j + n], out=out)
    return out


def windows_in_rows(first: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the words at which a run of ``size`` words of one row begins."""
    counts = np.maximum(0, np.diff(first) - size + 1)
    total = int(counts.sum())
    at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return at + np.arange(total)
