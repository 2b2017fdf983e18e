"""Words of many texts in flat numpy arrays.

A word is a maximal run of bytes other than space, tab, newline, vertical tab,
form feed and carriage return in the UTF-8 text; case and punctuation count.
Null text has no words. Texts are taken whole: a chunk closes once it holds
``CHUNK_BYTES``, and a longer text is a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE_BASE = 0x9E3779B97F4A7C15 | 5
_WORD_BASE = 0xD1342543DE82EF95 | 5
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def release() -> None:
    """Gives freed memory back to the system: a worker lives on, and its next task may need less."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = (np.full(size, b, dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, len(values) + 1)[0][: len(values)], dtype=np.uint64, out=out[1:])
    return out


class Chunk:
    """Whole texts ``rows`` of a batch; word i is bytes start[i]:end[i] of ``data``,
    and text k has words first[k]:first[k + 1]."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray, rows: range):
        self.data, self.cuts, self.rows = data, cuts, rows
        inside = ~_SPACE[data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        low, high = cuts[:-1][cuts[:-1] < len(data)], cuts[1:][cuts[1:] > 0]
        opens[low] = inside[low]  # words end where their text ends
        closes[high - 1] = inside[high - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.start, self.end = start, end
        self.first = np.searchsorted(start, cuts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text, counted within the chunk, of each word."""
        return np.repeat(np.arange(len(self.rows)), self.counts)

    def words(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        sums = _sums(_BYTE[self.data], _BYTE_BASE)
        down = _powers(_BYTE_BASE, len(self.data) + 1)[1]
        return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def text(self, k: int) -> bytes:
        return self.data[self.cuts[k] : self.cuts[k + 1]].tobytes()


def word_sums(words: np.ndarray) -> np.ndarray:
    """What ``window_at`` needs of the words."""
    return _sums(words, _WORD_BASE)


def window_at(sums: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position in ``at``."""
    down = _powers(_WORD_BASE, len(sums))[1]
    return mix((sums[at + width] - sums[at]) * down[at] + np.uint64(width))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive words, over text boundaries too; empty when there are too few."""
    if len(words) < width:
        return np.zeros(0, dtype=np.uint64)
    sums = word_sums(words)
    n = len(words) - width + 1
    return mix((sums[width:] - sums[:n]) * _powers(_WORD_BASE, len(words) + 1)[1][:n] + np.uint64(width))


def inside(counts: np.ndarray, width: int) -> np.ndarray:
    """Which positions of the flat words start a window that stays in its text."""
    n = int(counts.sum())
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    return left >= width


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1)
        high = min(high, len(texts))
        yield Chunk(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], range(low, high))
        low = high
    release()
