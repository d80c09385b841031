"""Vectorised text kernels over Arrow string buffers: words, word hashes and shingle hashes in numpy.

All take a batch's UTF-8 bytes as they lie in the Arrow buffer; a word is a run of bytes that are not separators, which
is the same as a run of code points, since every separator is ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_R = 0x9E3779B97F4A7C15
_RI = pow(_R, -1, 1 << 64)
#: Bytes of text handled at once; a longer single document is handled alone, its hashes in slabs of SLAB bytes.
CHUNK, SLAB = 1 << 20, 1 << 21

#: Separators of words `[^\x20\x09-\x0D]+` and of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_pow: dict[str, np.ndarray] = {"p": np.ones(1, U64), "i": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n."""
    if len(_pow["p"]) < n:
        size = max(n, 1 << 16)
        for k, r in (("p", _R), ("i", _RI)):
            a = np.full(size, r, U64)
            a[0] = 1
            _pow[k] = np.cumprod(a, dtype=U64)
    return _pow["p"][:n], _pow["i"][:n]


def forget_powers() -> None:
    """Back to short tables: a long text needs long ones for its own task only."""
    for k in _pow:
        _pow[k] = _pow[k][: 1 << 16].copy()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


class Words:
    """The words of some rows: buf with a space before, between and after them, word starts and ends in it, and for each row the index of its first word."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, a: int, b: int, separators: np.ndarray, lower: bool):
        n = b - a
        raw = data[offsets[a] : offsets[b]]
        at = offsets[a : b + 1] - offsets[a]
        buf = np.insert(raw, at, 0x20)
        if lower:
            buf = LOWER[buf]
        self.buf = buf
        self.row_start = at + np.arange(1, n + 2)
        sep = separators[buf]
        edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1  # begins with a separator and ends with one
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.row_start)
        self.n = n

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; equal words have equal hashes wherever they stand."""
        out = np.empty(len(self.start), U64)
        i = 0
        while i < len(self.start):
            base = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, base + SLAB, "right")))
            part = self.buf[base : int(self.end[j - 1])]
            p, inv = powers(len(part) + 1)
            total = np.zeros(len(part) + 1, U64)
            np.cumsum((part.astype(U64) + U64(1)) * p[:-1], out=total[1:])
            s, e = self.start[i:j] - base, self.end[i:j] - base
            out[i:j] = (total[e] - total[s]) * inv[s] + (e - s).astype(U64)
            i = j
        return mix(out)

    def word(self, i: int, j: int) -> bytes:
        """The bytes from word i to word j, both included, with what stands between them."""
        return self.buf[int(self.start[i]) : int(self.end[j])].tobytes()


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each place on; len(h) - k + 1 of them."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    if k <= 12:
        out = np.zeros(m, U64)
        for j in range(k):
            out = out * U64(_R) + h[j : j + m]
        return mix(out)
    p, inv = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * p[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * inv[:m])
