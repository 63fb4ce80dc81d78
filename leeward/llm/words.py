"""Whole texts as byte arrays: words, hashes of words and of runs of words, without a Python loop per word.

A word is a run of bytes other than space and 0x09-0x0D, which is the same as ``[^\\x20\\x09-\\x0D]+``
over characters, since those bytes occur in no longer UTF-8 sequence. Hashes are polynomials modulo
2**64 (Rabin-Karp): with prefix sums, the hash of any run costs one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE = 1 << 21                     # bytes of text worked on at once; one longer text is one piece

_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and the inverses, modulo 2**64. Short tables are kept."""
    kept = _POWERS.get(int(base))
    if kept is None or len(kept[0]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        kept = np.cumprod(up), np.cumprod(down)
        if size <= 2 * PIECE:
            _POWERS[int(base)] = kept
    return kept


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Piece:
    """Consecutive rows of a batch: ``data`` bytes, ``offsets`` of the texts in it, ``first`` row number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row]:self.offsets[row + 1]].tobytes()

    def words(self, lower: bool = False) -> "Words":
        return Words(LOWER[self.data] if lower else self.data, self.offsets)


class Words:
    """Words of a piece: byte range of each, and ``first[d]:first[d + 1]`` the words of text ``d``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        inside = ~SPACE[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        before[cuts] = False
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        after[ends] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word, worked out over stretches of about a megabyte."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + (1 << 20), side="right")))
            piece = _BYTE[self.data[base:self.ends[to - 1]]]
            up, down = powers(BASES[0], len(piece))
            sums = np.empty(len(piece) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(piece * up[:len(piece)], out=sums[1:])
            s, e = self.starts[at:to] - base, self.ends[at:to] - base
            out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            at = to
        return out


def runs(hashes: np.ndarray, first: np.ndarray, width: int, base: np.uint64 = BASES[1]) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every run of ``width`` items that lies inside one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = powers(base, len(hashes))
    sums = np.empty(len(hashes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * up[:len(hashes)], out=sums[1:])
    ok = np.ones(n, bool)
    for k in range(1, width):                       # a run that starts less than width before a cut crosses it
        cut = first[1:-1] - k
        ok[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(ok)
    return at, mix((sums[at + width] - sums[at]) * down[at] + np.uint64(width))


def rows_of(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text in which each position lies."""
    return np.searchsorted(first, at, side="right") - 1


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[Piece]:
    """Cut a string column into pieces of at most ``limit`` bytes; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, len(column))
        yield Piece(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], at)
        at = to
