"""A wavelet matrix over token ids: bit planes with rank directories.

Plane 0 holds the highest bit of every id in text order. Each next plane holds
the next bit after a stable partition by the bit before (zeros first). A
directory of ones before every 512-bit block makes rank a look-up and one
block's bits; from it follow access, counting and the n-th occurrence.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512


def _bits(plane: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(plane, count=n).view(bool)


class WaveletMatrix:
    def __init__(self, n: int, planes: np.ndarray, zeros: np.ndarray, ranks: np.ndarray):
        """planes: (levels, bytes) packed bits; zeros: per level; ranks: (levels, blocks + 1) ones before a block."""
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        n = len(ids)
        row = -(-max(n, 1) // BLOCK) * (BLOCK // 8)
        planes = np.zeros((levels, row), np.uint8)
        zeros = np.zeros(levels, np.int64)
        now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        for k in range(levels):
            bit = ((now >> now.dtype.type(levels - 1 - k)) & now.dtype.type(1)).astype(np.uint8)
            packed = np.packbits(bit)
            planes[k, : len(packed)] = packed
            one = bit.view(bool)
            low = now[~one]
            zeros[k] = len(low)
            now = np.concatenate([low, now[one]])
        ones = np.bitwise_count(planes.reshape(levels, -1, BLOCK // 8)).sum(axis=2, dtype=np.uint32)
        ranks = np.zeros((levels, ones.shape[1] + 1), np.uint32)
        np.cumsum(ones, axis=1, out=ranks[:, 1:])
        return cls(n, planes, zeros, ranks)

    def to_fields(self) -> dict:
        return {
            "n_tokens": self.n, "levels": len(self.zeros), "planes": self.planes.tobytes(),
            "zeros": self.zeros.tolist(), "ranks": self.ranks.astype("<u4").tobytes(),
        }

    @classmethod
    def from_fields(cls, row: dict) -> WaveletMatrix:
        levels = row["levels"]
        return cls(
            row["n_tokens"], np.frombuffer(row["planes"], np.uint8).reshape(levels, -1),
            np.asarray(row["zeros"], np.int64), np.frombuffer(row["ranks"], "<u4").reshape(levels, -1),
        )

    def rank1(self, k: int, i: np.ndarray) -> np.ndarray:
        """Ones of plane k before each position of i."""
        i = np.asarray(i, np.int64)
        block, rest = i // BLOCK, i % BLOCK
        wide = np.concatenate([self.planes[k], np.zeros(BLOCK // 8, np.uint8)]).reshape(-1, BLOCK // 8)[block]
        ahead = np.unpackbits(wide, axis=1).astype(np.int64)
        inside = (ahead * (np.arange(BLOCK) < rest[:, None])).sum(axis=1)
        return self.ranks[k, block].astype(np.int64) + inside

    def _bit(self, k: int, i: np.ndarray) -> np.ndarray:
        return (self.planes[k, i // 8] >> (7 - i % 8).astype(np.uint8)) & 1

    def access(self, i) -> np.ndarray:
        """The ids at positions i."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        out = np.zeros(len(i), np.int64)
        for k, z in enumerate(self.zeros):
            bit = self._bit(k, i)
            ones = self.rank1(k, i)
            i = np.where(bit, z + ones, i - ones)
            out = out * 2 + bit
        return out

    def _bounds(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's run starts in the last order, and how far position i falls into it."""
        levels, start = len(self.zeros), 0
        if token >> levels:
            return 0, 0
        for k, z in enumerate(self.zeros):
            a, b = self.rank1(k, np.array([start, i]))
            if token >> (levels - 1 - k) & 1:
                start, i = int(z + a), int(z + b)
            else:
                start, i = int(start - a), int(i - b)
        return start, i - start

    def count(self, token: int, before: int | None = None) -> int:
        """Occurrences of the token (before a position)."""
        return self._bounds(token, self.n if before is None else before)[1]

    def _select(self, k: int, bit: int, which: np.ndarray) -> np.ndarray:
        """Position of the which-th (from 0) bit of that value in plane k."""
        edges = self.ranks[k].astype(np.int64)
        if not bit:
            edges = np.arange(len(edges)) * BLOCK - edges
        block = np.searchsorted(edges, which, side="right") - 1
        rows = np.unpackbits(self.planes[k].reshape(-1, BLOCK // 8)[block], axis=1) == bit
        seen = np.cumsum(rows, axis=1)
        return block * BLOCK + (seen > (which - edges[block])[:, None]).argmax(axis=1)

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of the token, ascending: its run in the last order, led back plane by plane."""
        start, many = self._bounds(token, self.n)
        at = start + np.arange(many)
        for k in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at) if many else at
        return np.sort(at)

    def decode(self) -> np.ndarray:
        """All ids in order."""
        levels = len(self.zeros)
        now = np.zeros(self.n, np.uint16 if levels <= 16 else np.uint32)
        for k in range(levels - 1, -1, -1):
            one, up = _bits(self.planes[k], self.n), np.empty_like(now)
            z = self.zeros[k]
            up[~one] = now[:z]
            up[one] = now[z:] | now.dtype.type(1 << (levels - 1 - k))
            now = up
        return now
