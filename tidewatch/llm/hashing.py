"""Polynomial hashes of byte slices in numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer of 64-bit words; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PrefixHash:
    """Prefix sums of one byte block, so that the hash of any slice costs O(1)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * power[:n], out=self.sums[1:])
        inverse = np.full(n + 1, _BASE_INV, np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def byte_runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], member, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def join_bytes(bodies: list[bytes], gap: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """All bodies in one byte block, each closed by ``gap``, and the n+1 start offsets."""
    data = np.frombuffer(gap.join(bodies) + gap, np.uint8)
    return data, np.r_[0, np.cumsum([len(b) + len(gap) for b in bodies])].astype(np.int64)


def blocks(bodies, limit: int):
    """Slices (lo, hi) of the list whose bytes stay under ``limit``; a longer body stands alone."""
    lo = held = 0
    for i, b in enumerate(bodies):
        if held and held + len(b) > limit:
            yield lo, i
            lo, held = i, 0
        held += len(b)
    if lo < len(bodies):
        yield lo, len(bodies)
