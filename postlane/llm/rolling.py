"""Hashes of byte spans from one prefix sum, vectorized over whole buffers."""

from __future__ import annotations

import numpy as np

# Odd, and 3 modulo 8: powers of it differ in as many bits as powers of a number can.
BASE = 0x9E3779B97F4A7C1B
BASE_INVERSE = pow(BASE, -1, 1 << 64)
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class SpanHasher:
    """Hash of any span of a buffer as ``sum(value[byte] * BASE^offset)`` modulo 2^64."""

    def __init__(self) -> None:
        self.values = mixed(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
        self.powers = np.ones(1, dtype=U64)
        self.inverses = np.ones(1, dtype=U64)

    def prefixes(self, buffer: np.ndarray) -> np.ndarray:
        """Sums over the buffer's starts, one more than it has bytes."""
        n = len(buffer) + 1
        if len(self.powers) < n:
            size = max(n, 1 << 16)
            for name, base in (("powers", BASE), ("inverses", BASE_INVERSE)):
                steps = np.full(size, base, dtype=U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        sums = np.zeros(n, dtype=U64)
        np.cumsum(self.values[buffer] * self.powers[: n - 1], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.inverses[start]
