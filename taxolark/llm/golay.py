"""The binary Golay code [23, 12, 7] as numpy tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, MESSAGE, CHECK = 23, 12, 11


def _remainder(v: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if v >> bit & 1:
            v ^= GENERATOR << (bit - CHECK)
    return v


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of message parts; of each coset the leader; of each coset all patterns of weight 4 or less."""
    remainder = np.array([_remainder(m << CHECK) for m in range(1 << MESSAGE)], dtype=np.int64)
    leader = np.full(1 << CHECK, -1, dtype=np.int64)
    near: list[list[int]] = [[] for _ in range(1 << CHECK)]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            pattern = sum(1 << b for b in bits)
            s = int(pattern & ((1 << CHECK) - 1) ^ remainder[pattern >> CHECK])
            if leader[s] < 0:
                leader[s] = pattern
            near[s].append(pattern)
    patterns = np.full((1 << CHECK, max(map(len, near))), -1, dtype=np.int64)
    for s, found in enumerate(near):
        patterns[s, : len(found)] = found
    return remainder, leader, patterns


_REMAINDER, _LEADER, _PATTERNS = _tables()


def _syndrome(v: np.ndarray) -> np.ndarray:
    return v & ((1 << CHECK) - 1) ^ _REMAINDER[v >> CHECK]


def nearest(v: np.ndarray) -> np.ndarray:
    """The index (message bits) of the one codeword within distance 3 of each word."""
    return (v ^ _LEADER[_syndrome(v)]) >> CHECK


def within_four(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row, codeword index) with the codeword within distance 4: one or six for each word.

    If two words differ in one bit at most, the nearest codeword of one is among
    these of the other (3 + 1 = 4).
    """
    p = _PATTERNS[_syndrome(v)]
    row, col = np.nonzero(p >= 0)
    return row, (v[row] ^ p[row, col]) >> CHECK
