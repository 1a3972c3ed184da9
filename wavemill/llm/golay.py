"""Fuzzy hashing of 23-bit vectors with the perfect binary Golay code (23, 12, 7).

Every vector is within 3 of exactly one codeword. The codewords within 4 of a vector are that one and,
if it is at distance 3, five more. Two vectors that differ in at most 2 bits have one that differs
from both in at most 1, and its codeword is within 4 of both: so their sets of codewords meet.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BITS, CHECK_BITS = 23, 11
#: Codewords within 4 of a vector, at most.
MOST = 6


def _remainder(v: int) -> int:
    for i in range(BITS - 1, CHECK_BITS - 1, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - CHECK_BITS)
    return v


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    check = np.array([_remainder(m << CHECK_BITS) for m in range(1 << (BITS - CHECK_BITS))], np.uint32)
    found: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    single = [_remainder(1 << i) for i in range(BITS)]
    for weight in range(5):
        for at in combinations(range(BITS), weight):
            s = e = 0
            for i in at:
                s ^= single[i]
                e |= 1 << i
            found[s].append(e)
    errors = np.zeros((1 << CHECK_BITS, MOST), np.uint32)
    for s, es in enumerate(found):
        errors[s, : len(es)] = es
    return check, errors, np.array([len(es) for es in found])


CHECK, ERRORS, COUNTS = _tables()


def codewords(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector (below 2^23): indices (12 bits) of the codewords within 4, and which of the columns count."""
    v = vectors.astype(np.uint32)
    syndrome = CHECK[v >> CHECK_BITS] ^ (v & ((1 << CHECK_BITS) - 1))
    index = (v[:, None] ^ ERRORS[syndrome]) >> CHECK_BITS
    return index, np.arange(MOST)[None, :] < COUNTS[syndrome][:, None]
