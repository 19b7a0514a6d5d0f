"""The binary Golay code of length 23, and keys that two words share when they differ in two bits at most.

The code has 4,096 codewords, any two at distance 7 or more, and every 23-bit word lies within 3 of exactly
one. A word takes all codewords within distance 4 as its keys if its nearest one is at distance 3 (6 keys),
else the nearest one (1 key). Two words at distance 2 or less then always share a key:
- if one of them is within 2 of its codeword c, the other is within 4 of c, and c is one of its keys, for
  being within 2 of another codeword would put two codewords at distance 6;
- if both are at distance 3 or more from theirs, say the first is c + e and the second c + e + f with the
  second more than 4 from c: then f adds two points to e, the one codeword through c + e and the first point
  of f is within 4 of both.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed values of the code: its generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, and its length.
GENERATOR, LENGTH = 0b110001110101, 23
KEYS = 6


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - 11
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of each byte at its place (3 x 256), and for each syndrome 6 error patterns (-1: none)."""
    by_byte = np.array([[_remainder((b << 8 * k) & (1 << LENGTH) - 1) for b in range(256)] for k in range(3)], np.int32)
    patterns = np.full((2048, KEYS), -1, np.int32)
    count = np.zeros(2048, np.int32)
    light = np.zeros(2048, bool)
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            e = sum(1 << b for b in bits)
            s = _remainder(e)
            if not light[s]:
                patterns[s, count[s]] = e
                count[s] += 1
                light[s] = weight < 3
    return by_byte, patterns


def keys(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word its 6 codeword indices, -1 where it has fewer."""
    by_byte, patterns = _tables()
    w = words.astype(np.int32)
    syndrome = by_byte[0][w & 255] ^ by_byte[1][w >> 8 & 255] ^ by_byte[2][w >> 16]
    e = patterns[syndrome]
    return np.where(e < 0, -1, (w[:, None] ^ e) >> 11)
