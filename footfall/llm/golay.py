"""The binary Golay code (23, 12, 7) as a fuzzy hash of 23-bit words.

Every word lies within distance 3 of exactly one codeword. Taking as a word's keys all
codewords within distance 4 (one, or six if the nearest is at distance 3), two words
that differ in at most one bit always share a key: the codeword within 3 of the one
is within 4 of the other.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, CHECK_BITS = 23, 11
# Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _syndrome(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the single bits; by syndrome, the error patterns of weight up to 4
    and how many there are."""
    bits = np.array([_syndrome(1 << b) for b in range(LENGTH)], dtype=np.int64)
    errors = np.zeros((1 << CHECK_BITS, 6), dtype=np.int64)
    number = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    for weight in range(5):
        for places in combinations(range(LENGTH), weight):
            at = int(np.bitwise_xor.reduce(bits[list(places)])) if places else 0
            errors[at, number[at]] = sum(1 << p for p in places)
            number[at] += 1
    return bits, errors, number


def codewords_near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word its codewords within distance 4: the positions of the words
    (a word once for each of its codewords) and the 12-bit codeword numbers."""
    bits, errors, number = _tables()
    syndromes = np.zeros(len(words), dtype=np.int64)
    for b in range(LENGTH):
        syndromes ^= (words >> b & 1) * bits[b]
    times = number[syndromes]
    row = np.repeat(np.arange(len(words)), times)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    return row, (words[row] ^ errors[syndromes[row], nth]) >> CHECK_BITS
