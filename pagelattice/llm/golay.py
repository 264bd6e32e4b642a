"""Fuzzy keys of 64-bit fingerprints by the perfect binary Golay code of length 23, in numpy."""

from __future__ import annotations

from itertools import combinations

import numpy as np

# Fixed value of the code: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
# Fingerprint bits of each segment, from the lowest on; the code has 23 places, and those left over are zero.
SEGMENTS = (22, 21, 21)


def _syndrome(word: int) -> int:
    for place in range(22, 10, -1):
        if word >> place & 1:
            word ^= GENERATOR << (place - 11)
    return word


_LOW = np.array([_syndrome(w) for w in range(1 << 12)], np.uint16)
_HIGH = np.array([_syndrome(w << 12) for w in range(1 << 11)], np.uint16)


def _errors() -> np.ndarray:
    """The one error of at most three places behind each of the 2048 syndromes: the code is perfect."""
    out = np.zeros(1 << 11, np.uint32)
    for weight in range(4):
        for places in combinations(range(23), weight):
            word = sum(1 << p for p in places)
            out[_syndrome(word)] = word
    return out


_ERROR = _errors()


def decode(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword nearest to each 23-bit word."""
    words = words.astype(np.uint32)
    return (words ^ _ERROR[_LOW[words & np.uint32(0xFFF)] ^ _HIGH[words >> np.uint32(12)]]) >> np.uint32(11)


def nearby(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of each word and of its neighbours at one place, as (rows x (bits + 1) indices, which are first of their kind).

    Two words that differ in at most two places have a neighbour in common, so they share an index; a word has at most about six.
    """
    flips = np.r_[0, 1 << np.arange(bits)].astype(np.uint32)
    found = np.sort(decode(words.astype(np.uint32)[:, None] ^ flips), axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, first


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) such that two fingerprints that differ in at most four places share a key.

    Four errors fall on three segments. With e1 <= e2 <= e3 errors, either e1 = 0 and e2 <= 2: one segment is equal and another shares a
    codeword index. Or e1 = e2 = 1 and e3 <= 2: two segments have one error each, so one half of each is equal, and the third shares a
    codeword index. A key holds 33 or 34 such bits besides the kind of the case.
    """
    prints = prints.astype(np.uint64)
    shifts = np.r_[0, np.cumsum(SEGMENTS)[:-1]]
    parts = [((prints >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in zip(shifts, SEGMENTS)]
    near = [nearby(p, n) for p, n in zip(parts, SEGMENTS)]
    halves = [(p & 0x7FF, p >> 11) for p in parts]
    rows, out, kind = [], [], 0

    def add(fixed: np.ndarray, k: int) -> None:
        nonlocal kind
        index, first = near[k]
        row, at = np.nonzero(first)
        rows.append(row)
        out.append((np.int64(kind) << np.int64(40)) | (fixed[row] << np.int64(12)) | index[row, at].astype(np.int64))
        kind += 1

    for i in range(3):
        for k in range(3):
            if i != k:
                add(parts[i], k)
    for k in range(3):
        i, j = [x for x in range(3) if x != k]
        for one in halves[i]:
            for two in halves[j]:
                add(one << 11 | two, k)
    return np.concatenate(rows), np.concatenate(out)
