"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

U = np.uint64
_P, _Q = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)


class _Words(dict):
    """Hash of each distinct word, kept up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


_WORDS = _Words()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * _Q
    return h ^ (h >> U(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text whose A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    return np.fromiter(map(_WORDS.__getitem__, words), U, len(words))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive entries."""
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = mix(out * _P + h[j : len(h) - n + 1 + j])
    return out


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct n-word shingles; with fewer words the whole sequence as one; none without words."""
    h = word_hashes(text)
    if not len(h):
        return h
    return np.unique(rolled(h, n) if len(h) >= n else rolled(h, len(h)) + U(len(h)))


def shingle_sets(texts: list, n: int = 5) -> list[np.ndarray]:
    return [shingle_set(t, n) for t in texts]


def parts(texts: list, chars: int = 2_000_000) -> Iterator[slice]:
    """Consecutive slices of about so many characters."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size < chars):
            size += len(texts[stop] or "")
            stop += 1
        yield slice(start, stop)
        start = stop


def multipliers(n: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * U(2) + U(1)


def minhashes(sets: list[np.ndarray], a: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """rows x len(a) minima of a * x modulo 2**64; rows of empty sets are 0."""
    out = np.zeros((len(sets), len(a)), U)
    full = [i for i, s in enumerate(sets) if len(s)]
    start = 0
    while start < len(full):
        stop, size = start, 0
        while stop < len(full) and (stop == start or size + len(sets[full[stop]]) <= chunk):
            size += len(sets[full[stop]])
            stop += 1
        own = full[start:stop]
        x = np.concatenate([sets[i] for i in own])
        begins = np.r_[0, np.cumsum([len(sets[i]) for i in own])][:-1]
        buffer = np.empty_like(x)
        for c, m in enumerate(a):
            np.multiply(x, m, out=buffer)
            out[own, c] = np.minimum.reduceat(buffer, begins)
        start = stop
    return out
