"""Suffix arrays of a bounded text in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, and anchors that bring equal strings together."""

from __future__ import annotations

import numpy as np

U = np.uint64
_P = U(0xD1342543DE82EF95)
_CHUNK = 1 << 19
_LOW = U((1 << 20) - 1)


def gram_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size``-byte string of a text, by doubling."""
    h = (text.astype(U) + U(77)) * U(0x9E3779B97F4A7C15)
    out, have, width = None, 0, 1
    while True:
        if size & width:
            part = h if out is None else h[have:]
            out, have = (part, width) if out is None else (_joined(out, part), have + width)
        width *= 2
        if width > size:
            break
        h = _joined(h, h[width // 2 :])
    out = (out ^ (out >> U(29))) * U(0xBF58476D1CE4E5B9)
    return out ^ (out >> U(32))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a[: len(b)] * _P
    x ^= x >> U(32)
    x += b[: len(x)]
    return x


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    return np.minimum(v[: len(v) - (width - k)], v[width - k :]) if width > k else v


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, hash, anchor, first, last) of runs: consecutive starts of ``length``-byte strings with one anchor.

    A string's anchor is its least ``gram``-byte piece, the leftmost of equal ones, so equal strings have equal anchors at equal
    distance wherever they are. Every start belongs to exactly one run.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(texts), np.uint8)
    of = np.repeat(np.arange(len(texts)), sizes)
    out: list[tuple] = []
    for base in range(0, max(0, len(text) - length + 1), _CHUNK):
        piece = text[base : base + _CHUNK + length - 1]
        h = gram_hashes(piece, gram)
        key = (h & ~_LOW) | np.arange(len(h), dtype=U)
        at = (sliding_min(key, length - gram + 1) & _LOW).astype(np.int64)
        start = base + np.arange(len(at))
        good = start + length <= ends[of[start]]
        new = np.r_[True, (at[1:] != at[:-1]) | (of[start[1:]] != of[start[:-1]]) | ~good[:-1]] & good
        first = np.flatnonzero(new)
        if not len(first):
            continue
        # A run ends before the next one begins, or where strings stop fitting.
        stop = np.r_[first[1:], len(at)]
        bad = np.r_[0, np.cumsum(~good)]
        last = stop - 1 - (bad[stop] - bad[first])
        doc = of[start[first]]
        begin = ends[doc] - sizes[doc]
        out.append((doc, h[at[first]].view(np.int64), base + at[first] - begin, start[first] - begin, base + last - begin))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` bytes or more.

    Larsson and Sadakane: after the first bytes, only groups of suffixes that are still equal are sorted again, by the rank of the
    suffix as many bytes further on as are already told apart; each round doubles that.
    """
    n = len(text)
    padded = np.r_[text, np.zeros(7, np.uint8)]
    first = np.zeros(n, U)
    for i in range(7):
        first = (first << U(8)) | padded[i : i + n]
    # Seven bytes and how many of them there are, so the end of the text is no zero byte.
    first = (first << U(8)) | np.minimum(n - np.arange(n), 7).astype(U)
    order = np.argsort(first)
    sorted_first = first[order]
    head = np.r_[True, sorted_first[1:] != sorted_first[:-1]]
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group + 1  # 0 is the rank of the empty suffix
    known = 7
    same = np.r_[False, ~head[1:]] | np.r_[~head[1:], False]
    while known < depth and same.any():
        at = np.flatnonzero(same)
        pos = order[at]
        nxt = np.where(pos + known < n, rank[np.minimum(pos + known, n - 1)], 0)
        g = rank[pos]
        key = g * np.int64(n + 2) + nxt
        by = np.argsort(key)
        pos, key, g = pos[by], key[by], g[by]
        order[at] = pos
        head = np.r_[True, key[1:] != key[:-1]]
        rank[pos] = np.maximum.accumulate(np.where(head, at, 0)) + 1
        alone = head & np.r_[head[1:], True]
        same[at] = ~alone
        known *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each entry of ``order`` the common prefix with the entry before it, up to about ``most`` bytes beyond what follows from others.

    Kasai: in the order of the text, a suffix that follows its neighbour's step for step has one byte less in common than the suffix before it; only the
    others, the first of such runs, are compared byte by byte.
    """
    n, m = len(text), len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    listed = np.zeros(n, bool)
    listed[order] = True
    pos = np.flatnonzero(listed & (before >= 0))
    if not len(pos):
        return np.zeros(m, np.int64)
    prev = before[pos]
    head = np.r_[True, (pos[1:] != pos[:-1] + 1) | (prev[1:] != prev[:-1] + 1)]
    runs = np.flatnonzero(head)
    length = np.diff(np.r_[runs, len(pos)])
    i, j, cap = pos[runs], prev[runs], length + most
    common = np.zeros(len(runs), np.int64)
    live = np.arange(len(runs))
    width = 16
    padded = np.r_[text, np.zeros(width, np.uint8)]
    while len(live):
        a, b = i[live] + common[live], j[live] + common[live]
        steps = np.arange(width)
        end = n - np.maximum(a, b)  # bytes left in the later suffix
        equal = padded[np.minimum(a, n)[:, None] + steps] == padded[np.minimum(b, n)[:, None] + steps]
        equal &= steps < np.maximum(end, 0)[:, None]
        more = np.where(equal.all(1), width, np.argmin(equal, 1))
        common[live] += more
        live = live[(more == width) & (common[live] < cap[live])]
    every = np.repeat(common, length) - (np.arange(len(pos)) - np.repeat(runs, length))
    at = np.zeros(n, np.int64)
    at[pos] = np.maximum(every, 0)
    return at[order]


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the starts have a ``length``-byte string that another start has too, and the starts in suffix order with
    the number of their string, for merging with other shards."""
    order = suffix_array(text, length)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = order[wanted[order]]
    equal = common_prefixes(text, order, length) >= length
    if len(equal):
        equal[0] = False
    repeated = np.zeros(len(text), bool)
    repeated[order] = equal | np.r_[equal[1:], False] if len(order) else False
    return repeated, order[~equal]
