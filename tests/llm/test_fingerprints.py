"""SimHash near duplicates against brute force over all pairs."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagelattice.llm import fingerprints, golay
from tests.llm.test_pairs import frame, roots, words


def plain_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def expected(rows):
    """By row number, as ids repeat."""
    prints = [plain_print(t) for _, t in rows]
    root = roots(range(len(rows)), [(a, b) for a, b in combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    least = {}
    for n, (i, _) in enumerate(rows):
        known = least.get(root[n])
        least[root[n]] = i if known is None else known if i is None else min(i, known)
    return sorted(repr((i, f"{prints[n]:016x}", least[root[n]])) for n, (i, _) in enumerate(rows))


def test_every_word_is_decoded_to_the_only_codeword_within_three_places():
    rng = np.random.default_rng(1)
    codewords = np.array([i << 11 | golay._syndrome(i << 11) for i in range(1 << 12)], np.uint32)
    distinct = np.bitwise_count(codewords[:200, None] ^ codewords[None])
    assert (np.sort(distinct, 1)[:, 1] >= 7).all()
    w = rng.integers(0, 1 << 23, 500).astype(np.uint32)
    assert (np.bitwise_count(codewords[golay.decode(w)] ^ w) <= 3).all()


def test_fingerprints_within_four_places_share_a_key():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    for errors in range(5):
        y = x.copy()
        for i in range(len(y)):
            for p in rng.choice(64, errors, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(p)
        sets = [{(r, k) for r, k in zip(*(v.tolist() for v in golay.keys(side)))} for side in (x, y)]
        assert {r for r, _ in sets[0] & sets[1]} == set(range(len(x)))


def texts():
    rng = np.random.default_rng(8)
    base = words(rng, 400, 5000)
    out = [" ".join(base)] * 5
    for k in range(80):  # edited copies at all distances about the radius
        w = list(base)
        for j in rng.integers(0, 400, 1 + k % 12):
            w[j] = f"x{k}{j}"
        out.append(" ".join(w))
    out += [" ".join(words(rng, int(rng.integers(1, 60)))) for _ in range(60)]
    out += [None, None, "", " \n\t ", "one", "ONE", "one two three", "one two\tthree", "one two three four", "One two three four five", "é É", "É É"]
    out += [" ".join(["again"] * 5000), " ".join(words(rng, 20000, 9000))]
    return out


def test_near_duplicates_equal_brute_force(spark):
    rows = [(i + 10, t) for i, t in enumerate(texts())] + [(11, "another text of an id that is there"), (11, "one"), (None, "one"), (None, "no id and no other row like it")]
    rows += [(200 - i, "w1 w2 w3 w4 w5 w6 w7 copy") for i in range(150)]  # copies hold a third of the rows
    got = [repr((r.doc_id, r.fingerprint, r.component_id)) for r in fingerprints.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got) == expected(rows)


def test_nothing_gives_nothing(spark):
    df = fingerprints.near_duplicates(frame(spark, []))
    assert df.collect() == [] and df.columns == ["doc_id", "fingerprint", "component_id"]


def linked(prints, pairs):
    root = roots(prints, pairs)
    return {p: root[p] for p in prints}


@pytest.mark.parametrize("rows", [4096, 16])
def test_links_of_a_large_crowd(spark, monkeypatch, rows):
    """Fingerprints all about one, so that every key is crowded, with chains and some just too far; also in small blocks."""
    monkeypatch.setattr(fingerprints, "GROUP_ROWS", rows)
    rng = np.random.default_rng(4)
    center, prints = int(rng.integers(0, 2**62)), set()
    for k in range(700):
        p = center
        for place in rng.choice(64, 2 + k % 9, replace=False):
            p ^= 1 << int(place)
        prints.add(p)
    prints |= {int(p) for p in rng.integers(0, 2**63, 300)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    pairs = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]
    found = [(r.a, r.b) for r in fingerprints.links(spark.createDataFrame([(p,) for p in signed], "id long")).collect()]
    assert set(found) <= set(pairs) | {(b, a) for a, b in pairs}
    assert linked(signed, found) == linked(signed, pairs)


def test_hash_is_that_of_the_session(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("one two three four"))).first()[0]
    assert h % (1 << 64) == xxhash.xxh64_intdigest(b"one two three four", 42)
