"""Centroid clustering and vector codes against plain k-means in integers."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import centroids, codebooks, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(x, c):
    """Nearest entries and squared distances by comparing everything; ties to the smaller number."""
    d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def moved(x, at, c):
    c = c.copy()
    for k in range(len(c)):
        own = x[at == k]
        if len(own):
            c[k] = [int(s) // len(own) for s in own.sum(0)]
    return c


def floors(rows, scale):
    return np.array([[int(np.floor(scale * float(np.float32(c)))) for c in e] for _, e, _ in rows], np.int64)


def planted(dims, rows=300, seed=5):
    """Vectors around a few centers, many of them equal or tied, of coarse values."""
    rng = np.random.default_rng(seed)
    centers = rng.integers(-3, 4, (6, dims))
    values = (centers[rng.integers(0, 6, rows)] + rng.integers(-1, 2, (rows, dims)) * (rng.random((rows, dims)) < 0.2)) / 8
    out = [(i * 3, [float(c) for c in v], None if i % 7 == 0 else i % 3) for i, v in enumerate(values)]
    return out + [(1000 + i, out[0][1], 1) for i in range(150)]  # one vector holds a third of the rows


def odd(dims):
    """Rows that take no part."""
    return [(5000, None, 1), (5001, [None] + [0.0] * (dims - 1), 1), (5002, [float("nan")] * dims, 1), (5003, [float("inf")] * dims, None), (5004, [0.5] * (dims - 1), 1), (5005, [], 1)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.repartition(4).select("*", *[F.lit("x").alias(c) for c in ("cluster", "X", "key", "Vec_ID")])


@pytest.mark.parametrize("k, width, spread", [(1, 3, 2), (2, 3, 2), (7, 4, 2), (40, 8, 3), (40, 16, 400)])
def test_search_finds_what_comparing_everything_finds(k, width, spread):
    rng = np.random.default_rng(k + width)
    x, c = rng.integers(-spread, spread + 1, (800, width)), rng.integers(-spread, spread + 1, (k, width))
    now = centroids.Centroids(c)
    state = centroids.first_search(x, now)
    book = codebooks.Codebook(c)
    held = codebooks.full_search(x, book, min(4, k - 1))
    for turn in range(6):
        at, d = plain(x, now.at)
        assert (state[0] == at).all() and (held.code == at).all()
        others = np.sqrt(((x[:, None, :] - now.at[None]) ** 2).sum(2).astype(float))
        own = others[np.arange(len(x)), at]
        assert (own <= state[2] * (1 + 1e-9)).all() and (own <= held.upper * (1 + 1e-9)).all()
        others[np.arange(len(x)), at] = np.inf
        assert (others.min(1) >= state[3] * (1 - 1e-9)).all() and (others.min(1) >= held.lower.min(1) * (1 - 1e-9)).all()
        c = moved(x, at, now.at) + (rng.integers(-1, 2, (k, width)) if turn == 2 else 0)
        now, book = centroids.Centroids(c, now.at), codebooks.Codebook(c, book.at)
        state = centroids.search(x, *state[:4], now)
        if turn == 3:
            held = held.narrowed(max(1, held.b - 1)) if held.b else held
        held, _ = codebooks.search(x, held, book)


def test_bounds_save_most_distances_of_clustered_vectors():
    rng = np.random.default_rng(9)
    centers = rng.integers(-2000, 2001, (40, 16))
    x = centers[rng.integers(0, 40, 4000)] + rng.integers(-60, 61, (4000, 16))
    now = centroids.Centroids(x[rng.choice(len(x), 40, replace=False)])
    state, taken = centroids.first_search(x, now), 0
    book, used = codebooks.Codebook(now.at), 0
    held = codebooks.full_search(x, book, 6)
    for _ in range(6):
        c = moved(x, plain(x, now.at)[0], now.at)
        now, book = centroids.Centroids(c, now.at), codebooks.Codebook(c, book.at)
        *state, n = centroids.search(x, *state[:4], now)
        held, m = codebooks.search(x, held, book)
        taken, used = taken + n, used + m
    assert taken < 0.25 * 6 * len(x) * 40 and used < 0.25 * 6 * len(x) * 40


def test_single_floats_bound_outwards():
    v = np.random.default_rng(0).random(1000) * 1e6
    assert (codebooks._down(v) < v).all() and (codebooks._up(v) > v).all()
    assert codebooks._down(np.array([np.inf]))[0] > 1e30


def expected_clusters(rows, settings):
    ids, x = [r[0] for r in rows], floors(rows, settings.scale)
    order = sorted((hashlib.sha256(f"{settings.seed}:{i}".encode()).hexdigest(), x[n].tolist()) for n, i in enumerate(ids) if i is not None)
    c = np.array([v for _, v in order[: settings.clusters]], np.int64)
    for _ in range(settings.rounds):
        c = moved(x, plain(x, c)[0], c)
    at, d = plain(x, c)
    sums = [int(d[at == k].sum()) for k in range(len(c))]
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    return sorted((str(i), int(k), int(e), sums[k], int(d.sum()), names[k]) for i, k, e in zip(ids, at, d))


@pytest.mark.parametrize("clusters, dims", [(40, 64), (3, 8), (600, 8), (1, 8)])
def test_clusters_equal_brute_force(spark, clusters, dims):
    settings = centroids.Settings(clusters=clusters, dims=dims)
    rows = planted(dims) + [(3, [0.125] * dims, 1), (3, [0.25] * dims, 1), (None, [0.25] * dims, None)]  # repeated ids and none
    got = [tuple(r) for r in centroids.digest(frame(spark, rows + odd(dims)), settings).collect()]
    assert sorted((str(r[0]), *r[1:]) for r in got) == expected_clusters(rows, settings)


def test_clusters_of_nothing(spark):
    for rows in ([], odd(64), [(None, [0.5] * 64, 1)]):
        df = centroids.digest(spark.createDataFrame(rows, SCHEMA))
        assert df.collect() == [] and df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_very_large_components_are_held_within_the_limit(spark):
    rows = [(0, [3e38] * 64, 1), (1, [-3e38] * 64, 1), (2, [0.5] * 64, 1)]
    got = {r.vec_id: r for r in centroids.digest(spark.createDataFrame(rows, SCHEMA), centroids.Settings(clusters=1)).collect()}
    assert len(got) == 3 and all(r.distance > 0 for r in got.values())
    assert got[0].distance <= 64 * (2 * vectors.LIMIT) ** 2


def expected_codes(rows, settings):
    x = floors(rows, settings.scale)
    first = [i for _, i in sorted(((r[0], x[n].tolist()), n) for n, r in enumerate(rows) if r[0] is not None)][: settings.entries]
    width = settings.dims // settings.parts
    codes, errors, entries = [], 0, []
    for p in range(settings.parts):
        part = x[:, p * width : (p + 1) * width]
        c = part[first]
        for _ in range(settings.rounds):
            c = moved(part, plain(part, c)[0], c)
        at, d = plain(part, c)
        codes.append(at)
        errors = errors + d
        entries += c.ravel().tolist()
    of = {}
    for r, e in zip(rows, errors):
        of[r[2]] = of.get(r[2], 0) + int(e)
    named = hashlib.sha256(",".join(map(str, entries)).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{k:02x}" for k in own), int(e), of[r[2]], named) for r, own, e in zip(rows, np.stack(codes, 1), errors))


@pytest.mark.parametrize("settings", [codebooks.Settings(), codebooks.Settings(parts=2, dims=8, closest=2), codebooks.Settings(parts=2, dims=8, entries=256), codebooks.Settings(parts=4, dims=8, entries=1)])
def test_codes_equal_brute_force(spark, settings):
    dims = settings.dims
    rows = planted(dims) + [(3, [0.125] * dims, 1), (3, [0.25] * dims, 9), (None, [0.25] * dims, None)]
    got = [tuple(r) for r in codebooks.digest(frame(spark, rows + odd(dims)), settings).collect()]
    assert sorted((str(r[0]), *r[1:]) for r in got) == expected_codes(rows, settings)


def test_codes_of_nothing(spark):
    for rows in ([], odd(64), [(None, [0.5] * 64, 1)]):
        df = codebooks.digest(spark.createDataFrame(rows, SCHEMA))
        assert df.collect() == [] and df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
