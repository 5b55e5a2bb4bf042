"""Vector codes and centroid clustering against plain Lloyd's rounds."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.llm import clustering, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label string"


def quantised(rows, scale, fits):
    kept = [r for r in rows if r[1] is not None and fits(len(r[1])) and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(i, [math.floor(scale * x) for x in v], label) for i, v, label in kept]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def nearest(v, centres):
    return min((square(v, c), j) for j, c in enumerate(centres))


def lloyd(vectors, centres, rounds):
    for _ in range(rounds):
        own = [nearest(v, centres)[1] for v in vectors]
        centres = [[sum(x) // len(m) for x in zip(*m, strict=True)] if (m := [v for v, o in zip(vectors, own, strict=True) if o == j]) else c for j, c in enumerate(centres)]
    return [nearest(v, centres) for v in vectors], centres


def plain_clusters(rows, k, rounds, dims):
    kept = quantised(rows, 64, lambda n: n == dims)
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v, _ in kept if i is not None)[:k]
    found, centres = lloyd([v for _, v, _ in kept], [v for _, v in starts], rounds)
    by = [sum(d for d, j in found if j == c) for c in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(r[0], j, d, by[j], sum(by), digest[j]) for r, (d, j) in zip(kept, found, strict=True)]


def plain_codes(rows, parts, entries, rounds):
    kept = quantised(rows, 256, lambda n: n and n % parts == 0)
    lengths = [len(v) for _, v, _ in kept]
    n = max(set(lengths), key=lambda x: (lengths.count(x), x))
    kept = [r for r in kept if len(r[1]) == n]
    s = n // parts
    starts = [v for _, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: r[:2])[:entries]]
    found, books = [], []
    for p in range(parts):
        cut = lambda v, p=p: v[p * s : p * s + s]
        got, centres = lloyd([cut(v) for _, v, _ in kept], [cut(v) for v in starts], rounds)
        found.append(got)
        books += [x for c in centres for x in c]
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    out = [(i, "".join(f"{found[p][r][1]:02x}" for p in range(parts)), sum(found[p][r][0] for p in range(parts)), label) for r, (i, _, label) in enumerate(kept)]
    return [(i, c, e, sum(x[2] for x in out if x[3] == label), digest) for i, c, e, label in out]


def sample(n, dims, seed, spread=0.3):
    """Vectors round a few centres, with ties by coarse values, repeated rows, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (7, dims))
    v = np.round((centres[rng.integers(0, 7, n)] + rng.normal(0, 0.1, (n, dims))) * 16) / 16
    rows = [(int(i) - 20, [float(x) for x in v[i]], [None, "a", "b"][i % 3]) for i in range(n)]
    rows += rows[:9] + [(None, rows[0][1], "a"), (None, rows[5][1], None)]
    bad = [None, [], [0.5] * (dims - 1), [0.1] * (dims + 1), [None] + [0.0] * (dims - 1), [math.nan] * dims, [math.inf] + [0.0] * (dims - 1), [-math.inf] * dims]
    return rows + [(1000 + i, x, "bad") for i, x in enumerate(bad)]


def frame(spark, rows):
    clash = ("v", "cluster", "code", "upper", "lower", "error", "part", "entry", "_key", "name", "near")
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in clash})


@pytest.mark.parametrize(("n", "k", "dims", "rounds"), [(300, 16, 8, 6), (200, 5, 3, 4), (12, 16, 4, 3), (60, 1, 4, 2), (400, 40, 6, 5)])
def test_clusters_against_plain_rounds(spark, n, k, dims, rounds):
    rows = sample(n, dims, n)
    got = clustering.cluster_vectors(frame(spark, rows), k=k, rounds=rounds, dims=dims)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_clusters(rows, k, rounds, dims)))


@pytest.mark.parametrize(("n", "parts", "entries", "width", "rounds"), [(300, 4, 30, 3, 4), (150, 2, 64, 4, 2), (9, 3, 64, 2, 2), (200, 1, 12, 1, 3)])
def test_codes_against_plain_rounds(spark, n, parts, entries, width, rounds):
    rows = sample(n, parts * width, n + 1)
    got = vector_codes.compress(frame(spark, rows), parts=parts, entries=entries, rounds=rounds)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_codes(rows, parts, entries, rounds)))


def test_all_equal_vectors(spark):
    rows = [(i, [0.25] * 4, None) for i in range(40)]
    assert {(r["cluster"], r["distance"]) for r in clustering.cluster_vectors(frame(spark, rows), dims=4).collect()} == {(0, 0)}
    assert {(r["code"], r["label_error"]) for r in vector_codes.compress(frame(spark, rows), parts=2).collect()} == {("0000", 0)}


@pytest.mark.parametrize("rows", [[], [(1, None, "x"), (2, [math.nan] * 4, "x")], [(None, [0.5] * 4, "x")]])
def test_nothing_to_start_from(spark, rows):
    for got in (clustering.cluster_vectors(frame(spark, rows), dims=4), vector_codes.compress(frame(spark, rows), parts=2)):
        assert got.count() == 0


def test_huge_components_are_held(spark):
    rows = [(1, [3e38, -1e300], "x"), (2, [1e300, -3e38], "x"), (3, [0.0, 0.0], "x")]
    got = {r["vec_id"]: r["cluster"] for r in clustering.cluster_vectors(frame(spark, rows), k=2, dims=2).collect()}
    assert got[1] == got[2] != got[3]


def test_bounds_leave_most_vectors_alone():
    """Once centroids hardly move, few rows are compared with any other centroid, and the result is that of full scans."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-400, 400, (20, 6))
    v = np.concatenate([c + rng.integers(-9, 10, (50, 6)) for c in centres])
    old = np.concatenate([centres[:-1] + rng.integers(-3, 4, (19, 6)), centres[-1:]])
    own, d, near, lower, rest = clustering._scan(v, old, 5)
    new = old + rng.integers(-2, 3, old.shape)
    got = clustering.reassign(v, own, np.sqrt(d), near, lower, rest, old, new, 5)
    want = clustering._scan(v, new, 5)
    assert (got[0] == want[0]).all() and (got[5] == 0).mean() > 0.9
    for j in range(5):  # no bound is above what it bounds
        assert (got[3][:, j] <= np.sqrt(((v - new[got[2][:, j]]) ** 2).sum(axis=1))).all()
