"""Centroid clustering against plain Lloyd rounds in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from slotwise.llm import va_kmeans

SCHEMA = "vec_id long, embedding array<double>, cluster string, cells string, h string"


def plain(rows, k, rounds, dims, scale, seed=1):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-va_kmeans.LARGEST, min(va_kmeans.LARGEST, math.floor(scale * x))) for x in v]))
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for c, m in zip(centroids, members, strict=True)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept] if centroids else []
    per = {c: sum(d for _, c2, d in out if c2 == c) for _, c, _ in out}
    return sorted(((i, c, d, per[c], sum(per.values()), tuple(centroids[c])) for i, c, d in out), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA)
    found = va_kmeans.cluster(df, **options)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    return sorted(((*r[:5], tuple(r["centroid"])) for r in found.collect()), key=str)


def vectors(seed, n, dims, groups=4):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    return [(i, [m + rng.gauss(0, 0.3) for m in middles[rng.randrange(groups)]]) for i in range(n)]


@pytest.mark.parametrize(("k", "dims", "bits"), [(4, 6, 2), (16, 64, 5), (3, 2, 1)])
def test_random_vectors(spark, k, dims, bits):
    rows = vectors(k, 300, dims)
    assert run(spark, rows, k=k, dims=dims, bits=bits) == plain(rows, k, 3, dims, 64)


def test_edge_rows(spark):
    rows = vectors(9, 40, 4)
    rows += [(100, None), (101, []), (102, [1.0] * 5), (103, [None, 1.0, 1.0, 1.0]), (104, [math.nan] * 4), (105, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(106, [-0.0] * 4), (107, [1e300, -1e300, 0.0, 0.0]), (None, [0.5] * 4), (None, [0.5] * 4), (7, [9.0, 9.0, 9.0, 9.0]), (7, rows[7][1])]
    rows += [(200 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(30)]
    for k in (1, 5, 500):
        assert run(spark, rows, k=k, dims=4, bits=3) == plain(rows, k, 3, 4, 64)


def test_ties_and_empty_clusters(spark):
    """Equal starting centroids: the smaller number takes all, the other stays empty and as it is."""
    rows = [(i, [1.0, 2.0]) for i in range(10)] + [(50, [3.0, -2.0])]
    assert run(spark, rows, k=8, dims=2) == plain(rows, 8, 3, 2, 64)
    rows = [(i, [x]) for i, x in enumerate([-1.0, 0.0, 1.0, -0.5, 0.5])]
    assert run(spark, rows, k=2, dims=1, rounds=2) == plain(rows, 2, 2, 1, 64)


def test_no_vectors(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, [(None, [1.0, 2.0])], dims=2) == []


def test_intervals_hold_and_save_fetches():
    """Every distance lies in its interval, and few vectors of separate groups are fetched."""
    rng = np.random.default_rng(3)
    middles = rng.integers(-200, 200, (8, 16))
    full = (middles[rng.integers(0, 8, 2000)] + rng.integers(-10, 11, (2000, 16))).astype(np.int32)
    cells = va_kmeans.Cells.fit(full[:500].astype(np.int64), full.min(0).astype(np.int64), full.max(0).astype(np.int64), 5)
    tables = cells.tables(middles)
    low, high = cells.intervals(cells.number(full), tables)
    exact = ((full[:, None, :].astype(np.int64) - middles) ** 2).sum(2)
    assert (low <= exact).all() and (exact <= high).all()
    nearest, fetched = va_kmeans.assign(cells.number(full), full, middles, tables)
    assert (nearest == exact.argmin(1)).all() and len(fetched) < 100
