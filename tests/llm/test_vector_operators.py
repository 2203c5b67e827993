"""Clustering and product codes: brute force with all distances, ties, odd rows, bounds."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import _vectors, vector_codes, yinyang

SCHEMA = "vec_id long, embedding array<float>, label int"


def floors(v, scale):
    return [math.floor(float(np.float32(x)) * scale) for x in v]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def rows_of(seed, n, dim, spread=1.0, hot=0.3):
    rng = random.Random(seed)
    same = [rng.gauss(0, spread) for _ in range(dim)]
    middles = [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(6)]
    out = []
    for i in range(n):
        m = rng.choice(middles)
        out.append((i, same if rng.random() < hot else [x + rng.gauss(0, spread / 5) for x in m], i % 4 or None))
    return out


def brute_clusters(rows, k, rounds, scale, dim):
    given = [(i, v) for i, v, _ in rows if v is not None and len(v) == dim and good(v)]
    first = sorted(given, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    kept = [(i, floors(v, scale)) for i, v in given]
    centroids = [floors(v, scale) for _, v in first]
    for _ in range(rounds):
        at = [min(range(len(centroids)), key=lambda c: (square(x, centroids[c]), c)) for _, x in kept]
        for c in range(len(centroids)):
            own = [x for (_, x), a in zip(kept, at, strict=True) if a == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = [min(range(len(centroids)), key=lambda c: (square(x, centroids[c]), c)) for _, x in kept]
    d = [square(x, centroids[a]) for (_, x), a in zip(kept, at, strict=True)]
    fit = lambda n: n if n < 1 << 63 else None
    out = []
    for (i, _), a, own in zip(kept, at, d, strict=True):
        inertia = sum(x for x, b in zip(d, at, strict=True) if a == b)
        out.append((i, a, fit(own), fit(inertia), fit(sum(d)), hashlib.sha256(",".join(map(str, centroids[a])).encode()).hexdigest()))
    return sorted(map(repr, out))


def got_clusters(df, **options):
    return sorted(repr((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in yinyang.cluster(df, **options).collect())


ODD = [(900, None, 1), (901, [], 1), (902, [1.0] * 5, 2), (903, [float("nan")] * 6, 1), (904, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 1), (905, [None, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (906, [0.0] * 7, None), (7, [0.25] * 6, 3), (7, [-0.25] * 6, 3)]


@pytest.mark.parametrize("scale", [64, 2])
def test_clusters_equal_brute_force(spark, scale):
    """With scale 2 integers are small, so that many distances are equal."""
    rows = rows_of(scale, 400, 6) + ODD
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("x", F.lit("own")).withColumn("a", F.lit(1))
    assert got_clusters(df, clusters=7, rounds=3, scale=scale, dim=6) == brute_clusters(rows, 7, 3, scale, 6)


def test_clusters_of_few_and_of_no_vectors(spark):
    rows = rows_of(3, 4, 6)
    assert got_clusters(spark.createDataFrame(rows, SCHEMA), clusters=7, scale=64, dim=6) == brute_clusters(rows, 7, 3, 64, 6)
    for empty in ([], ODD[:3]):
        got = yinyang.cluster(spark.createDataFrame(empty, SCHEMA), dim=6)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert got.collect() == []


def test_clusters_of_rows_without_id_and_of_huge_numbers(spark):
    rows = rows_of(5, 60, 6) + [(None, [3.0] * 6, 1), (800, [3e38] * 6, 1), (801, [-3e38] * 6, 1), (802, [1e9, -1e9, 1e12, 0.0, 0.0, 1.0], 2)]
    assert got_clusters(spark.createDataFrame(rows, SCHEMA).repartition(2), clusters=40, scale=64, dim=6) == brute_clusters(rows, 40, 3, 64, 6)


def test_bounds_spare_distances_and_change_nothing():
    rng = np.random.default_rng(1)
    middles = rng.integers(-3000, 3000, (40, 12))
    x = middles[rng.integers(0, 40, 3000)] + rng.integers(-40, 40, (3000, 12))
    c = x[:40].copy()
    group = yinyang.group_centroids(c)
    assert len(group) == 40 and group.max() <= 9
    a, upper, lower = yinyang.full_scan(x, c, group)
    spared = []
    for _ in range(8):
        new = np.stack([np.floor_divide(x[a == k].sum(axis=0), (a == k).sum()) if (a == k).any() else c[k] for k in range(40)])
        moved = np.sqrt(((new - c) ** 2).sum(axis=1)) * (1 + yinyang.MARGIN)
        c = new
        a, upper, lower, taken = yinyang.filtered_scan(x, a, upper, lower, c, moved, group)
        squares = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (a == squares.argmin(axis=1)).all()
        exact = np.sqrt(squares)
        assert (upper >= exact[np.arange(len(x)), a]).all()
        exact[np.arange(len(x)), a] = np.inf
        assert all((lower[:, g] <= exact[:, group == g].min(axis=1)).all() for g in range(group.max() + 1))
        spared.append(taken / squares.size)
    assert spared[-1] < 0.1


def test_equal_bounds_are_scanned():
    """A vector between two centroids that come to be equally far goes to the smaller number."""
    x = np.array([[0, 0]])
    group = np.array([0, 1])
    c = np.array([[-7, 0], [5, 0]])
    a, upper, lower = yinyang.full_scan(x, c, group)
    assert a.tolist() == [1]
    after = np.array([[-5, 0], [5, 0]])
    a, *_ = yinyang.filtered_scan(x, a, upper, lower, after, np.array([2.0, 0.0]) * (1 + yinyang.MARGIN), group)
    assert a.tolist() == [0]


def brute_codes(rows, parts, entries, rounds, scale, dim):
    kept = [(i, floors(v, scale), label) for i, v, label in rows if good(v) and len(v) == dim]
    width = dim // parts
    piece = lambda x, p: x[p * width : (p + 1) * width]
    first = sorted((r for r in rows if good(r[1]) and len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[piece(floors(v, scale), p) for _, v, _ in first] for p in range(parts)]
    near = lambda q, book: min(range(len(book)), key=lambda e: (square(q, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            at = [near(piece(x, p), books[p]) for _, x, _ in kept]
            for e in range(len(first)):
                own = [piece(x, p) for (_, x, _), a in zip(kept, at, strict=True) if a == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = []
    for i, x, label in kept:
        at = [near(piece(x, p), books[p]) for p in range(parts)]
        out.append([i, "".join(f"{a:02x}" for a in at), sum(square(piece(x, p), books[p][a]) for p, a in enumerate(at)), label])
    fit = lambda n: n if n < 1 << 63 else None
    totals = {label: sum(r[2] for r in out if r[3] == label) for label in {r[3] for r in out}}
    return sorted(repr((i, code, fit(error), fit(totals[label]), digest)) for i, code, error, label in out)


def got_codes(df, **options):
    return sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in vector_codes.quantise(df, **options).collect())


@pytest.mark.parametrize("scale", [256, 1])
def test_codes_equal_brute_force(spark, scale):
    """With scale 1 most entries are equal or equally far."""
    rows = rows_of(scale, 300, 6) + ODD
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("part", F.lit("own")).withColumn("code", F.lit(1))
    assert got_codes(df, parts=3, entries=20, rounds=2, scale=scale) == brute_codes(rows, 3, 20, 2, scale, 6)


def test_codes_of_few_no_and_huge_vectors(spark):
    rows = rows_of(3, 4, 6) + [(None, [2.0] * 6, None)]
    assert got_codes(spark.createDataFrame(rows, SCHEMA), parts=3, entries=20) == brute_codes(rows, 3, 20, 2, 256, 6)
    for empty in ([], [r for r in ODD if not good(r[1]) or not r[1]]):
        got = vector_codes.quantise(spark.createDataFrame(empty, SCHEMA), parts=3)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert got.collect() == []
    rows = rows_of(5, 40, 6) + [(800, [3e38] * 6, 1), (801, [-3e38] * 6, 1), (802, [1e9, -1e9, 1e12, 0.0, 0.0, 1.0], 2)]
    assert got_codes(spark.createDataFrame(rows, SCHEMA), parts=3, entries=43) == brute_codes(rows, 3, 43, 2, 256, 6)


def test_nearest_equals_all_distances_and_takes_fewer():
    rng = np.random.default_rng(2)
    for width, high in ((4, 2000), (2, 6), (1, 3), (3, 1)):
        entries = rng.integers(-high, high, (64, width))
        q = rng.integers(-high, high, (2000, width))
        index, best, taken = vector_codes.nearest(vector_codes.tree(entries), entries, q)
        squares = ((q[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == squares.argmin(axis=1)).all() and (best == squares.min(axis=1)).all()
        if high == 2000:
            assert taken < 0.5 * squares.size


def test_lower_index_behind_an_equal_bound_wins():
    entries = np.array([[4], [0], [4], [0], [8], [12], [16], [20]])
    index, best, _ = vector_codes.nearest(vector_codes.tree(entries), entries, np.array([[2], [6], [0], [18]]))
    assert index.tolist() == [0, 0, 1, 6] and best.tolist() == [4, 4, 0, 4]


def test_integers_survive_each_form(spark):
    rows = [(1, [0.5, -0.5]), (2, [1000.0, -1000.0]), (3, [1e20, -1e20]), (4, [-0.001, 3.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for parts in (1, 4):
        got = {r["id"]: _vectors.decode(_pa([bytes(r["x"])]), 2).tolist()[0] for r in _vectors.encode(df.repartition(parts), "v", 64, ["id"]).collect()}
        assert got == {1: [32, -32], 2: [64000, -64000], 3: [6400000000000000000000, -6400000000000000000000], 4: [-1, 192]}


def _pa(values):
    import pyarrow as pa

    return pa.array(values, pa.binary())
