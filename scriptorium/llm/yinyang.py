"""Centroid clustering with Yinyang bounds.

The centroids are put into groups once, by clustering them. With each vector go
its cluster, an upper bound of the distance to its centroid, and for each group a
lower bound of the distance to all other centroids in it. When centroids have
moved, the upper bound grows by its centroid's way and each lower bound shrinks by
the longest way in its group. A vector whose upper bound is under all lower bounds
stays where it is; else its own distance is taken exactly and, if that isn't
enough, the centroids of those groups whose bound isn't above it are scanned.

Vectors and centroids are exact integers and distances are squared; only the
bounds are floats, with a margin far above their rounding, and a bound that is equal
is scanned, so results are those of a full scan with ties to the smaller number.

A round is one pass over a table of vectors with their bounds, which is written,
and one sum over it with partial sums for each task. What goes to the tasks and to the
driver is centroids: ``clusters`` times ``dim`` numbers, whatever the input.

Defined cases: vectors that are null, of another length, or hold null or
non-finite components are left out (components from 1e50 up count as infinite);
rows that repeat an id or a vector are rows like others; rows without an id come last in the
choice of first centroids, and equal ids go by their vectors; with fewer vectors than
clusters there are fewer clusters; a distance or sum that doesn't fit 64 bits is null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import materialise
from scriptorium.llm._vectors import add_up, apart, decode, encode, exact, finite, first_rows, halves, longs, pack, same_kind, unpack

CLUSTERS, ROUNDS, DIM, SCALE = 16, 3, 64, 64
#: Centroids in a group, about.
GROUP = 4
#: Bounds are widened by this share, far above what rounding adds.
MARGIN = 1e-9


def group_centroids(centroids: np.ndarray, per_group: int = GROUP, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of plain clustering of the centroids, from the first ones."""
    points = centroids.astype(np.float64)
    t = max(1, -(-len(points) // per_group))
    middles = points[:t].copy()
    group = np.zeros(len(points), dtype=np.int64)
    for _ in range(rounds):
        group = ((points[:, None, :] - middles[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(t):
            if (group == g).any():
                middles[g] = points[group == g].mean(axis=0)
    return np.unique(group, return_inverse=True)[1]


def _root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


def full_scan(x: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper bound and lower bounds by group of each row."""
    x, c = same_kind(x, centroids)
    squares = np.stack([apart(x, v) for v in c], axis=1)
    a = squares.argmin(axis=1)
    every = _root(squares)
    upper = every[np.arange(len(x)), a] * (1 + MARGIN)
    every[np.arange(len(x)), a] = np.inf
    lower = np.stack([every[:, group == g].min(axis=1) for g in range(group.max() + 1)], axis=1) * (1 - MARGIN)
    return a, upper, lower


def filtered_scan(x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster and bounds after centroids have moved so far each, and how many distances were taken."""
    x, c = same_kind(x, centroids)
    furthest = np.array([moved[group == g].max() for g in range(group.max() + 1)])
    a, upper = a.copy(), (upper + moved[a]) * (1 + MARGIN)
    lower = np.maximum(0, lower - furthest) * (1 - MARGIN)
    open_ = np.flatnonzero(lower.min(axis=1) <= upper)  # the global filter
    if not len(open_):
        return a, upper, lower, 0
    best = ((x[open_] - c[a[open_]]) ** 2).sum(axis=1)
    taken = len(open_)
    upper[open_] = _root(best) * (1 + MARGIN)
    still = lower[open_].min(axis=1) <= upper[open_]
    open_, best = open_[still], best[still]
    if not len(open_):
        return a, upper, lower, taken
    own, own_square, own_upper = a[open_].copy(), best.copy(), upper[open_].copy()
    scanned: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for g in range(group.max() + 1):
        rows = np.flatnonzero(lower[open_, g] <= own_upper)  # the filter by group
        members = np.flatnonzero(group == g)
        if not len(rows):
            continue
        squares = np.stack([apart(x[open_[rows]], c[m]) for m in members], axis=1)
        taken += squares.size
        scanned[g] = (rows, members, squares)
        for j, m in enumerate(members.tolist()):
            d, at = squares[:, j], a[open_[rows]]
            wins = (d < best[rows]) | ((d == best[rows]) & (m < at))
            best[rows[wins]] = d[wins]
            a[open_[rows[wins]]] = m
    upper[open_] = _root(best) * (1 + MARGIN)
    for g, (rows, members, squares) in scanned.items():
        others = np.where(members[None] == a[open_[rows], None], np.inf, _root(squares))
        lower[open_[rows], g] = others.min(axis=1) * (1 - MARGIN)
    # The cluster that a row has left is one of the others of its group now.
    left = np.flatnonzero(own != a[open_])
    at = group[own[left]]
    lower[open_[left], at] = np.minimum(lower[open_[left], at], _root(own_square[left]) * (1 - MARGIN))
    return a, upper, lower, taken


def _assign(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, group: np.ndarray, kind: str, last: bool) -> DataFrame:
    """state with cluster and bounds for these centroids; d, the exact squared distance, is given the last time only."""
    dim, groups = centroids.shape[1], int(group.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = decode(b["x"], dim)
            if moved is None:
                a, upper, lower = full_scan(x, centroids, group)
            else:
                bounds = unpack(b["bounds"], np.float64, 1 + groups)
                a, upper, lower, _ = filtered_scan(x, b["a"].to_numpy(), bounds[:, 0], bounds[:, 1:], centroids, moved, group)
            made = [b["id"], b["x"], pa.array(a, pa.int32()), pack(np.column_stack([upper, lower]))]
            if last:
                y, c = same_kind(x, centroids)
                d = y - c[a]
                made = [b["id"], pa.array(a, pa.int32()), longs((d * d).sum(axis=1))]
            yield pa.RecordBatch.from_arrays(made, ["id", "a", "d"] if last else ["id", "x", "a", "bounds"])

    return state.mapInArrow(run, f"id {kind}, a int, d long" if last else f"id {kind}, x binary, a int, bounds binary")


def _sums(state: DataFrame, clusters: int, dim: int) -> dict[tuple, tuple[int, list[int]]]:
    """count and sums of each cluster that has vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(clusters, dtype=np.int64), [[0] * dim for _ in range(clusters)]
        for b in batches:
            if not b.num_rows:
                continue
            x, a = decode(b["x"], dim), b["a"].to_numpy()
            for k in np.unique(a).tolist():
                counts[k] += (a == k).sum()
                sums[k] = [s + int(v) for s, v in zip(sums[k], x[a == k].sum(axis=0).tolist(), strict=True)]
        used = np.flatnonzero(counts).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), pa.array([halves(sums[k]) for k in used], pa.list_(pa.decimal128(38, 0)))], ["a", "n", "sums"])

    return add_up(state.select("a", "x").mapInArrow(run, "a int, n long, sums array<decimal(38,0)>"), ["a"], dim)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, id: str = "vec_id", vector: str = "embedding", seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    The first centroids are the vectors with the least SHA-256 of ``seed:id``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("v")).where((F.size("v") == dim) & finite(F.col("v")))
    kind = dict(rows.dtypes)["id"]
    coded = materialise(encode(rows, "v", scale, ["id"]), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    centroids = first_rows(rows, [digest.asc_nulls_last(), F.col("v")], clusters, "v", scale, dim)
    out = "id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], out.format(kind)).withColumnRenamed("id", "vec_id")
    group = group_centroids(centroids)
    state, moved = coded, None
    for _ in range(rounds):
        state = materialise(_assign(state, centroids, moved, group, kind, False), "bounds")
        after = centroids.astype(object)
        for (k,), (n, sums) in _sums(state, len(centroids), dim).items():
            after[k] = [s // n for s in sums]
        moved = np.sqrt(((after - centroids.astype(object)) ** 2).sum(axis=1).astype(np.float64)) * (1 + MARGIN)
        centroids = exact(after, dim)
    last = materialise(_assign(state, centroids, moved, group, kind, True), "clusters")
    total = F.when(F.count("d") == F.count(F.lit(1)), F.try_sum("d"))
    inertia = {r["a"]: r["s"] for r in last.groupBy("a").agg(total.alias("s")).collect()}
    whole = None if None in inertia.values() else sum(inertia.values())
    if whole is not None and whole >= 1 << 63:
        whole = None
    digests = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    table = spark.createDataFrame([(k, s, whole, digests[k]) for k, s in inertia.items()], "a int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row a cluster.
    return last.join(F.broadcast(table), "a").select(F.col("id").alias("vec_id"), F.col("a").alias("cluster"), F.col("d").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The plain algorithm in SQL: a full scan each round."""
    ctes = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS k, x FROM (SELECT x, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT {clusters}))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"d{r} AS (SELECT v.vec_id, v.x, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c{r} c)")
        ctes.append(f"a{r} AS (SELECT vec_id, any_value(x) AS x, arg_min(k, d * 1000 + k) AS k, min(d) AS d FROM d{r} GROUP BY vec_id)")
        if r < rounds:
            ctes.append(f"s{r} AS (SELECT k, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, {DIM + 1}) AS t(i) GROUP BY k, i)")
            ctes.append(f"u{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY k)")
            ctes.append(f"c{r + 1} AS (SELECT c.k, coalesce(u.x, c.x) AS x FROM c{r} c LEFT JOIN u{r} u USING (k))")
    return (
        "WITH "
        + ",\n".join(ctes)
        + f"""
SELECT a.vec_id, a.k AS "cluster", CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (k)"""
    )
