"""Product codes of vectors, with a kd-tree over each codebook.

A vector's integers are cut into ``PARTS`` equal parts, and each part is named by the
nearest entry of that position's codebook. Each round the codebooks go to all
tasks as kd-trees. A part first falls to its home leaf, then branch and bound goes
down from the root into every node whose box isn't further away than the best entry
so far; boxes that are just as far are entered too, so that of equal entries the one
with the lower index wins. All is in exact integers. Tasks add up count and sums for
each entry, partial sums are added up by Spark, and the driver moves the entries:
it gets parts times entries times width numbers, whatever the input.

Defined cases: rows whose vector is null, empty, or holds null or non-finite components are
left out (components from 1e50 up count as infinite). All vectors should have one length, a
multiple of the number of parts; where lengths differ, those of the most frequent such length
are coded (of equally frequent ones the shortest) and the others are left out. Rows that repeat an
id or a vector are rows like others; rows without an id come last in the choice of first
entries, and equal ids go by their vectors; with fewer vectors than entries there are fewer
entries; sums that don't fit 64 bits are null; null labels are one label; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import join_spread, materialise
from scriptorium.llm._vectors import add_up, apart, decode, encode, exact, finite, first_rows, halves, longs, same_kind

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries in a leaf, at most, unless they are all equal.
LEAF = 4


@dataclass
class Node:
    """low and high: the box of the entries below it; a leaf has members, others an axis with its cut."""

    low: np.ndarray
    high: np.ndarray
    members: list[int] | None = None
    axis: int = 0
    at: int = 0
    left: Node | None = None
    right: Node | None = None


def tree(entries: np.ndarray, members: list[int] | None = None) -> Node:
    """A kd-tree: the widest side of the box is cut at the median."""
    held = list(range(len(entries))) if members is None else members
    points = entries[held]
    low, high = points.min(axis=0), points.max(axis=0)
    wide = (high - low).tolist()
    if len(held) <= LEAF or not max(wide):
        return Node(low, high, held)
    axis = wide.index(max(wide))
    values = sorted(points[:, axis].tolist())
    at = values[len(values) // 2]
    if at == values[0]:
        at = next(v for v in values if v > at)
    left = [m for m in held if entries[m, axis] < at]
    right = [m for m in held if entries[m, axis] >= at]
    return Node(low, high, None, axis, at, tree(entries, left), tree(entries, right))


def nearest(root: Node, entries: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry to each row of q, of equal ones the lowest index; and how many distances to entries were taken."""
    q, entries = same_kind(q, entries)
    index = np.full(len(q), len(entries), dtype=np.int64)
    best = np.full(len(q), -1, dtype=q.dtype)
    home = np.zeros(len(q), dtype=np.int64)
    taken = 0

    def scan(leaf: Node, rows: np.ndarray) -> None:
        nonlocal taken
        taken += len(rows) * len(leaf.members)
        for m in leaf.members:
            d = apart(q[rows], entries[m])
            wins = (best[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (m < index[rows]))
            best[rows[wins]] = d[wins]
            index[rows[wins]] = m

    stack = [(root, np.arange(len(q)))]
    while stack:
        node, rows = stack.pop()
        if not len(rows):
            continue
        if node.members is not None:
            home[rows] = id(node)
            scan(node, rows)
            continue
        below = (q[rows, node.axis] < node.at).astype(bool)
        stack += [(node.left, rows[below]), (node.right, rows[~below])]
    stack = [(root, np.arange(len(q)))]
    while stack:
        node, rows = stack.pop()
        if not len(rows):
            continue
        outside = np.maximum(np.maximum(node.low - q[rows], q[rows] - node.high), 0)
        rows = rows[((outside * outside).sum(axis=1) <= best[rows]).astype(bool)]
        if node.members is None:
            stack += [(node.left, rows), (node.right, rows)]
        else:
            scan(node, rows[home[rows] != id(node)])
    return index, best, taken


def _shape(rows: DataFrame, parts: int) -> int:
    """The most frequent length that can be cut into parts, or 0."""
    sizes = rows.groupBy(F.size("v").alias("n")).count().where((F.col("n") > 0) & (F.col("n") % parts == 0))
    top = sizes.orderBy(F.desc("count"), "n").first()
    return top["n"] if top else 0


def _train(coded: DataFrame, books: np.ndarray) -> dict[tuple, tuple[int, list[int]]]:
    """count and sums of the parts nearest to each entry that has some; books is parts x entries x width."""
    parts, entries, width = books.shape
    trees = [tree(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), dtype=np.int64)
        sums: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = decode(b["x"], parts * width)
            for p in range(parts):
                q = x[:, p * width : (p + 1) * width]
                index, _, _ = nearest(trees[p], books[p], q)
                counts[p] += np.bincount(index, minlength=entries)
                order = np.argsort(index, kind="stable")
                used, firsts = np.unique(index[order], return_index=True)
                added = np.add.reduceat(q[order], firsts, axis=0).tolist()
                for e, more in zip(used.tolist(), added, strict=True):
                    sums[p, e] = [s + int(v) for s, v in zip(sums.get((p, e), [0] * width), more, strict=True)]
        at = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in at], pa.int32()), pa.array([e for _, e in at], pa.int32()), pa.array([counts[k] for k in at], pa.int64()), pa.array([halves(sums[k]) for k in at], pa.list_(pa.decimal128(38, 0)))], ["part", "entry", "n", "sums"])

    return add_up(coded.select("x").mapInArrow(run, "part int, entry int, n long, sums array<decimal(38,0)>"), ["part", "entry"], width)


def _code(coded: DataFrame, books: np.ndarray, kinds: dict[str, str]) -> DataFrame:
    """id, label, code, error of every vector."""
    parts, entries, width = books.shape
    trees = [tree(b) for b in books]
    digits = 2 if entries <= 256 else len(f"{entries - 1:x}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = decode(b["x"], parts * width)
            codes, errors = [], []
            for p in range(parts):
                index, d, _ = nearest(trees[p], books[p], x[:, p * width : (p + 1) * width])
                codes.append(index)
                errors.append(d.astype(object))
            code = ["".join(f"{e:0{digits}x}" for e in row) for row in np.stack(codes, axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], pa.array(code, pa.string()), longs(np.sum(errors, axis=0))], ["id", "label", "code", "error"])

    return coded.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def quantise(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that is kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(finite(F.col("v")))
    kinds = dict(rows.dtypes)
    dim = _shape(rows, parts)
    if not dim:
        return spark.createDataFrame([], f"vec_id {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string")
    width = dim // parts
    rows = rows.where(F.size("v") == dim)
    coded = materialise(encode(rows, "v", scale, ["id", "label"]), "vectors")
    start = first_rows(rows, [F.col("id").asc_nulls_last(), F.col("v")], entries, "v", scale, dim)
    books = start.reshape(len(start), parts, width).swapaxes(0, 1)
    for _ in range(rounds):
        after = books.astype(object)
        for (p, e), (n, sums) in _train(coded, books).items():
            after[p, e] = [s // n for s in sums]
        books = exact(after.reshape(parts * len(start), width), dim).reshape(after.shape)
    digest = hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()
    out = materialise(_code(coded, books, kinds).withColumn("of", F.struct(F.col("label").isNull(), F.coalesce(F.col("label").cast("string"), F.lit("")))), "codes")
    total = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error"))
    sums = materialise(out.groupBy("of").agg(F.count(F.lit(1)).alias("size"), total.alias("label_error")), "label-errors")
    full = join_spread(out, sums, "of", "size", out.count(), ["id", "code"])
    return full.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The plain algorithm in SQL: all entries are compared."""
    ctes = [
        f"v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"q AS (SELECT vec_id, label, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM v, range({parts}) AS t(p))",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT {entries})",
        "c0 AS (SELECT p, e, x FROM q JOIN f USING (vec_id))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"d{r} AS (SELECT q.vec_id, q.p, q.x, c.e, list_sum(list_transform(list_zip(q.x, c.x), lambda y: (y[1] - y[2]) * (y[1] - y[2]))) AS d FROM q JOIN c{r} c ON q.p = c.p)")
        ctes.append(f"a{r} AS (SELECT vec_id, p, any_value(x) AS x, arg_min(e, d * 1000 + e) AS e, min(d) AS d FROM d{r} GROUP BY vec_id, p)")
        if r < rounds:
            ctes.append(f"s{r} AS (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY p, e, i)")
            ctes.append(f"u{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY p, e)")
            ctes.append(f"c{r + 1} AS (SELECT c.p, c.e, coalesce(u.x, c.x) AS x FROM c{r} c LEFT JOIN u{r} u ON c.p = u.p AND c.e = u.e)")
    ctes.append(f"o AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    ctes.append(f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN v USING (vec_id) CROSS JOIN h"
