"""Vectors as rows of exact integers: which are kept, how they are stored, and their sums.

A component x becomes floor(scale * x), which a double holds exactly. Where the
integers are small enough for squared distances to fit 64 bits all is done in
int64, else in Python's own integers by the same code.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import arrow_batches, ship

#: Components of this magnitude or more count as infinite; no 32-bit float has one.
HUGE = 1e50
#: Sums are sent as a low and a high part of this base, so that they fit decimal(38, 0).
BASE = 10**19


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < HUGE, F.lit(False)))
    return F.coalesce(good, F.lit(False))


def pack(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    step = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(step)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def unpack(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """What ``pack`` has packed."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def encode(rows: DataFrame, vector: str, scale: int, others: list[str]) -> DataFrame:
    """others, and x: the vector's integers in the smallest of int16, int32 and double that holds all of a batch. rows hold vectors of one length."""
    ship(rows.sparkSession)
    arrow_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(len(others)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.floor(flat * scale).reshape(b.num_rows, -1)
            top = np.abs(x).max(initial=0)
            kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pack(x.astype(kind))], [*held, "x"])

    held = [f"_c{i}" for i in range(len(others))]
    kinds = [f"{h} {dict(rows.dtypes)[c]}" for h, c in zip(held, others, strict=True)]
    out = rows.select(*others, vector).toDF(*held, "x").mapInArrow(run, ", ".join([*kinds, "x binary"]))
    return out.toDF(*others, "x")


def exact(x: np.ndarray, width: int) -> np.ndarray:
    """Integers whose squared distances over width components are exact: int64, or objects where they are large."""
    if np.abs(x).max(initial=0) < int((2**60 / max(1, width)) ** 0.5):
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def decode(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers from ``encode``'s bytes."""
    held = column.to_pylist()
    sizes = {len(v) // width for v in held}
    if len(sizes) <= 1:
        kind = {2: np.int16, 4: np.int32}.get(next(iter(sizes), 2), np.float64)
        return exact(np.frombuffer(b"".join(held), dtype=kind).reshape(-1, width), width)
    return exact(np.stack([np.frombuffer(v, dtype={2: np.int16, 4: np.int32}.get(len(v) // width, np.float64)).astype(np.float64) for v in held]), width)


def first_rows(rows: DataFrame, order: list[Column], count: int, vector: str, scale: int, dim: int) -> np.ndarray:
    """The integers of the first ``count`` rows, a parameter, in this order."""
    held = [r[0] for r in rows.orderBy(*order).limit(count).select(vector).collect()]
    return exact(np.floor(np.array(held, dtype=np.float64).reshape(-1, dim) * scale), dim)


def same_kind(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as objects if one is."""
    return (a.astype(object), b.astype(object)) if a.dtype != b.dtype else (a, b)


def apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x from the point c."""
    d = x - c
    return (d * d).sum(axis=1)


def longs(values: np.ndarray) -> pa.Array:
    """64-bit integers; null where one doesn't fit."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(v) if v < 1 << 63 else None for v in values.tolist()], pa.int64())


def halves(sums: list[int]) -> list[Decimal]:
    """Low parts, then high parts."""
    return [Decimal(s % BASE) for s in sums] + [Decimal(s // BASE) for s in sums]


def add_up(partial: DataFrame, keys: list[str], width: int) -> dict[tuple, tuple[int, list[int]]]:
    """count and componentwise sums of each key, from rows (keys, n, sums as ``halves``). There are as many keys as centroids or entries, a parameter."""
    flat = partial.select(*keys, "n", F.posexplode("sums").alias("at", "half"))
    rows = flat.groupBy(*keys, "at").agg(F.sum("n").alias("n"), F.sum("half").alias("half")).collect()
    out: dict[tuple, tuple[int, list[int]]] = {}
    for r in rows:
        n, sums = out.setdefault(tuple(r[k] for k in keys), (r["n"], [0] * width))
        sums[r["at"] % width] += int(r["half"]) * (BASE if r["at"] >= width else 1)
    return out
