"""Bundles that share an item, compared where they meet.

Each bundle goes, with all it holds, to each of its items. Whoever meets at an item is compared
there in full, so no pair crosses a shuffle before it is decided on: what moves is each bundle
once an item, and what is kept of the pairs. An item of more than ``SIDE`` bundles is laid out in
tiles of two parts of these, so its pairs are spread over tasks and a task holds one tile.

A bundle's items are one array of a row; rows without a bundle or an item meet nobody, but an item
that is null counts in its bundle's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium.operators.joins import small
from scriptorium.operators.lineage import cut
from scriptorium.shipping import ship

#: Bundles in a part of an item; rows and pairs that are compared together.
SIDE, ROWS, PAIRS = 1000, 8192, 1 << 16
#: Items up to which bundles are held against each other as rows of a table.
WIDE = 8


def tiles(one: DataFrame, side: int = SIDE) -> DataFrame:
    """item, p, q, half, bag, items, doses: who meets at each tile; those of half 0 meet each other if p = q, else those of half 1.

    one has (bag, item, dose), each bag and item once."""
    held = one.where("bag IS NOT NULL").groupBy("bag").agg(F.sort_array(F.collect_list(F.struct("item", "dose"))).alias("all"))
    whole = held.select("bag", F.col("all.item").alias("items"), F.col("all.dose").cast("array<double>").alias("doses"))
    met = whole.withColumn("item", F.explode("items")).where("item IS NOT NULL")
    # At most one item in ``side`` rows is this frequent.
    often = one.where("bag IS NOT NULL AND item IS NOT NULL").groupBy("item").count().where(F.col("count") > side).select("item", F.ceil(F.col("count") / side).cast("int").alias("parts"))
    dealt = met.join(small(cut(often)), "item", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("bag"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(own, k).alias("p"), F.greatest(own, k).alias("q"), (own > k).cast("int").alias("half")))
    return dealt.select("item", F.explode(others).alias("t"), "bag", "items", "doses").select("item", "t.*", "bag", "items", "doses")


def meet(one: DataFrame, compare: Callable[[Held, np.ndarray, np.ndarray], pa.RecordBatch], ddl: str, side: int = SIDE) -> DataFrame:
    """What compare gives for all pairs that meet; it is called with rows of tiles and the places of the pairs' sides among them."""
    ship(one.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, place in _together(batches):
            held = Held(rows)
            for x, y in _pairs(place, rows["half"].to_numpy()):
                if len(x):
                    yield compare(held, x, y)

    parts = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = tiles(one, side).repartition(parts, "item", "p", "q").sortWithinPartitions("item", "p", "q")
    return laid.mapInArrow(run, ddl)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole tiles, about ``ROWS`` rows of them at a time, and where each begins."""
    held: pa.Table | None = None

    def starts(t: pa.Table) -> np.ndarray:
        code = [pc.rank(t[c].combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64) for c in ("item", "p", "q")]
        return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in code], axis=0)))

    for b in batches:
        if not b.num_rows:
            continue
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if held.num_rows >= ROWS:
            at = starts(held)
            if len(at) > 1:
                yield held.slice(0, at[-1]).combine_chunks(), at[:-1]
                held = held.slice(at[-1]).combine_chunks()
    if held is not None:
        yield held.combine_chunks(), starts(held)


def _pairs(starts: np.ndarray, half: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of each tile, about ``PAIRS`` at a time: of a tile with two halves across them, else each pair once."""
    rows = np.arange(len(half))
    tile = np.searchsorted(starts, rows, side="right") - 1
    crossed = np.bincount(tile, half, minlength=len(starts))[tile] > 0
    # The rows that come after one of half 0 in its tile, or all of half 1.
    order = np.lexsort((half, tile))
    place = np.empty(len(half), dtype=np.int64)
    place[order] = rows
    ends = np.append(starts[1:], len(half))[tile]
    first = np.where(crossed, starts[tile] + np.bincount(tile, half == 0, minlength=len(starts)).astype(np.int64)[tile], place + 1)
    many = np.where(half == 0, ends - first, 0)
    total = np.cumsum(many)
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        own = many[at:stop]
        x = np.repeat(rows[at:stop], own)
        y = order[np.repeat(first[at:stop] - np.append(0, np.cumsum(own)[:-1]), own) + np.arange(len(x))]
        yield x, y
        at = stop


class Held:
    """Rows of tiles as flat arrays: items as numbers in their order in the bundles."""

    def __init__(self, rows: pa.Table):
        get = lambda c: rows[c].combine_chunks()
        self.bag, items, doses = get("bag"), get("items"), get("doses")
        self.rank = pc.rank(self.bag, tiebreaker="dense").to_numpy().astype(np.int64)
        flat = items.flatten()
        own = get("item")
        codes = pa.chunked_array([flat, own]).dictionary_encode().combine_chunks().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.item = codes[len(flat) :]
        self.size = pc.list_value_length(items).to_numpy().astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        dose = doses.flatten()
        self.absent = dose.is_null().to_numpy(zero_copy_only=False)
        self.dose = dose.fill_null(0.0).to_numpy(zero_copy_only=False)
        self.code = codes[: len(flat)]
        self.table = None
        if (widest := int(self.size.max(initial=0))) <= WIDE:
            self.table = np.full((len(self.size), widest), -1, dtype=np.int32)
            self.table[np.repeat(np.arange(len(self.size)), self.size), np.arange(len(self.code)) - np.repeat(self.first, self.size)] = self.code
            return
        # (row, item) of all, sorted, to look items up by.
        self.width = int(codes.max(initial=0)) + 2
        key = np.repeat(np.arange(len(self.size)), self.size) * self.width + self.code + 1
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]

    def shared(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """pair, place in x's row, place in y's row of each item that the pairs share, in the order of pairs and items."""
        if self.table is not None:
            left, right = self.table[x], self.table[y]
            pair, p, q = np.nonzero((left[:, :, None] == right[:, None, :]) & (left >= 0)[:, :, None])
            return pair, self.first[x[pair]] + p, self.first[y[pair]] + q
        turn = np.where(self.size[x] <= self.size[y], 0, 1)
        a, b = np.where(turn, y, x), np.where(turn, x, y)
        n = self.size[a]
        pair = np.repeat(np.arange(len(a)), n)
        left = np.repeat(self.first[a] - (np.cumsum(n) - n), n) + np.arange(len(pair))
        want = b[pair] * self.width + self.code[left] + 1
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        hit = (self.key[at] == want) & (self.code[left] >= 0)
        pair, left, right = pair[hit], left[hit], self.order[at[hit]]
        swap = turn[pair] == 1
        return pair, np.where(swap, right, left), np.where(swap, left, right)

    def agreement(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """shared items, how many of them have other doses, how near the doses are, and the first shared item of each pair."""
        pair, p, q = self.shared(x, y)
        da, db, na, nb = self.dose[p], self.dose[q], self.absent[p], self.absent[q]
        same = (na & nb) | (~na & ~nb & ((da == db) | (np.isnan(da) & np.isnan(db))))
        with np.errstate(divide="ignore", invalid="ignore"):
            # Beside a number Spark takes what is no number for the greatest.
            near = np.where(~na & ~nb & ((da > 0) | np.isnan(da)) & ((db > 0) | np.isnan(db)), np.fmin(da, db) / np.maximum(da, db), 0.0)
        n = len(x)
        shared = np.bincount(pair, minlength=n)
        first = np.full(n, -1, dtype=np.int64)
        first[pair[::-1]] = self.code[p[::-1]]
        return shared, np.bincount(pair, ~same, minlength=n).astype(np.int64), np.bincount(pair, near, minlength=n), first


def pairs(one: DataFrame, keep: Callable[..., np.ndarray] | None = None, side: int = SIDE) -> DataFrame:
    """(a, b, shared, changed, closeness, na, nb) of all pairs a < b of bags that share an item, each where its first shared item is.

    ``keep`` (of arrays na, nb, shared, changed) says which pairs are wanted, so that others don't leave their task."""
    kind = to_arrow_type(one.schema["bag"].dataType)

    def compare(held: Held, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        back = held.rank[x] > held.rank[y]
        x, y = np.where(back, y, x), np.where(back, x, y)
        shared, changed, near, first = held.agreement(x, y)
        own = (first == held.item[x]) & (held.rank[x] != held.rank[y])
        if keep is not None:
            own &= keep(held.size[x], held.size[y], shared, changed)
        x, y = x[own], y[own]
        numbers = (shared[own], changed[own], near[own], held.size[x], held.size[y])
        return pa.RecordBatch.from_arrays([held.bag.take(pa.array(x)).cast(kind), held.bag.take(pa.array(y)).cast(kind), *map(pa.array, numbers)], ["a", "b", "shared", "changed", "closeness", "na", "nb"])

    name = dict(one.dtypes)["bag"]
    return meet(one, compare, f"a {name}, b {name}, shared long, changed long, closeness double, na long, nb long", side)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """x times 10 ** digits as integers, rounded as Spark does: halves of the shortest decimal form go up. x is not negative."""
    scaled = x * 10**digits
    out = np.floor(scaled + 0.5).astype(np.int64)
    for k in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6).tolist():
        out[k] = int((Decimal(repr(float(x[k]))) * 10**digits).quantize(Decimal(1), ROUND_HALF_UP))
    return out


#: Stands for a score that is no number.
NONE = 1 << 30


def nearest(one: DataFrame, digits: int = 6, side: int = SIDE) -> DataFrame:
    """bag, other, score of every bag that shares an item: the one with the greatest closeness by items of both, the least of equals.

    A tile gives each of its rows' best, and the best of these is taken, so pairs stay where they meet."""
    kind = to_arrow_type(one.schema["bag"].dataType)

    def compare(held: Held, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        apart = held.rank[x] != held.rank[y]
        x, y = x[apart], y[apart]
        shared, _, near, _ = held.agreement(x, y)
        if not len(x):
            return pa.RecordBatch.from_arrays([held.bag.slice(0, 0).cast(kind)] * 2 + [pa.array([], pa.float64())], ["bag", "other", "score"])
        score = near / (held.size[x] + held.size[y] - shared)
        # What is no number comes before all others.
        score = np.where(np.isnan(score), NONE, rounded(np.nan_to_num(score), digits)) << 32
        order = np.argsort(held.rank, kind="stable")
        last = len(order) - held.rank
        best = np.zeros(len(order), dtype=np.int64)
        begins = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        best[x[begins]] = np.maximum.reduceat(score | last[y], begins)
        np.maximum.at(best, y, score | last[x])
        found = np.flatnonzero(best)
        other = order[np.searchsorted(held.rank[order], len(order) - (best[found] & 0xFFFFFFFF))]
        top = best[found] >> 32
        return pa.RecordBatch.from_arrays([held.bag.take(pa.array(found)).cast(kind), held.bag.take(pa.array(other)).cast(kind), pa.array(np.where(top == NONE, np.nan, top / 10**digits))], ["bag", "other", "score"])

    name = dict(one.dtypes)["bag"]
    found = meet(one, compare, f"bag {name}, other {name}, score double", side)
    best = found.groupBy("bag").agg(F.min_by(F.struct("other", "score"), F.struct(-F.col("score"), "other")).alias("m"))
    return best.select("bag", "m.other", "m.score")
