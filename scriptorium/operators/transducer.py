"""Finite-state machines over the lines of texts, run as a parallel prefix.

A line of some kind moves the machine from each state to another one, so it is a map from states to states,
and maps can be put together in any grouping. Lines are sorted into ranges; a task composes the maps of
each text's lines in its range, by doubling; of each text and range one map goes on, and these give each
range the state it begins with. So no text needs a task of its own, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.lineage import cut
from scriptorium.operators.scans import in_ranges
from scriptorium.shipping import ship


@dataclass(frozen=True)
class Machine:
    """moves: from (state, kind) to a state; ``*`` as the state stands for all that have no move of their own, and without any move a line leaves the state as it is."""

    states: tuple[str, ...]
    start: str
    kinds: tuple[str, ...]
    moves: dict[tuple[str, str], str]

    def __post_init__(self) -> None:
        unknown = [x for (s, k), t in self.moves.items() for x, known in ((s, (*self.states, "*")), (k, self.kinds), (t, self.states)) if x not in known]
        if unknown or self.start not in self.states:
            raise ValueError(f"unknown states or kinds: {unknown or self.start}")

    def step(self, state: str, kind: str | None) -> str:
        return self.moves.get((state, kind), self.moves.get(("*", kind), state))

    def maps(self) -> np.ndarray:
        """A row for each kind, and one for lines of none."""
        return np.array([[self.states.index(self.step(s, k)) for s in self.states] for k in (*self.kinds, None)], dtype=np.int64)


def compose(maps: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Of each row, all maps from its stretch's first row to it put together; firsts has that row's place."""
    out, at, shift = maps.copy(), np.arange(len(maps)), 1
    while shift < len(maps):
        rows = np.flatnonzero(at - shift >= firsts)
        if not len(rows):
            break
        out[rows] = np.take_along_axis(out[rows], out[rows - shift], axis=1)
        shift *= 2
    return out


def run(lines: DataFrame, key: str, kind: Column, machine: Machine) -> DataFrame:
    """lines (key, pos and others) with ``kind``, ``before`` and ``state``: the machine's states before and after each line."""
    ship(lines.sparkSession)
    table, size = machine.maps(), len(machine.states)
    numbers = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(machine.kinds)], F.lit(len(machine.kinds)))
    placed = in_ranges(lines.withColumn("kind", kind), [key], ["pos"]).withColumn("_k", numbers)
    names = placed.columns
    held = [f"_c{i}" for i in range(len(names))]
    own = names.index(key)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(own).to_pylist()
            opens = np.array([True, *(x != y for x, y in zip(keys[1:], keys[:-1], strict=True))])
            firsts = np.maximum.accumulate(np.where(opens, np.arange(len(keys)), 0))
            maps = compose(table[b.column(len(names) - 1).to_numpy()], firsts)
            if carried is not None and keys[0] == last:
                ends = np.flatnonzero(opens[1:])
                n = int(ends[0]) + 1 if len(ends) else len(keys)
                maps[:n] = np.take_along_axis(maps[:n], np.broadcast_to(carried, (n, size)), axis=1)
            last, carried = keys[-1], maps[-1].copy()
            offsets = pa.array(np.arange(len(keys) + 1) * size, pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(maps.ravel().astype(np.int32)))], [*held, "_map"])

    kinds = ", ".join(f"{h} {t}" for h, (_, t) in zip(held, placed.dtypes, strict=True))
    mapped = cut(placed.toDF(*held).mapInArrow(composed, f"{kinds}, _map array<int>").toDF(*names, "_map"))
    totals = mapped.groupBy(key, "_part").agg(F.max_by("_map", "pos").alias("total"))
    earlier = F.collect_list("total").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = totals.select(key, "_part", F.aggregate(earlier, F.lit(machine.states.index(machine.start)), lambda s, m: F.get(m, s)).alias("_begin"))
    after = F.get("_map", F.col("_begin"))
    word = lambda c: F.get(F.array(*map(F.lit, machine.states)), c)
    out = mapped.join(begins, [key, "_part"]).withColumn("_after", after)
    # The state before is that after the line before; lines of a text in a range follow one another there.
    back = F.lag("_after").over(Window.partitionBy(key, "_part").orderBy("pos"))
    out = out.withColumn("before", word(F.coalesce(back, F.col("_begin")))).withColumn("state", word(F.col("_after")))
    return out.drop("_k", "_map", "_begin", "_after", "_part")
