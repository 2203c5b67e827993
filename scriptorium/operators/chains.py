"""Order as a chain: of many candidate places, those that follow one another best.

Each passage of a source has candidate places (start, end, weight) in a witness. A
chain takes at most one place of each passage, none before the end of an earlier
passage's; the heaviest chain is wanted. Where all places of the passages up to one
end before all places of later passages start, the chains on both sides don't
depend on each other. Rows are cut there, by running maxima and minima, and each
stretch between cuts is solved on its own with a Fenwick tree over ends. So a
source with orderly places is spread over many tasks, and one that can't be cut is solved
as a whole, which takes n log n steps on numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.lineage import shuffled
from scriptorium.operators.scans import in_ranges, running
from scriptorium.shipping import ship


#: Stretches that one task takes together.
TOGETHER = 256
#: Places that a task takes together, of whatever keys.
ROWS = 1 << 15


def heaviest_chain(pos: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indexes of the heaviest chain, in order.

    Of equally heavy chains the one is taken whose last place ends first, then starts
    last, and so on backwards. Weights are positive."""
    n = len(pos)
    if not n:
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((-start, end, pos))
    ends = np.unique(end)
    rank = np.searchsorted(ends, end, side="left") + 1
    upto = np.searchsorted(ends, start, side="right")
    best: list[tuple[float, int]] = [(0.0, -1)] * (len(ends) + 1)
    total, before = np.zeros(n), np.full(n, -1, dtype=np.int64)
    at = 0
    while at < n:
        stop = at
        while stop < n and pos[order[stop]] == pos[order[at]]:
            stop += 1
        for i in order[at:stop].tolist():
            k, found = int(upto[i]), (0.0, -1)
            while k > 0:
                if best[k][0] > found[0]:
                    found = best[k]
                k &= k - 1
            total[i], before[i] = found[0] + weight[i], found[1]
        for i in order[at:stop].tolist():
            k = int(rank[i])
            while k < len(best):
                if total[i] > best[k][0]:
                    best[k] = (total[i], i)
                k += k & -k
        at = stop
    last = min(range(n), key=lambda i: (-total[i], end[i], -start[i], pos[i]))
    chain = []
    while last >= 0:
        chain.append(last)
        last = int(before[last])
    return np.array(chain[::-1], dtype=np.int64)


def stretches(places: DataFrame, keys: list[str]) -> DataFrame:
    """places with ``stretch``: passages of a key whose places can't be told from each other's order have the same."""
    spans = places.groupBy(*keys, "pos").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    seen = running(in_ranges(spans, keys, ["pos"]), keys, ["pos"], {"before": ("high", "max", False, False), "least": ("low", "min", True, True)}, placed=True)
    opens = seen.withColumn("opens", (F.col("before").isNull() | (F.col("before") <= F.col("least"))).cast("int"))
    numbers = running(opens, keys, ["pos"], {"stretch": ("opens", "sum", False, True)}, placed=True).select(*keys, "pos", "stretch")
    return places.join(shuffled(numbers), [*keys, "pos"])


def choose(places: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of places (keys, pos, start, end, weight and others) that form the heaviest chain of each key."""
    ship(places.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        # Stretches by number, whatever their keys are.
        numbers = group.select([*keys, "stretch"]).to_pandas().groupby([*keys, "stretch"], dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(numbers, kind="stable")
        values = [group[c].to_numpy() for c in ("pos", "start", "end", "weight")]
        kept = [own[heaviest_chain(*(v[own] for v in values))] for own in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1)]
        return group.take(pa.array(np.concatenate(kept))).drop_columns(["stretch", "group"])

    # Neighbouring stretches are one problem too, so short ones are solved together.
    cutup = stretches(places, keys).withColumn("stretch", F.floor(F.col("stretch") / TOGETHER))
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(4 * parts, -(-places.count() // ROWS))
    cutup = cutup.withColumn("group", F.pmod(F.xxhash64(*keys, "stretch"), F.lit(groups))).repartition(parts, "group")
    return cutup.groupBy("group").applyInArrow(run, cutup.drop("stretch", "group").schema)
