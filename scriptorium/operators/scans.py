"""Running values along long orders, without a task for each key.

A window that is partitioned by a key puts all rows of the key into one task. Here rows are
sorted into ranges of (key, order), so a key with many rows lies in several partitions; what
a partition has of a key is folded there, and the few folded values of each key are put
together to what each partition starts with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.lineage import cut, shuffled

FOLDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def in_ranges(df: DataFrame, keys: list[str], order: list[str], part: str = "_part") -> DataFrame:
    """df sorted by keys and order over partitions, each with its number in the column part; kept, so numbers stay."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    return cut(placed.withColumn(part, F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, str, bool, bool]], placed: bool = False) -> DataFrame:
    """df with a running value for each name: (column, fold, backwards, own row included).

    Folds are sum, max, min and last (the last value that isn't null). ``order`` must be
    without ties in a key. With ``placed``, df is what ``in_ranges`` has given, and the column of parts stays."""
    keeps = ["_part"] if placed else []
    placed = df if placed else in_ranges(df, keys, order)
    rest = [c for c in placed.columns if c not in (*keys, "_part")]
    up = [F.col(c).asc() for c in order]
    down = [F.col(c).desc() for c in order]
    first, later = Window.partitionBy(*keys, "_part").orderBy(*up), Window.partitionBy(*keys, "_part").orderBy(*down)
    totals, carried = [], []
    out = placed
    for name, (column, fold, backwards, own) in values.items():
        w = (later if backwards else first).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        out = out.withColumn(name, F.last(column, True).over(w) if fold == "last" else FOLDS[fold][0](F.col(column)).over(w))
        place = F.struct(*order)
        held = F.col(column).isNotNull()
        total = (F.min_by if backwards else F.max_by)(F.when(held, F.col(column)), F.when(held, place)) if fold == "last" else FOLDS[fold][0](F.col(column))
        totals.append(total.alias(f"_t_{name}"))
        before = Window.partitionBy(*keys).orderBy(F.desc("_part") if backwards else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
        carried.append((F.last(f"_t_{name}", True) if fold == "last" else FOLDS[fold][0](F.col(f"_t_{name}"))).over(before).alias(f"_b_{name}"))
    # One row for each key and partition that has some of it.
    starts = placed.groupBy(*keys, "_part").agg(*totals).select(*keys, "_part", *carried)
    out = out.join(shuffled(starts), [*keys, "_part"])
    for name, (_, fold, _, _) in values.items():
        own, before = F.col(name), F.col(f"_b_{name}")
        out = out.withColumn(name, F.coalesce(own, before) if fold == "last" else FOLDS[fold][1](own, before))
    return out.select(*keys, *rest, *keeps, *values)
