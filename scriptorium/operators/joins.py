"""Joins of the integration pipeline, on DataFrames.

Every choice among several rows names its order, so that results don't depend
on how rows are dealt out. Single choices are aggregations (max_by, min_by), which
combine before the shuffle, rather than windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and bytes up to which a side is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


#: Rows of a table in a part, where parts are many and where they are few.
PART_ROWS, LEAST_ROWS = 500_000, 20_000


def parts(table: DataFrame) -> int:
    """In how many parts the rows of a table are to be dealt out, so that a task's memory doesn't grow with the table.

    Parts that Spark chooses are joined by their packed size, of which the rows' memory may be many times; a number that is given holds."""
    rows = table.count()
    few = min(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / LEAST_ROWS))
    return max(1, few, math.ceil(rows / PART_ROWS))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it has at most so many rows and, by its values as text, bytes; else df as it is."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("long") for c in df.columns), F.lit(16))
    n, size = df.limit(rows + 1).select(width.alias("w")).agg(F.count("w"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most else df


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last in order."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first in order."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def overlay(left: DataFrame, right: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """left with the arrays of right where these aren't empty."""
    r = right.select(key, *[F.col(a).alias(f"_{a}") for a in arrays])
    out = left.join(r, key, "left")
    for a in arrays:
        out = out.withColumn(a, F.when(F.size(f"_{a}") > 0, F.col(f"_{a}")).otherwise(F.col(a)))
    return out.drop(*[f"_{a}" for a in arrays])


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of existing replaced by those of updates with the same key, and new ones added; a later update wins by ``ord``."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return last_wins(both, keys, ["_new", "ord"]).drop("_new")


def match_or_create(facts: DataFrame, known: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Facts with the known id, and stub rows for the keys that have none."""
    linked = facts.join(known, keys, "left")
    stubs = facts.join(known, keys, "left_anti").select(*keys).distinct().withColumn(name, F.concat_ws("-", *keys))
    return linked, stubs


def by_priority(df: DataFrame, key: str, group: Column, priorities: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the one whose group comes first among priorities, then by order."""
    rank = F.coalesce(*[F.when(group == p, F.lit(i)) for i, p in enumerate(priorities)], F.lit(len(priorities)))
    return first_wins(df.withColumn("_rank", rank), [key], ["_rank", *order]).drop("_rank")


def cascade(left: DataFrame, key: str, steps: list[DataFrame]) -> DataFrame:
    """left with ``match`` and ``step``: the match (key, match) of the first step that has one; of several the least."""
    out = None
    for i, s in enumerate(steps):
        own = s.select(key, "match", F.lit(i).alias("step"))
        out = own if out is None else out.unionByName(own)
    best = out.groupBy(key).agg(F.min(F.struct("step", "match")).alias("_b"))
    return left.join(best, key, "left").withColumn("match", F.col("_b.match")).withColumn("step", F.col("_b.step")).drop("_b")


def pattern_join(texts: DataFrame, patterns: DataFrame, text: str, pattern: str) -> DataFrame:
    """texts with each row of patterns whose regular expression is found; patterns are a stated small set."""
    return texts.join(small(patterns), F.expr(f"{text} RLIKE {pattern}"))


def as_of(events: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """events with the value of the last mark at or before them, by key.

    Both sides go through one sort by key and place; no pair of rows is formed.
    """
    both = events.withColumn("_v", F.lit(None).cast(dict(marks.dtypes)[value])).withColumn("_mark", F.lit(0))
    side = marks.select(*keys, F.col(at), F.col(value).alias("_v"), F.lit(1).alias("_mark"))
    order = Window.partitionBy(*keys).orderBy(F.col(at), F.col("_mark").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = both.unionByName(side, allowMissingColumns=True).withColumn(value, F.last(F.when(F.col("_mark") == 1, F.col("_v")), ignorenulls=True).over(order))
    return full.where("_mark = 0").drop("_v", "_mark")


def keep_joined(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose both ends are nodes, and the others."""
    ids = nodes.select("id").distinct()
    start = ids.select(F.col("id").alias("src"), F.lit(True).alias("_s"))
    end = ids.select(F.col("id").alias("dst"), F.lit(True).alias("_d"))
    marked = edges.join(start, "src", "left").join(end, "dst", "left").withColumn("_ok", F.col("_s").isNotNull() & F.col("_d").isNotNull())
    return marked.where("_ok").select(*edges.columns), marked.where("NOT _ok").select(*edges.columns)


def donors(rows: DataFrame, key: Column, eligible: Column, empty: Column, score: list[str], take: list[str]) -> DataFrame:
    """Rows that lack something take it from the best eligible row of the same key, which is never a row that was filled itself."""
    have = rows.where(eligible & ~empty).select(key.alias("_k"), F.struct(*score).alias("_s"), F.struct(*take, F.col("id").alias("donor")).alias("_t"))
    best = have.groupBy("_k").agg(F.max_by("_t", "_s").alias("_t"))
    out = rows.withColumn("_k", key).withColumn("_e", empty).join(best, "_k", "left")
    for c in take:
        out = out.withColumn(c, F.when(F.col("_e") & F.col("_t").isNotNull(), F.col(f"_t.{c}")).otherwise(F.col(c)))
    return out.withColumn("filled_from", F.when(F.col("_e"), F.col("_t.donor"))).drop("_k", "_e", "_t")
