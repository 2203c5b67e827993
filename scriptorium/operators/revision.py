"""Corrections and renamings, and checks of trees and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.lineage import cut


def apply_errata(text: str, errata: list[tuple[str, str]]) -> str:
    """text after all replacements in order; each must be found exactly once, overlaps counted."""
    for find, replace in errata:
        n = sum(text.startswith(find, i) for i in range(len(text))) if find else 0
        if n != 1:
            raise ValueError(f"{find!r} occurs {n} times")
        text = text.replace(find, replace)
    return text


def occurrences(text: Column, find: Column) -> Column:
    """How often find occurs in text, without overlaps."""
    return F.when(find == "", 0).otherwise((F.char_length(text) - F.char_length(F.replace(text, find, F.lit("")))) / F.char_length(find)).cast("int")


def rename_ids(df: DataFrame, columns: list[str], table: dict[str, str]) -> DataFrame:
    """df with exact ids of columns (strings or arrays) renamed, once and not through chains."""
    kinds = dict(df.dtypes)
    pairs = df.sparkSession.createDataFrame(sorted(table.items()), "old string, new string")
    for c in columns:
        if kinds[c].startswith("array"):
            names = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
            df = df.withColumn(c, F.transform(c, lambda x: F.coalesce(names[x], x)))
        else:
            own = F.broadcast(pairs.select(F.col("old").alias(c), F.col("new").alias("_new")))
            df = df.join(own, c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return df


def align_versions(old: list[tuple[str, str]], new: list[tuple[str, str]], merged: dict[str, str]) -> dict[str, str]:
    """Old ids to new ones of two ordered lists (id, text) with the same texts; what is left of the old must be in merged."""
    out, at = {}, 0
    for key, text in old:
        hit = next((k for k in range(at, len(new)) if new[k][1] == text), None)
        if hit is None:
            if key not in merged:
                raise ValueError(f"{key} has no successor")
            out[key] = merged[key]
        else:
            out[key], at = new[hit][0], hit + 1
    return out


def tree_violations(options: DataFrame, roots: DataFrame, depth: int = 100) -> DataFrame:
    """tree, id, rule of decision trees: options (tree, id, option, next, result), roots (tree, id).

    Each option has either a next node or a result; nexts exist; all nodes are reached; no node reaches itself."""
    nodes = options.select("tree", "id").distinct()
    one = options.where(F.col("next").isNull() == F.col("result").isNull()).select("tree", "id", F.lit("next or result").alias("rule"))
    edges = options.where("next IS NOT NULL").select("tree", F.col("id").alias("src"), F.col("next").alias("dst"))
    lost = edges.join(nodes.withColumnRenamed("id", "dst"), ["tree", "dst"], "left_anti").select("tree", F.col("dst").alias("id"), F.lit("no such node").alias("rule"))
    rootless = roots.join(nodes, ["tree", "id"], "left_anti").select("tree", "id", F.lit("no root").alias("rule"))
    seen, front = roots.select("tree", "id").distinct(), roots.select("tree", "id").distinct()
    count = nodes.count()
    for _ in range(min(depth, count)):
        front = cut(edges.join(front.withColumnRenamed("id", "src"), ["tree", "src"]).select("tree", F.col("dst").alias("id")).distinct().join(seen, ["tree", "id"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.union(front))
    unreached = nodes.join(seen, ["tree", "id"], "left_anti").select("tree", "id", F.lit("not reached").alias("rule"))
    # What is left after taking away nodes without successors, again and again, lies on or before a circle.
    left = edges
    while True:
        sources = left.select("tree", F.col("src").alias("dst")).distinct()
        rest = cut(left.join(sources, ["tree", "dst"], "left_semi").select("tree", "src", "dst"))
        if rest.count() == left.count():
            break
        left = rest
    circle = left.select("tree", F.col("src").alias("id"), F.lit("circle").alias("rule")).distinct()
    return one.union(lost).union(rootless).union(unreached).union(circle)


def check_annotations(entries: DataFrame, sources: DataFrame, vocabulary: list[str]) -> DataFrame:
    """entries (id, key, tag, quote) with ``reject``: hash, vocabulary, quote, or null."""
    from scriptorium.functions.text import contains_loosely

    own = sources.select("id", F.col("key").alias("_key"), F.col("text").alias("_text"))
    out = entries.join(own, "id", "left")
    why = F.when(F.col("_key").isNull(), "no source").when(F.col("_key") != F.col("key"), "hash").when(~F.col("tag").isin(vocabulary), "vocabulary").when(~contains_loosely(F.col("_text"), F.col("quote")), "quote")
    return out.select(*entries.columns, why.alias("reject"))
