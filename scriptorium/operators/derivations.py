"""Bundles that are given by what they change in another one, resolved by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.joins import first_wins, last_wins
from scriptorium.operators.lineage import cut


def resolve(blocks: DataFrame, group: str) -> DataFrame:
    """blocks (group, pos, name, base, removed, added, items) with the items of those that have none of their own worked out from their base's.

    Changes (removed, added) of a chain can be put together before its root is known: after (r1, a1) the change (r2, a2) is (r1 and r2, what
    r2 leaves of a1, then a2). So each round doubles how far a block sees, and rounds grow as the logarithm of the
    longest chain. A base that is missing, or leads round in a circle, resolves nothing: items stay empty. Of blocks with
    one name the last with items of its own is the root, and the first without is what others derive from."""
    empty = F.array().cast("array<string>")
    filled = [F.coalesce(c, empty).alias(c) for c in ("removed", "added", "items")]
    held = cut(blocks.select(group, "pos", "name", "base", *filled))
    roots = last_wins(held.where(F.size("items") > 0).select(group, "name", "pos", "items"), [group, "name"], ["pos"]).select(group, F.col("name").alias("to"), F.col("items").alias("root"))
    asked = held.where((F.size("items") == 0) & F.col("base").isNotNull())
    links = asked.select(group, "pos", "name", F.col("base").alias("to"), "removed", "added")
    named = first_wins(links, [group, "name"], ["pos"]).join(roots.select(group, F.col("to").alias("name")), [group, "name"], "left_anti")
    longest = named.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length()):
        step = named.select(group, F.col("name").alias("to"), F.col("to").alias("_to"), F.col("removed").alias("_r"), F.col("added").alias("_a"))
        far = F.col("_to").isNotNull()

        def followed(df: DataFrame, step: DataFrame = step) -> DataFrame:
            met = df.join(step, [group, "to"], "left")
            removed = F.when(far, F.array_distinct(F.concat("_r", "removed"))).otherwise(F.col("removed"))
            added = F.when(far, F.concat(F.filter("_a", lambda x: ~F.array_contains("removed", x)), "added")).otherwise(F.col("added"))
            # Other names first: one that is also an alias of the same select would stand for the alias in a lambda.
            out = met.select(group, "pos", "name", F.coalesce("_to", "to").alias("_t"), removed.alias("_x"), added.alias("_y"))
            return out.toDF(group, "pos", "name", "to", "removed", "added")

        links, named = cut(followed(links)), cut(followed(named))
        if links.join(named.select(group, F.col("name").alias("to")), [group, "to"], "left_semi").isEmpty():
            break
    found = links.join(roots, [group, "to"])
    kept = F.filter("root", lambda x: ~F.array_contains("removed", x))
    items = found.select(group, "pos", "name", F.concat(kept, "added").alias("_items"))
    return held.join(items, [group, "pos", "name"], "left").withColumn("items", F.coalesce("_items", "items")).drop("_items")
