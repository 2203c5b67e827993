"""The property graph: nodes (id, kind, label), edges (id, kind, src, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.joins import first_wins, keep_joined
from scriptorium.operators.lineage import cut


def union_nodes(parts: list[DataFrame]) -> DataFrame:
    """Nodes of all parts; of equal ids the one of the earliest part stays."""
    ranked = [p.select("id", "kind", "label").withColumn("_rank", F.lit(i)) for i, p in enumerate(parts)]
    return first_wins(reduce(DataFrame.unionByName, ranked), ["id"], ["_rank", "kind", "label"]).drop("_rank")


def edge(rows: DataFrame, kind: str, src: Column, dst: Column) -> DataFrame:
    """Edges of a kind, with ids that name it and its ends."""
    return rows.select(src.cast("string").alias("src"), dst.cast("string").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct().select(F.concat(F.lit(f"{kind}:"), F.col("src"), F.lit("->"), F.col("dst")).alias("id"), F.lit(kind).alias("kind"), "src", "dst")


def guard(edges: DataFrame, nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Joined edges and the counts of the dangling by kind; more than ``most`` of those is an error."""
    good, bad = keep_joined(edges, nodes)
    skipped = bad.groupBy("kind").agg(F.count(F.lit(1)).alias("skipped"))
    lost = skipped.agg(F.sum("skipped")).first()[0] or 0
    if lost > most:
        raise ValueError(f"{lost} edges without a node; {most} are allowed")
    return good, skipped


def neighbours(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
    """seed, edge, kind, id, label of what is one step from the seeds: out, in or both."""
    if kinds:
        edges = edges.where(F.col("kind").isin(kinds))
    out = edges.select(F.col("src").alias("seed"), F.col("id").alias("edge"), "kind", F.col("dst").alias("other"))
    into = edges.select(F.col("dst").alias("seed"), F.col("id").alias("edge"), "kind", F.col("src").alias("other"))
    steps = {"out": out, "in": into, "both": out.union(into)}[direction]
    ends = nodes.select(F.col("id").alias("other"), "label")
    return steps.join(seeds.select(F.col("id").alias("seed")).distinct(), "seed", "left_semi").join(ends, "other").select("seed", "edge", "kind", F.col("other").alias("id"), "label")


def neighbourhood(edges: DataFrame, nodes: DataFrame, seed: str, depth: int, most: int = 80, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes within depth (1 to 3) steps of the seed, nearest and then least ids first up to ``most``, and the edges among them."""
    depth = min(max(depth, 1), 3)
    allowed = nodes if kinds is None else nodes.where(F.col("kind").isin(kinds))
    both = cut(edges.select(F.col("src").alias("id"), F.col("dst").alias("next")).union(edges.select("dst", "src")))
    front = nodes.where(F.col("id") == seed).select("id")
    seen = front.withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        front = both.join(front, "id", "left_semi").select(F.col("next").alias("id")).distinct().join(allowed.select("id"), "id", "left_semi").join(seen, "id", "left_anti")
        front = cut(front)
        seen = seen.union(front.withColumn("hop", F.lit(hop)))
    kept = seen.orderBy("hop", "id").limit(most)
    ids = kept.select("id")
    inner = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept, inner


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, kind, edges: the ids of each node's outgoing edges, sorted."""
    own = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("edges"))
    return nodes.select("id", "kind").join(own, "id", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<string>")))


def statistics(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def find_nodes(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """Nodes whose id is the query, then whose label is, then whose label holds it."""
    tier = F.when(F.col("id") == query, 0).when(F.col("label") == query, 1).when(F.contains(F.lower("label"), F.lit(query.lower())), 2)
    return nodes.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", "label", "id").limit(limit)


def connected(links: DataFrame, rounds: int = 50) -> DataFrame:
    """id, root of the components of links (a, b); root is the least id. For sets of names and the like."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    roots = cut(both.select(F.col("a").alias("id")).distinct().withColumn("root", F.col("id")))
    for _ in range(rounds):
        least = both.join(roots.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("least"))
        hooked = roots.join(least, "id").select("id", F.least("root", "least").alias("root"))
        jumped = cut(hooked.join(hooked.select(F.col("id").alias("root"), F.col("root").alias("up")), "root", "left").select("id", F.least("root", F.coalesce("up", "root")).alias("root")))
        changed = jumped.join(roots.withColumnRenamed("root", "old"), "id").where("root <> old").limit(1).count()
        roots = jumped
        if not changed:
            return roots
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def reachable(edges: DataFrame, roots: DataFrame, most: int = 100) -> DataFrame:
    """tree, id, depth of what the roots (tree, id) reach along edges (tree, src, dst); a circle is an error."""
    edges.createOrReplaceTempView("_reach_edges")
    roots.createOrReplaceTempView("_reach_roots")
    found = edges.sparkSession.sql(
        f"""
        WITH RECURSIVE walk(tree, id, depth) MAX RECURSION LEVEL {most} AS (
          SELECT tree, id, 0 FROM _reach_roots
          UNION ALL
          SELECT e.tree, e.dst, w.depth + 1 FROM walk w JOIN _reach_edges e ON e.tree = w.tree AND e.src = w.id
        )
        SELECT tree, id, min(depth) AS depth FROM walk GROUP BY tree, id
        """
    )
    return found


def rank_in(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
