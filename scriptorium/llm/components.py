"""Connected components by contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import join_spread, materialise


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of links (u long, v long).

    Each round a node joins the least node among itself and its neighbours, and
    the links are carried over to those nodes, until none is left. Node ids
    should be in random order, so that rounds grow as the logarithm of the
    longest chain. Minima are taken with partial aggregation, and the links of a
    node that holds many of all links are dealt out in joins, so no node's
    neighbours meet in one task; lineage is cut every round.
    """
    edges = materialise(links.where("u <> v").select("u", "v").distinct(), "edges")
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    roots = None
    while not edges.isEmpty():
        parents = materialise(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("degree")).select("node", F.least("node", "least").alias("parent"), "degree"), "parents")
        total = 2 * edges.count()
        if roots is None:
            roots = parents.select("node", F.col("parent").alias("root"))
        else:
            p = parents.select(F.col("node").alias("root"), "parent")
            held = materialise(roots.groupBy("root").count().join(p, "root", "left"), "root-sizes")
            roots = join_spread(roots, held, "root", "count", held.agg(F.sum("count")).first()[0], ["node"]).select("node", F.coalesce("parent", "root").alias("root"))
        roots = materialise(roots, "roots")
        at_u = parents.select(F.col("node").alias("u"), F.col("parent").alias("pu"), "degree")
        at_v = parents.select(F.col("node").alias("v"), F.col("parent").alias("pv"), "degree")
        carried = join_spread(join_spread(edges, at_u, "u", "degree", total, ["v"]), at_v, "v", "degree", total, ["u"])
        edges = materialise(carried.where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "edges")
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    return roots if roots is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
