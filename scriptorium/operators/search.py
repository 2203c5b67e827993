"""Full-text search and vocabulary matching."""

from __future__ import annotations

import math
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.shipping import ship, small_batches

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bm25(docs: DataFrame, terms: list[str], limit: int, fuzzy: int = 0) -> DataFrame:
    """id, score of the best documents (id, text) for the terms as prefixes, or within an edit distance.

    Only words that meet a term are exploded; lengths and document
    frequencies come from the same pass."""
    own = docs.select("id", tokens(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    n, mean = own.agg(F.count(F.lit(1)), F.avg("n")).first()

    def part(t: str) -> Column:
        meets = lambda w: w.startswith(t) | (F.levenshtein(w, F.lit(t), fuzzy) >= 0 if fuzzy else F.lit(False))
        return F.struct(F.lit(t).alias("term"), F.size(F.filter("w", meets)).alias("tf"))

    parts = [part(t) for t in terms]
    hits = own.select("id", "n", F.explode(F.filter(F.array(*parts), lambda p: p["tf"] > 0)).alias("h")).select("id", "n", "h.term", "h.tf")
    df = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    idf = F.create_map(*[F.lit(x) for t in terms for x in (t, math.log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)))])
    score = idf[F.col("term")] * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / (mean or 1.0)))
    return hits.groupBy("id").agg(F.round(F.sum(score), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def longest_matches(text: str, automaton) -> list[tuple[int, int, str]]:
    """start, end, term of the terms in text: longer ones first, then earlier ones, none overlapping; in text order."""
    hits = sorted(((end - len(t) + 1, end + 1, t) for end, t in automaton.iter(text)), key=lambda h: (h[0] - h[1], h[0]))
    taken = bytearray(len(text))
    out = []
    for a, z, t in hits:
        if not any(taken[a:z]):
            taken[a:z] = b"\x01" * (z - a)
            out.append((a, z, t))
    return sorted(out)


def annotate(docs: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """id, mentions: array of (start, end, surface, term) of a controlled vocabulary (surface, term), a stated list."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    table = dict(terms)
    names = ["start", "end", "surface", "term"]

    def run(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for surface in table:
            machine.add_word(surface, surface)
        machine.make_automaton()
        for b in batches:
            found = [longest_matches(t or "", machine) for t in b["text"].to_pylist()]
            flat = [m for own in found for m in own]
            surfaces = [m[2] for m in flat]
            columns = [pa.array([m[0] for m in flat], pa.int32()), pa.array([m[1] for m in flat], pa.int32()), pa.array(surfaces, pa.string()), pa.array([table[x] for x in surfaces], pa.string())]
            ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
            yield pa.RecordBatch.from_arrays([b["id"], pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, names))], ["id", "mentions"])

    kind = dict(docs.dtypes)["id"]
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, mentions array<struct<start:int,`end`:int,surface:string,term:string>>")


def search_documents(parts: dict[str, DataFrame]) -> DataFrame:
    """kind, id, title, text of all parts, which have the last three."""
    out = None
    for kind, df in parts.items():
        own = df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "title", "text")
        out = own if out is None else out.unionByName(own)
    return out
