"""Evidence: records (entity, field, source, grp, locator, verdict) and what they amount to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.joins import first_wins

VERDICTS = ["agree", "variant", "mismatch", "missing"]


def merge(records: DataFrame, key: list[str], order: list[str], valid: Column) -> tuple[DataFrame, DataFrame]:
    """Valid records, the first of each key, and the invalid ones."""
    return first_wins(records.where(valid), key, order), records.where(~F.coalesce(valid, F.lit(False)))


def field_levels(records: DataFrame, baseline: str, advisory: list[str], authoritative: list[str]) -> DataFrame:
    """entity, field, level: corroborated, disputed or single.

    The baseline group doesn't count, nor does a mismatch of an advisory one. A
    mismatch of an authoritative group outweighs what agrees."""
    counts = records.where((F.col("grp") != baseline) & ~(F.col("grp").isin(advisory) & (F.col("verdict") == "mismatch")))
    flags = records.select("entity", "field").distinct().join(
        counts.groupBy("entity", "field").agg(
            F.max(F.col("verdict").isin("agree", "variant")).alias("yes"),
            F.max(F.col("verdict") == "mismatch").alias("no"),
            F.max((F.col("verdict") == "mismatch") & F.col("grp").isin(authoritative)).alias("against"),
        ),
        ["entity", "field"],
        "left",
    )
    level = F.when(F.col("yes") & F.col("against"), "disputed").when(F.col("yes"), "corroborated").when(F.col("no"), "disputed").otherwise("single")
    return flags.select("entity", "field", level.alias("level"))


def entity_levels(fields: DataFrame, keys: list[str]) -> DataFrame:
    """entity, level: disputed if any key field is, else that of the first key field present."""
    one = fields.where(F.col("field").isin(keys))
    rank = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("field"))
    best = one.groupBy("entity").agg(F.max(F.col("level") == "disputed").alias("d"), F.min_by("level", rank).alias("first"))
    return best.select("entity", F.when(F.col("d"), "disputed").otherwise(F.col("first")).alias("level"))


def levels_by_source(levels: DataFrame, sources: DataFrame) -> DataFrame:
    """source and the number of its entities at each level, zeros included; entities without a level are unchecked."""
    names = ["single", "corroborated", "disputed", "unchecked"]
    both = sources.join(levels, "entity", "left").withColumn("level", F.coalesce("level", F.lit("unchecked")))
    return both.groupBy("source").agg(*[F.count(F.when(F.col("level") == n, 1)).alias(n) for n in names])


def tally(records: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates (four decimals) of the verdicts and the mean ratio without the missing."""
    n = F.count(F.lit(1))
    out = [F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in VERDICTS]
    rates = [F.round(F.count(F.when(F.col("verdict") == v, 1)) / n, 4).alias(f"{v}_rate") for v in VERDICTS]
    return records.groupBy(*keys).agg(n.alias("records"), *out, *rates, F.round(F.avg(F.when(F.col("verdict") != "missing", F.col("ratio"))), 4).alias("mean_ratio"))


def ranked_pairs(pairs: DataFrame, partial: list[str], most: int) -> DataFrame:
    """local, witness, n, sources, example of the most frequent replacements; partial lists are merged by the same sums."""
    return pairs.groupBy("local", "witness").agg(F.sum("n").alias("n"), F.countDistinct("source").alias("sources"), F.min("example").alias("example")).orderBy(F.desc("n"), "local", "witness").limit(most)


def hotspots(records: DataFrame, key: list[str], least_rate: float = 0.8, least: int = 3, most: int = 5) -> DataFrame:
    """The keys with nearly only anomalies, most anomalies and first seen first."""
    odd = F.count(F.when(F.col("verdict").isin("mismatch", "missing"), 1))
    found = records.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), odd.alias("anomalies"), F.min("pos").alias("first"))
    return found.where((F.col("n") >= least) & (F.col("anomalies") >= least_rate * F.col("n"))).orderBy(F.desc("anomalies"), "first").limit(most)
