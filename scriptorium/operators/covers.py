"""Labels of several parts that a vocabulary covers as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cover(labels: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id, covered, concepts, rest of labels (id, parts) by a vocabulary (term, concept).

    A label is covered if each of its parts is a term; concepts are those of the covered parts, by part, and rest holds the others. A
    term of several concepts stands for the least. The parts are joined as rows and counted, so no combination of parts is ever made.
    Parts that are null don't count; a label without parts isn't covered."""
    terms = vocabulary.where("term IS NOT NULL").groupBy("term").agg(F.min("concept").alias("concept"))
    asked = labels.select("id", F.explode(F.array_distinct(F.filter("parts", lambda p: p.isNotNull()))).alias("term")).groupBy("id", "term").agg(F.lit(1).alias("_"))
    met = asked.join(terms, "term", "left").withColumn("hit", F.struct("term", "concept"))
    found = met.groupBy("id").agg(
        F.count(F.lit(1)).alias("all"),
        F.count("concept").alias("some"),
        F.array_sort(F.collect_list(F.when(F.col("concept").isNotNull(), F.col("hit")))).alias("hits"),
        F.array_sort(F.collect_list(F.when(F.col("concept").isNull(), F.col("term")))).alias("rest"),
    )
    none = F.array().cast("array<string>")
    out = labels.select("id").distinct().join(found, "id", "left")
    return out.select("id", F.coalesce(F.col("all") == F.col("some"), F.lit(False)).alias("covered"), F.coalesce(F.transform("hits", lambda h: h["concept"]), none).alias("concepts"), F.coalesce("rest", none).alias("rest"))
