"""The corpus pipeline: quality rules, near-dedup, decontamination, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next one's docs. All but the last return the
columns of documents; the last adds n_tokens, ids and intact, which says that
decoding the ids gives the text's bytes.

Defined cases: null, empty and very short texts fail the base rules and go in the
first stage; of rows with the same id and text one stays, and rows without an id
stay; of equally good copies the one with the smallest id stays; an empty table
gives an empty result with the same columns; further columns are carried through,
whatever their names, but for the last stage's own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, decontaminate, minhash, quality
from scriptorium.llm._common import materialise, table

RANKS = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return minhash.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, decoded again to see that nothing is lost; own columns of the new names are replaced."""
    codec = bpe.Codec(spark, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    coded = codec.encode(docs)
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return coded.withColumn("intact", codec.decode(F.col("ids")) == text).drop("packed")


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: The stages are iterative or need the tokenizer, so SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
