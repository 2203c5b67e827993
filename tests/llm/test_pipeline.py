"""The pipeline against its parts, and the registry."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scriptorium.llm import registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "byte-level BPE"]
    assert {"pipeline", *registry.QUERIES} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "l")]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + "."
    items = [prose(30) for _ in range(5)]
    rows = [(i, prose(90)) for i in range(60)]
    clean = {i for i, _ in rows}
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # copies
    rows += [(200 + i, rows[i][1] + " more words here") for i in range(5)]  # near copies
    rows += [(300 + i, f"{prose(40)} {items[i]} {prose(40)}") for i in range(5)]  # leaks
    rows += [(400 + i, " ".join(w + "###" for w in prose(60).split())) for i in range(3)]  # junk
    rows += [(500, None), (501, "short"), (502, "word " * 100)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids", "intact"]
    got = out.collect()
    assert {r["doc_id"] for r in got} == clean and len(got) == len(clean)
    assert all(r["intact"] and r["n_tokens"] == len(r["ids"]) > 0 for r in got)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert docs.where(F.col("doc_id") == 100).count() == 1
