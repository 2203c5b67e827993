"""Exact dedup by block naming: brute force over odd rows, small blocks, hot copies."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import exact_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997} x{i}" for i in range(20_000))
ROWS = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "Same Text"),
    (5, "sAME tEXT"),
    (6, "ÄRGER"),
    (7, "äRGER"),
    (8, "Ärger"),
    (9, LONG),
    (10, LONG.upper()),
    (11, LONG + "y"),
    (12, "y" + LONG),
    (13, "same text"),
    (13, "SAME TEXT"),
    (None, "same text"),
    (None, "only without id"),
    (None, "only without id"),
    (14, "abababab"),
    (15, "abababababababab"),
    (16, "ababababa"),
    (17, "x" * 512),
    (18, "x" * 513),
    (19, "x" * 1024),
    (20, "X" * 1024),
    (21, "x" * 512 + "\x00"),
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        out += [(i, top, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(map(repr, out)), {lower(t): max((i for i in groups[lower(t)] if i is not None), default=None) for _, t in rows}


@pytest.mark.parametrize("size", [4, 512])
def test_judge_equals_brute_force(spark, size):
    rows = ROWS if size > 4 else [r for r in ROWS if len(r[1] or "") < 5000]
    df = docs(spark, rows).repartition(5)
    got = exact_dedup.judge(df.withColumn("ident", F.lit("own")).withColumn("block", F.lit("own")), size).collect()
    want, stays = brute(rows)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert sorted(repr(r.keep_id) for r in kept) == sorted(map(repr, stays.values()))


def test_keep_has_one_row_of_each_text_with_its_columns(spark):
    df = docs(spark, ROWS).withColumn("row", F.lit("own")).withColumn("key", F.lit(1)).withColumn("ID", F.lit(2))
    got = exact_dedup.keep(df)
    assert got.columns == df.columns
    rows = got.collect()
    _, stays = brute(ROWS)
    assert sorted(repr((lower(r.text), r.doc_id)) for r in rows) == sorted(repr(x) for x in stays.items())
    assert {r.row for r in rows} == {"own"}


def test_a_hot_text_spreads_over_partitions(spark):
    """A third of all rows are one text of many blocks; equal keys then lie on both sides of partitions' borders."""
    hot = "hot text of many blocks " * 40
    rows = [(i, hot if i % 3 == 0 else f"{i} " + "cold " * (i % 50)) for i in range(900)]
    got = exact_dedup.judge(docs(spark, rows).repartition(7), 16)
    want, _ = brute(rows)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got.collect()) == want
    blocks = exact_dedup._blocks(docs(spark, rows), 16)
    placed = blocks.repartitionByRange(8, "block", "key", "pos").withColumn("pid", F.spark_partition_id())
    sizes = [r["count"] for r in placed.groupBy("pid").count().collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes)


def test_empty_table(spark):
    got = exact_dedup.judge(docs(spark, []))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert got.collect() == []
    assert exact_dedup.keep(docs(spark, [])).collect() == []


def test_ids_of_other_types(spark):
    for kind, ids in (("string", ["b", "a", None]), ("decimal(9,2)", None), ("smallint", None)):
        df = docs(spark, [(1, "t"), (2, "T"), (3, "u")])
        df = df.withColumn("doc_id", F.element_at(F.array(*map(F.lit, ids)), F.col("doc_id").cast("int")) if ids else F.col("doc_id").cast(kind))
        got = {(str(r.keep_id), r.group_size) for r in exact_dedup.judge(df).collect()}
        assert len(got) == 2 and {n for _, n in got} == {1, 2}


def test_cut_gives_all_bytes_in_order():
    texts = pa.array(["", "abc", "abcd", "é" * 5, "abcdefghi"])[1:]
    blocks, counts = exact_dedup.cut(texts, 4)
    assert counts.tolist() == [1, 1, 3, 3]
    assert b"".join(blocks.to_pylist()).decode() == "".join(texts.to_pylist())
    assert max(map(len, blocks.to_pylist())) == 4
    assert exact_dedup.cut(pa.array(["", ""]), 4)[0].to_pylist() == [b"", b""]


def test_rank_partition_over_batches():
    values = [1, 1, 2, 2, 2, 5, 7, 7]
    for cuts in ([8], [1] * 8, [3, 0, 5]):
        batches, at = [], 0
        for n in cuts:
            batches.append(pa.record_batch({"k": pa.array(values[at : at + n], pa.int64()), "c": pa.array(range(at, at + n))}))
            at += n
        out = pa.Table.from_batches(list(exact_dedup.rank_partition(iter(batches), ["k"])))
        assert out["rank"].to_pylist() == (np.unique(values, return_inverse=True)[1] + 1).tolist()
        assert out["edge"].to_pylist() == [True, *[False] * 6, True]
        assert out["k"].to_pylist() == [1, *[None] * 6, 7]
    assert list(exact_dedup.rank_partition(iter([]), ["k"])) == []
