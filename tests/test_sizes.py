"""Queries whose tasks must not grow with their tables: parts by the rows, and rows that aren't multiplied before a shuffle."""

import random
import re

import duckdb
import pytest

from scriptorium.operators import joins, linkage, postings, search
from scriptorium.plans import catalog


@pytest.fixture
def tables(spark, tmp_path):
    """Small tables with frequent items, rows that are repeated, and rows that lack a key."""
    lines = [(b, (b * k) % 13, b % 5) for b in range(60) for k in range(1, 2 + b % 6)] + [(7, 3, 1), (7, 3, 1), (None, 3, 1), (None, 4, 1), (8, None, 1), (999, 1, 1)]
    orders = [(b, f"{b % 4}-tag" if b % 9 else None) for b in range(60)]
    parts = [(k, f"brand {k % 3}" if k % 17 else None, f"name {k % 4}" if k % 19 else None, k % 2 if k % 23 else None, f"type {k % 3}" if k % 5 else None) for k in range(120)]
    kinds = {"lineitem": "l_orderkey long, l_partkey long, l_suppkey long", "orders": "o_orderkey long, o_orderpriority string", "part": "p_partkey long, p_brand string, p_name string, p_size int, p_type string"}
    for name, rows in (("lineitem", lines), ("orders", orders), ("part", parts)):
        spark.createDataFrame(rows, kinds[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(df, folder, name):
    db = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    cursor = db.execute(catalog.ORACLE_SQL[name])
    at = [[c[0] for c in cursor.description].index(c) for c in df.columns]
    want = sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["co_occurrence", "tag_rates", "alias_groups"])
def test_parts_follow_the_rows(spark, tables, name, monkeypatch):
    monkeypatch.setattr(joins, "PART_ROWS", 10)
    rows = spark.read.parquet(f"{tables}/lineitem.parquet").count()
    df = catalog.QUERIES[name](spark, tables)
    dealt = [int(n) for n in re.findall(r"Exchange hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan(df))]
    assert dealt and min(dealt) >= rows / 10
    same(df, tables, name)


def test_related_rows_shuffles_no_pair(spark, tables):
    df = catalog.QUERIES["related_rows"](spark, tables)
    found = plan(df)
    assert "Exchange" in found and "Exchange" not in found[: found.index("Generate explode")]
    same(df, tables, "related_rows")


@pytest.mark.parametrize("name", ["phrase_conversion", "offset_maps", "vocabulary_mentions", "dice_best_match"])
def test_python_gets_small_batches(spark, name):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(256 << 20))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_grams_are_held_against_each_other_in_place(spark):
    texts = ["", "a", "ab", "abc", "abcabc", "größe 𝔞bc", "𝔞bcd", "a\nb c", "no part of it", None]
    left = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    right = spark.createDataFrame([(100 - i, t) for i, t in enumerate([*texts, "abcd", "abcd"])], "id long, text string").repartition(3)

    def grams(t):
        return {t[i : i + 3] for i in range(len(t) - 2)} or {t}

    want = {}
    for i, x in enumerate(texts):
        for k, y in enumerate([*texts, "abcd", "abcd"]):
            if x is not None and y is not None and (both := len(grams(x) & grams(y))):
                want[i, 100 - k] = 2 * both / (len(grams(x)) + len(grams(y)))
    found = linkage.dice_pairs(left, right)
    assert "Generate" not in plan(found) and "Exchange hashpartitioning" not in plan(found)
    assert {(r["left_id"], r["right_id"]): r["dice"] for r in found.collect()} == want
    assert {(r[0], r[1]) for r in linkage.dice_pairs(left, right, least=0.5).collect()} == {p for p, d in want.items() if d >= 0.5}
    best = {r["left_id"]: r["right_id"] for r in linkage.best_match(left, linkage.dice_pairs(left, right, best=True), 0.0).collect()}
    assert best == {i: min(((-round(d, 3), k) for (j, k), d in want.items() if j == i), default=(0, None))[1] for i in range(len(texts))}


@pytest.mark.parametrize("least", [0.2, 0.25, 0.5, 1.0])
def test_similar_bags_meet_at_pairs_of_items(spark, least):
    pick = random.Random(3)
    rows = [(b, i) for b in range(80) for i in pick.sample(range(20), pick.randint(1, 7))]
    rows += [(3, None), (4, None), (None, 5), (77, None), (90, None), *rows[:9]]
    held = {}
    for b, i in rows:
        if b is not None:
            held.setdefault(b, set()).add(i)
    want = {(a, b) for a in held for b in held if a < b and (s := len((held[a] & held[b]) - {None})) and s / (len(held[a]) + len(held[b]) - s) >= least}
    found = [tuple(r) for r in linkage.similar(spark.createDataFrame(rows, "bag long, item long"), least, 3).collect()]
    assert len(found) == len(want) and set(found) == want


def test_postings_are_made_where_their_window_lies(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b{i % 7} b{i % 3} b{i % 3} Größe") for i in range(300)] + [(900, None), (901, "")], "id long, text string")
    index = postings.build(docs, f"file://{tmp_path}/index", 16, fuzzy=False)
    assert not (tmp_path / "index" / "near").exists()
    for r in index.blocks.collect():
        assert r["held"] == len(r["postings"]) and [p["id"] for p in r["postings"]] == sorted(p["id"] for p in r["postings"])
    assert sum(r["held"] for r in index.blocks.where("word = 'a'").collect()) == 300
    got = [(r["id"], r["score"]) for r in index.search(["b1", "grö"], 40).collect()]
    assert got == [(r["id"], r["score"]) for r in search.bm25(docs, ["b1", "grö"], 40).collect()]
    with pytest.raises(ValueError, match="deletions"):
        index.search(["b1"], 40, fuzzy=True)
