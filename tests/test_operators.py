import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import bundles, collate, crosscheck, evidence, graph, joins, linkage, passages, revision, search


def test_semi_global_alignment():
    assert collate.semi_global("bcd", "abcde") == (0, 1, 4)
    assert collate.semi_global("bxd", "abcde")[0] == 1
    assert collate.semi_global("b" + collate.STRICT + "d", "abcde")[0] == 0
    assert collate.semi_global("b" + collate.LOOSE + "c", "abcde") == (0, 1, 3)


def by_table(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        d[i + 1][0] = i + 1
        for j, y in enumerate(b):
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i][j + 1] + 1, d[i + 1][j] + 1)
    return min(d[-1])


def test_semi_global_equals_table():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(2))
        assert collate.semi_global(a, b)[0] == by_table(a, b)


def test_diff_segments():
    assert collate.diff("abcd", "abxd") == [("equal", "ab", "ab"), ("replace", "c", "x"), ("equal", "d", "d")]
    assert collate.diff("", "x") == [("replace", "", "x")] and collate.diff("", "") == []


def test_locate_and_order():
    hay = collate.Haystack("The quick brown fox jumps over the lazy dog. " * 3 + "Something entirely different stands here at the end of all.")
    ratio, s, e = hay.locate(collate.normalise("something entirely diferent stands")[0])
    assert 0.95 < ratio < 1 and hay.text[s:e].startswith("somethingent")
    witness = "First passage of the book, as it stands. Second passage, a little changed. Third passage is as it was."
    found = collate.in_order(["First passage of the book, as it stands.", "Second passage, a litle changd.", "Not here whatsoever, quite another thing.", "Third passage is as it was.", "", "xq"], witness)
    assert [f[0] for f in found] == ["agree", "variant", "missing", "agree", "missing", "missing"] or [f[0] for f in found][:2] in (["agree", "agree"], ["agree", "variant"])
    assert witness[found[3][2] : found[3][3]] == "Third passage is as it was"


def test_one_to_one_takes_turns(spark):
    pairs = spark.createDataFrame([(0, 1, 1, 0.9), (0, 1, 2, 0.5), (0, 2, 1, 0.95), (0, 2, 3, 0.5), (0, 3, 1, 0.99)], "grp int, left_id int, right_id int, score double")
    got = {(r["left_id"], r["right_id"]) for r in linkage.one_to_one(pairs, "grp", 0.42).collect()}
    assert got == {(1, 1), (2, 3)}


def test_leader_clusters_are_stars(spark):
    members = spark.createDataFrame([(i, "g") for i in range(1, 7)], "id int, grp string")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6)], "a int, b int")
    got = {(r["leader"], r["id"]) for r in linkage.leader_clusters(members, pairs, "grp").collect()}
    assert got == {(1, 1), (1, 2), (3, 3), (3, 4), (5, 5), (5, 6)}


def test_best_match_keeps_the_score_of_what_fails(spark):
    left = spark.createDataFrame([(1, "abcdef"), (2, "zzzzz")], "id int, text string")
    right = spark.createDataFrame([(7, "abcdef"), (5, "abcdef"), (9, "abcxyz")], "id int, text string")
    got = {r["left_id"]: (r["right_id"], r["score"]) for r in linkage.best_match(left, linkage.dice_pairs(left, right), 0.35).collect()}
    assert got == {1: (5, 1.0), 2: (None, 0.0)}


def test_joins(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, ord int, v string")
    assert {(r["k"], r["v"]) for r in joins.last_wins(df, ["k"], ["ord"]).collect()} == {(1, "b"), (2, "c")}
    assert {(r["k"], r["v"]) for r in joins.first_wins(df, ["k"], ["ord"]).collect()} == {(1, "a"), (2, "c")}
    up = spark.createDataFrame([(2, 0, "new"), (3, 0, "more")], df.schema)
    assert {(r["k"], r["v"]) for r in joins.upsert(df, up, ["k"]).collect()} == {(1, "b"), (2, "new"), (3, "more")}
    marks = spark.createDataFrame([(1, 0, "m0"), (1, 2, "m2")], "k int, ord int, m string")
    assert {(r["k"], r["ord"], r["m"]) for r in joins.as_of(df, marks, ["k"], "ord", "m").collect()} == {(1, 1, "m0"), (1, 2, "m2"), (2, 1, None)}


def test_evidence_levels(spark):
    rows = [("e", "f", "base", "agree"), ("e", "g", "x", "agree"), ("e", "h", "x", "agree"), ("e", "h", "auth", "mismatch"), ("e", "i", "adv", "mismatch"), ("e", "j", "x", "mismatch")]
    got = {r["field"]: r["level"] for r in evidence.field_levels(spark.createDataFrame(rows, "entity string, field string, grp string, verdict string"), "base", ["adv"], ["auth"]).collect()}
    assert got == {"f": "single", "g": "corroborated", "h": "disputed", "i": "single", "j": "disputed"}


def test_graph(spark):
    nodes = spark.createDataFrame([(x, "k", x) for x in "abcde"], "id string, kind string, label string")
    edges = spark.createDataFrame([("1", "t", "a", "b"), ("2", "t", "b", "c"), ("3", "t", "c", "d"), ("4", "t", "d", "zz")], "id string, kind string, src string, dst string")
    good, skipped = graph.guard(edges, nodes, 5)
    assert good.count() == 3 and skipped.first()["skipped"] == 1
    with pytest.raises(ValueError):
        graph.guard(edges, nodes, 0)
    kept, inner = graph.neighbourhood(good, nodes, "b", 1)
    assert {r["id"] for r in kept.collect()} == {"a", "b", "c"} and inner.count() == 2
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")
    assert {(r["id"], r["root"]) for r in graph.connected(links).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def test_trees(spark):
    schema = "tree string, id string, option int, next string, result string"
    roots = spark.createDataFrame([("t", "r")], "tree string, id string")
    good = spark.createDataFrame([("t", "r", 0, "a", None), ("t", "r", 1, None, "x"), ("t", "a", 0, None, "y")], schema)
    assert revision.tree_violations(good, roots).count() == 0
    bad = spark.createDataFrame([("t", "r", 0, "a", "both"), ("t", "a", 0, "r", None), ("t", "b", 0, "gone", None)], schema)
    assert {(r["id"], r["rule"]) for r in revision.tree_violations(bad, roots).collect()} >= {("r", "next or result"), ("gone", "no such node"), ("b", "not reached"), ("a", "circle"), ("r", "circle")}


def test_revision(spark):
    assert revision.apply_errata("a b c", [("b", "x"), ("x c", "y")]) == "a y"
    with pytest.raises(ValueError):
        revision.apply_errata("aaa", [("aa", "b")])
    df = spark.createDataFrame([("a", ["a", "c"])], "i string, l array<string>")
    assert tuple(revision.rename_ids(df, ["i", "l"], {"a": "b", "b": "z"}).select("i", "l").first()) == ("b", ["b", "c"])
    assert revision.align_versions([("1", "x"), ("2", "y"), ("3", "z")], [("n1", "x"), ("n3", "z")], {"2": "n1"}) == {"1": "n1", "2": "n1", "3": "n3"}
    with pytest.raises(ValueError):
        revision.align_versions([("1", "x")], [], {})


def test_bundles(spark):
    got = bundles.parse_line("桂枝三两（去皮） 芍药 甘草各二两、大枣十二枚")
    assert [(i["name"], i["dose"], i["note"]) for i in got] == [("桂枝", "三两", "去皮"), ("芍药", "二两", None), ("甘草", "二两", None), ("大枣", "十二枚", None)]
    assert [i["name"] for i in bundles.parse_line("芍药甘草", frozenset({"芍药", "甘草"}))] == ["芍药", "甘草"]
    assert bundles.split_items("甲（一、二）、乙（三") == ["甲（一、二）", "乙（三）"]
    assert bundles.segment("芍药某", frozenset({"芍药"})) is None
    assert bundles.list_quality(got) == 4 + 12 and bundles.list_quality([]) == -1
    assert bundles.modifications("若渴者，去半夏，加人参、瓜蒌。")[0] == {"cause": "渴", "removed": ["半夏"], "added": ["人参", "瓜蒌"]}
    blocks = [{"name": "c", "base": "b", "removed": [], "added": ["z"], "items": []}, {"name": "b", "base": "a", "removed": ["x"], "added": [], "items": []}, {"name": "a", "base": None, "removed": [], "added": [], "items": [{"name": "x"}, {"name": "y"}]}]
    assert [i["name"] for i in bundles.resolve_derivations(blocks)[0]["items"]] == ["y", "z"]
    df = spark.createDataFrame([(1, "甲一两 乙二两"), (2, None)], "k int, line string")
    assert {r["k"]: len(r["items"]) for r in bundles.parse_items(df, "k", "line").collect()} == {1: 2, 2: 0}


def test_vocabulary_longest_first():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for t in ("ab", "abc", "cd", "bcde"):
        machine.add_word(t, t)
    machine.make_automaton()
    assert search.longest_matches("abcdexab", machine) == [(1, 5, "bcde"), (6, 8, "ab")]


def test_annotation_checks(spark):
    src = spark.createDataFrame([("1", "k", "some text here")], "id string, key string, text string")
    e = spark.createDataFrame([("1", "k", "t", "text  here"), ("1", "old", "t", "text"), ("1", "k", "?", "text"), ("1", "k", "t", "nope"), ("2", "k", "t", "x")], "id string, key string, tag string, quote string")
    assert [r["reject"] for r in revision.check_annotations(e, src, ["t"]).orderBy(F.monotonically_increasing_id()).collect()].count(None) == 1


def test_incremental(spark, tmp_path):
    from scriptorium.streaming import incremental

    schema = "id int, text string, ord int"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(2, "c", 2), (3, "d", 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = incremental.upsert_stream(incremental.read_growing(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert {(r["id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/out/version=1").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    rows = spark.createDataFrame([(1, "a"), (2, "new")], "id int, text string")
    known = incremental.new_or_changed(rows, spark.createDataFrame([], "id int, key string")).select("id", "key")
    assert incremental.new_or_changed(spark.createDataFrame([(1, "a"), (2, "x")], "id int, text string"), known).count() == 1


def test_one_to_one_equals_the_ordered_pass(spark):
    rng = random.Random(4)
    rows = [(g, a, b, round(rng.random(), 1)) for g in range(2) for a in range(12) for b in range(8) if rng.random() < 0.6]
    want = []
    for g in range(2):
        taken = set()
        for a in range(12):
            own = sorted((-s, b) for h, x, b, s in rows if (h, x) == (g, a) and s >= 0.3 and b not in taken)
            if own:
                taken.add(own[0][1])
                want.append((g, a, own[0][1], -own[0][0]))
    got = linkage.one_to_one(spark.createDataFrame(rows, "grp int, left_id long, right_id long, score double"), "grp", 0.3)
    assert sorted(tuple(r) for r in got.select("grp", "left_id", "right_id", "score").collect()) == want
    assert linkage.one_to_one(spark.createDataFrame([], "grp int, left_id long, right_id long, score double"), "grp", 0.3).count() == 0


def test_leader_clusters_equal_the_ordered_pass(spark):
    rng = random.Random(9)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(45)) if a != b})
    taken, want = set(), []
    for k in range(40):
        own = [b for a, b in pairs if a == k and b not in taken]
        if k not in taken and own:
            taken.update([k, *own])
            want += [("g", k, m) for m in [k, *own]]
    members = spark.createDataFrame([(k, "g") for k in range(40)], "id long, status string")
    got = linkage.leader_clusters(members, spark.createDataFrame(pairs, "a long, b long"), "status")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_quotes_are_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(crosscheck, "QUOTE_BLOCK", 1)
    text = "春眠不覺曉處處聞啼鳥夜來風雨聲花落知多少白日依山盡黃河入海流欲窮千里目更上一層樓"
    quotes = spark.createDataFrame([(1, "x", ["處處聞啼鳥夜來風雨聲"]), (2, "y", ["黃河入海流欲窮千里目"]), (3, "x", ["全無此語之文字在其中也"]), (4, "x", [])], "id long, own string, segments array<string>")
    got = {r["id"]: (r["ratio"], r["witness"]) for r in crosscheck.verify_quotes(quotes, spark.createDataFrame([("x", text), ("y", text[20:])], "witness string, text string")).collect()}
    assert got[1] == (1.0, "x") and got[2] == (1.0, "y") and got[3][0] < 0.8 and got[4][0] == 0


def test_numbered_passages_are_whole_unless_cut(spark):
    lines = spark.createDataFrame([(1, 0, "x" * 9000), (1, 1, "  "), (1, 2, "short"), (1, 3, " twelve signs ")], "id int, pos int, line string")
    got = {r["number"]: (len(r["passage"]), r["whole"]) for r in passages.numbered(lines, "id").collect()}
    assert got == {1: (9000, True), 3: (12, True)}
    cut = {r["number"]: (len(r["passage"]), r["whole"]) for r in passages.numbered(lines, "id", most=4000).collect()}
    assert cut == {1: (4000, False), 3: (12, True)}
