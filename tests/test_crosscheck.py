from pyspark.sql import functions as F

from scriptorium.functions import names
from scriptorium.operators import crosscheck


def test_names(spark):
    df = spark.createDataFrame([("甘草（炙）",), ("生甘草",), ("大枣",), ("其他长长的名",)], "n string")
    got = [r["canonical"] for r in names.canonical(df, "n", {"甘草": "甘草根", "大枣": "枣"}).collect()]
    assert got == ["甘草根", "甘草根", "枣", "其他长长的名"]
    lex = spark.createDataFrame([("甘草根",)], "name string")
    out = names.partition_by_lexicon(spark.createDataFrame([("甘草根",), ("甘草根末",), ("x",)], "n string"), "n", lex, F.regexp_replace("n", "末$", ""))
    assert {(r["n"], r["status"], r["resolved"]) for r in out.collect()} == {("甘草根", "resolved", "甘草根"), ("甘草根末", "recovered", "甘草根"), ("x", "unresolved", None)}
    t = spark.createDataFrame([("宜用桂枝汤。麻黄汤主之。又用桂枝汤",)], "t string")
    assert t.select(names.names_in_use(F.col("t"), ["用"], ["汤"], ["主之"]).alias("x")).first()["x"] == ["桂枝汤", "麻黄汤"]
    assert t.select(names.plausible_name(F.lit("桂枝汤"), ["汤"], ["主"]).alias("x")).first()["x"]
    c = spark.createDataFrame([("人以为寒，而不知乃热也。",)], "t string").select(names.contrast(F.col("t"), "人以为", "不知乃").alias("x")).first()["x"]
    assert (c["common"], c["true"]) == ("寒", "热也")
    p = spark.createDataFrame([("味甘平，无毒。主五脏",)], "t string").select(names.properties(F.col("t"), ["平", "大寒", "寒"], ["甘", "苦"]).alias("x")).first()["x"]
    assert (p["nature"], p["flavours"], p["toxic"]) == ("平", ["甘"], False)


def test_pieces_and_chunks():
    long = "甲乙丙丁戊己庚辛壬癸。子丑。寅卯辰巳午未申酉戌亥。尾"
    assert crosscheck.sentence_pieces(long) == ["甲乙丙丁戊己庚辛壬癸。", "子丑。寅卯辰巳午未申酉戌亥。尾"]
    assert crosscheck.sentence_pieces("短句。短") == ["短句。短"] and crosscheck.sentence_pieces("") == []
    assert "".join(crosscheck.sentence_pieces(long * 40)) == long * 40
    assert crosscheck.chunk("a" * 30 + "\n" + "b" * 30 + "\nc") == ["a" * 30 + "\n" + "b" * 30]
    assert all(len(c) <= 900 for c in crosscheck.chunk("x" * 5000))


def test_pairs_and_items(spark):
    seg = spark.createDataFrame([("s", [("replace", "甲", "乙"), ("equal", "x", "x"), ("replace", "丙丁", "丙戊"), ("replace", "ab", "c")]), ("t", [("replace", "甲", "乙")])], "source string, segments array<struct<op:string,a:string,b:string>>")
    assert {(r["local"], r["witness"], r["n"], r["sources"]) for r in crosscheck.replace_pairs(seg).collect()} == {("甲", "乙", 2, 2), ("丁", "戊", 1, 1)}
    df = spark.createDataFrame([(["a"], ["a"]), (["甘草", "x"], ["炙甘草", "x"]), (["水", "x"], ["x"]), (["ppp"], ["qqq", "rrr"]), ([], [])], "a array<string>, b array<string>")
    got = [r["v"]["verdict"] for r in df.select(crosscheck.compare_items(F.col("a"), F.col("b"), ["水"]).alias("v")).collect()]
    assert got == ["agree", "variant", "variant", "mismatch", "agree"]


def test_links_and_strength(spark):
    link = lambda *rows: spark.createDataFrame(list(rows), "passage int, bundle string")
    s = spark.createDataFrame([(1, "a", "prescribed"), (2, "b", "prescribed"), (3, "c", "mentioned")], "passage int, bundle string, strength string")
    got = {(r["passage"], r["verdict"], r["conclusion"]) for r in crosscheck.judge_links(link((1, "a"), (3, "c"), (5, "e")), link((1, "a"), (2, "b"), (4, "d")), s).collect()}
    assert got == {(1, "agree", "fine"), (2, "mismatch", "missing here"), (3, "mismatch", "missing there"), (4, "mismatch", "extra there"), (5, "mismatch", "review")}
    t = spark.createDataFrame([("宜用某汤", "某汤"), ("不可与某汤", "某汤"), ("某汤", "某汤"), ("x", "某汤"), ("前文及某汤", "某汤")], "t string, n string")
    assert [r["s"] for r in t.select(crosscheck.mention_strength(F.col("t"), F.col("n"), ["用", "宜"], ["不可"]).alias("s")).collect()] == ["prescribed", "negated", "heading", "absent", "mentioned"]


def test_quotes_and_roles(spark):
    w = spark.createDataFrame([("own", "A first sentence of the witness. And the second one stands here."), ("other", "Something else that only the other one has in it.")], "witness string, text string")
    q = spark.createDataFrame([(1, "own", ["a first sentence", "the second one"]), (2, "own", ["only the other one has"]), (3, "own", ["nowhere to be found at all, this"]), (4, "own", [])], "id int, own string, segments array<string>")
    got = {r["id"]: (r["witness"], r["verdict"]) for r in crosscheck.verify_quotes(q, w).collect()}
    assert got[1] == ("own", "agree") and got[2] == ("other", "agree") and got[3][1] in ("missing", "mismatch") and got[4][1] == "missing"
    texts = spark.createDataFrame([("b", "君以桂枝解肌。芍药敛阴。无关")], "bundle string, text string")
    items = spark.createDataFrame([("b", "桂枝"), ("b", "芍药")], "bundle string, name string")
    assert {(r["item"], r["role"]) for r in crosscheck.roles(texts, items, ["以(..)(解.)", "^(芍药)(敛.)"]).collect()} == {("桂枝", "解肌"), ("芍药", "敛阴")}


def test_reports(spark):
    one = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "c"), (4, "z")], "bag int, item string")
    assert [(r["bag"], r["shared"]) for r in crosscheck.what_if(one, 1, ["b"], ["c"]).collect()] == [(2, 2), (3, 1)]
    options = spark.createDataFrame([("t", "r", "yes", "a", None), ("t", "r", "no", None, "end"), ("t", "a", "go", None, "goal")], "tree string, id string, label string, next string, result string")
    roots = spark.createDataFrame([("t", "r")], "tree string, id string")
    assert {(tuple(r["path"]), r["result"]) for r in crosscheck.tree_paths(options, roots).collect()} == {(("no",), "end"), (("yes", "go"), "goal")}
    facts = spark.createDataFrame([(f"q{i}", f"a{i}") for i in range(9)], "question string, answer string")
    asked = crosscheck.quiz(facts, 1, 3).collect()
    assert len(asked) == 3 and all(len(set(r["options"])) == 4 and r["answer"] in r["options"] for r in asked)
    assert asked == crosscheck.quiz(facts, 1, 3).collect()


def test_pages_and_cards(spark):
    pages = spark.createDataFrame([("x", "X"), ("y", "Y")], "title string, text string")
    links = spark.createDataFrame([("r", 2, "x"), ("r", 1, "y"), ("r", 3, "gone")], "root string, pos int, title string")
    assert crosscheck.stitched_pages(pages, links).first()["text"] == "<!-- y -->\nY\n\n<!-- x -->\nX"
    rows = spark.createDataFrame([("1", None, {"type": "a", "title": "T"}), ("2", None, {"type": "a"}), ("3", "broken", None), ("4", None, {"type": "?"}), ("5", None, {"x": "y"})], "path string, reason string, fields map<string,string>")
    tables, skipped = crosscheck.cards(rows, {"a": {"name": "title"}})
    assert [tuple(r) for r in tables["a"].collect()] == [("1", "T")]
    assert {(r["path"], r["why"]) for r in skipped.collect()} == {("2", "no title"), ("3", "broken"), ("4", "unknown type"), ("5", "no type")}
