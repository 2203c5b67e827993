import hashlib

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import dispatch, readers, sections, sinks


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "k int, t string")


def test_texts_and_guards(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿one\r\ntwo\rthree".encode())
    assert readers.texts(spark, str(tmp_path), "*.txt").first()["text"] == "one\ntwo\nthree"
    (tmp_path / "b.txt").write_text("x���")
    assert {r["problem"] for r in readers.texts(spark, str(tmp_path), strict=False).collect()} == {None, "replacement characters"}
    with pytest.raises(Exception, match="replacement"):
        readers.texts(spark, str(tmp_path)).collect()


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"a ""b""\nc"\n,\n2,d\n')
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "a.csv"), ["id"]).collect()] == [("1", 'a "b"\nc'), ("2", "d")]
    with pytest.raises(ValueError):
        readers.csv(spark, str(tmp_path / "a.csv"), ["other"])


def test_registry_and_cache(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"id":"b","o":2,"kind":"x"},{"id":"a","o":1,"kind":"?"},{"id":"a","o":3,"kind":"x"}]')
    rows, bad = readers.registry(spark, str(tmp_path / "r.json"), "id string, o int, kind string", "id", "o", {"kind": ["x", "y"]})
    assert [r["id"] for r in rows.collect()] == ["a", "b", "a"]
    assert {tuple(r) for r in bad.collect()} == {("a", "repeated"), ("a", "kind")}
    (tmp_path / "bad.json").write_text("{not json")
    good, broken = readers.json_cache(spark, [str(tmp_path / n) for n in ("r.json", "bad.json", "none.json")], "id string, o int")
    assert good.count() == 3 and broken.count() == 1
    assert readers.json_cache(spark, [str(tmp_path / "none.json")], "id string")[0].count() == 0


def test_tagged_and_paged(spark):
    t = texts(spark, "intro\n<one>\n【Title】\nbody a\nbody b\n<two>\nc")
    got = [tuple(r) for r in readers.tagged(t, "k", "t").orderBy("section").select("section", "tag", "title", "start", "body").collect()]
    assert got == [(0, None, None, 0, "intro"), (1, "one", None, 6, ""), (2, "one", "Title", 12, "body a\nbody b"), (3, "two", None, 34, "c")]
    p = texts(spark, "#+TITLE: A\n#+TITLE: B\n#+DATE: x\n# note\nfront<pb:1a>甲¶\n乙<pb:1b>丙")
    assert p.select(readers.header_fields(F.col("t")).alias("m")).first()["m"] == {"TITLE": "A", "DATE": "x"}
    assert [tuple(r) for r in readers.pages(p, "k", "t").orderBy("start").select("page", "start", "body").collect()] == [(None, 0, "front"), ("1a", 5, "甲乙"), ("1b", 7, "丙")]


def test_markdown(spark):
    t = texts(spark, "---\ntitle: 'A'\nn: 1\n---\nbody\n## One\nx\n```\n## no\n```\n## Two\ny", "no matter", "---\nopen")
    rows = {r["k"]: r for r in readers.front_matter(t, "k", "t").collect()}
    assert rows[0]["fields"] == {"title": "A", "n": "1"} and rows[0]["reason"] is None
    assert rows[1]["reason"] == "no front matter" and rows[2]["reason"] == "not closed or empty"
    parts = readers.markdown_sections(t.where("k = 0"), "k", "t").orderBy("section").collect()
    assert [(r["title"], r["body"]) for r in parts][1:] == [("One", "x\n```\n## no\n```"), ("Two", "y")]


def test_wiki_and_sections(spark):
    raw = "{{a|{{b}}}}''x'' [[Page/Sub|label]] [[Plain]]<ref>r</ref> <!-- c -->end"
    t = texts(spark, raw)
    assert t.select(sections.strip_wiki(F.col("t")).alias("x")).first()["x"] == "x label Plain end"
    assert [tuple(x) for x in t.select(sections.wiki_links(F.col("t")).alias("x")).first()["x"]] == [("Sub", "label"), ("Plain", "Plain")]
    b = texts(spark, "== One ==\n" + "a" * 30 + "\n== Two ==\nshort\n== Three ==\n" + "b" * 25, "no heading but a long enough body")
    got = [(r["k"], r["title"]) for r in sections.section_bodies(b, "k", "t", "== (.*) ==").orderBy("k", "section").collect()]
    assert got == [(0, "One"), (0, "Three"), (1, None)]


def test_locks_and_digests(spark):
    body = bytearray(b"hello\n")
    r = readers.digests(spark.createDataFrame([(body,)], "c binary"), "c").first()
    assert r["sha256"] == hashlib.sha256(body).hexdigest() and r["blob"] == hashlib.sha1(b"blob 6\x00" + body).hexdigest() and r["bytes"] == 6
    h = "0" * 64
    lock = spark.createDataFrame([("a", "x/y", h), ("a", "x", h), ("b", "../z", h), ("c", "q", "f")], "id string, path string, sha256 string")
    assert {(v["path"], v["rule"]) for v in readers.lock_violations(lock).collect()} == {("../z", "unsafe path"), ("q", "malformed hash"), ("x/y", "repeated id"), ("x", "repeated id"), ("x/y", "within another")}


def test_dispatch_and_sinks(spark, tmp_path):
    @dispatch.parser("test-lines")
    def _(rows):
        return {"passages": rows.select("source", F.explode(F.split("text", "\n")).alias("text"))}

    df = spark.createDataFrame([("a", "p", "1\n2"), ("b", "p", "3")], "source string, path string, text string")
    made = dispatch.run(df, [("a", "test-lines"), ("b", "test-lines")])["passages"]
    assert made.count() == 3
    with pytest.raises(ValueError):
        dispatch.run(df, [("a", "unknown")])
    sinks.write_table(made, str(tmp_path / "t"), ["source"])
    assert spark.read.parquet(str(tmp_path / "t")).where("source = 'a'").count() == 2
    assert sinks.markdown_table(made.orderBy("text")).splitlines()[0] == "| source | text |"
    with pytest.raises(ValueError):
        sinks.markdown_table(made, 1)


def test_templates_of_any_depth(spark):
    deep = "a" + "{{x|" * 30 + "y" + "}}" * 30 + "b {{open c}} d {{{z}}} {{never"
    t = spark.createDataFrame([(deep,), (None,), ("",)], "t string")
    assert [r[0] for r in t.select(sections.drop_templates(F.col("t"))).collect()] == ["ab  d {} {{never", None, ""]
