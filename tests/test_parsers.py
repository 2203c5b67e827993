"""Machines over lines and the parsers made of them, against sequential loops."""

import hashlib
import os
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import rewrite
from scriptorium.operators import bundles, covers, derivations, passages, transducer
from scriptorium.plans import catalog
from scriptorium.sources import dispatch, parsers
from scriptorium.sources.parsers import BLOCKS, CLAUSES, Style

LINES = ["", "桂枝汤方", "乌梅丸方（佚）", "麻黄散（辛温）", "桂枝（三两）、芍药（三两）", "上五味，以水七升，煮取三升", "本云加减", "一、太阳之为病，脉浮。", "第12条 伤寒三日，阳明脉大。", "若汗出，宜桂枝汤。", "  ", "甘草（二两，炙）", "以水一斗煮"]


def texts_of(seed, n, most):
    rng = random.Random(seed)
    out = [(f"t{k}", "\n".join(rng.choices(LINES, k=rng.randrange(1, most)))) for k in range(n)]
    return [*out, ("long", "\n".join(rng.choices(LINES, k=900))), ("empty", ""), ("none", None)]


def kind_of(line, style, lost):
    t = line.strip(" ")
    m = re.search(style.heading, t)
    if t == "":
        return "blank"
    if m:
        return "lost" if lost and style.lost in (m[2] or "") else "heading"
    for kind, pattern in (("aside", style.aside), ("directions", style.directions), ("item", style.item)):
        if re.search(pattern, t):
            return kind
    return "plain"


def test_states_equal_a_loop(spark):
    rows = texts_of(1, 30, 40)
    df = spark.createDataFrame(rows, "source string, text string").repartition(3)
    got = transducer.run(parsers.lines_of(df).withColumn("_c0", F.lit("own")), "source", parsers.kinds(F.col("line"), Style(), lost=True), BLOCKS).collect()
    found = {(r["source"], r["pos"]): (r["kind"], r["before"], r["state"]) for r in got}
    want = {}
    for source, text in rows:
        state = BLOCKS.start
        for pos, line in enumerate(text.split("\n")) if text is not None else ():
            kind = kind_of(line, Style(), True)
            before, state = state, BLOCKS.step(state, kind)
            want[source, pos] = (kind, before, state)
    assert found == want


def test_maps_are_composed_by_doubling():
    rng = np.random.default_rng(1)
    maps = rng.integers(0, 4, (50, 4))
    firsts = np.maximum.accumulate(np.where(rng.random(50) < 0.1, np.arange(50), 0))
    got = transducer.compose(maps, firsts)
    for i in range(50):
        state = np.arange(4)
        for k in range(firsts[i], i + 1):
            state = maps[k][state]
        assert got[i].tolist() == state.tolist()
    with pytest.raises(ValueError):
        transducer.Machine(("a",), "a", ("x",), {("a", "y"): "a"})


def clauses_by_loop(text):
    style, state, number, name, out, attached = Style(), "text", 0, None, [], []
    for line in text.split("\n"):
        t, kind = line.strip(" "), kind_of(line, Style(), False)
        state = CLAUSES.step(state, kind)
        if kind == "heading":
            name = re.search(style.heading, t)
        elif kind in ("blank", "aside"):
            continue
        elif state == "text":
            number += 1
            out.append((number, re.sub(style.number, "", t).strip(" ")))
        else:
            attached.append((number, name[1], name[2] or None, state, t))
    return out, attached


def blocks_by_loop(text):
    style, state, out = Style(), BLOCKS.start, []
    for line in text.split("\n"):
        t, kind = line.strip(" "), kind_of(line, style, True)
        state = BLOCKS.step(state, kind)
        if kind in ("heading", "lost"):
            m = re.search(style.heading, t)
            out.append([m[1], m[2] or None, kind == "lost", [], []])
        elif out and state == "items" and kind == "item":
            out[-1][3].append(t)
        elif out and state == "made" and kind not in ("blank", "aside"):
            out[-1][4].append(t)
    return out


def test_parsers_equal_loops(spark):
    rows = texts_of(2, 25, 30)
    df = spark.createDataFrame(rows, "source string, text string").repartition(3)
    tables = dispatch.run(df, [(s, "numbered clauses") for s, _ in rows])
    clauses, attached = (sorted(map(repr, (tuple(r) for r in tables[n].drop("pos").collect()))) for n in ("clauses", "attached"))
    want = [(s, *clauses_by_loop(t)) for s, t in rows if t is not None]
    assert clauses == sorted(repr((s, *c)) for s, out, _ in want for c in out)
    assert attached == sorted(repr((s, *a)) for s, _, out in want for a in out)
    blocks = dispatch.run(df, [(s, "recipe blocks") for s, _ in rows])["blocks"].collect()
    got = sorted(repr((r["source"], r["block"], r["name"], r["note"], r["lost"], r["items"], r["directions"])) for r in blocks)
    assert got == sorted(repr((s, k, *b)) for s, t in rows if t is not None for k, b in enumerate(blocks_by_loop(t), 1))
    assert any(r["lost"] and not r["items"] for r in blocks)


def test_covers_are_whole_or_reported(spark):
    labels = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "x", "a", "y"]), (3, []), (4, None), (5, ["c", None]), (6, ["whole thing"])], "id int, parts array<string>")
    words = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", "A2"), ("whole thing", "W"), (None, "N")], "term string, concept string")
    got = {r["id"]: (r["covered"], r["concepts"], r["rest"]) for r in covers.cover(labels, words).collect()}
    assert got == {1: (True, ["A", "A2"], []), 2: (False, ["A"], ["x", "y"]), 3: (False, [], []), 4: (False, [], []), 5: (False, [], ["c"]), 6: (True, ["W"], [])}


def test_derivations_equal_the_sequential_fixpoint(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(6):
        own = []
        for k in range(30 if g else 200):
            base = rng.randrange(-1, 30) if g % 2 else k - 1
            root = rng.random() < 0.15 if g else k == 0
            pick = lambda n: [rng.choice("abcdefgh") for _ in range(rng.randrange(n))]
            own.append({"name": f"n{k}", "base": f"n{base}" if base >= 0 else None, "removed": pick(3), "added": pick(3), "items": [{"name": x, "dose": None, "note": None} for x in pick(5)] if root else []})
        for k, b in enumerate(own):
            rows.append((g, k, b["name"], b["base"], b["removed"], b["added"], [i["name"] for i in b["items"]]))
        want |= {(g, b["name"]): [i["name"] for i in b["items"]] for b in bundles.resolve_derivations(own)}
    df = spark.createDataFrame(rows, "g int, pos int, name string, base string, removed array<string>, added array<string>, items array<string>").repartition(3)
    got = {(r["g"], r["name"]): r["items"] for r in derivations.resolve(df, "g").collect()}
    assert got == want
    assert sum(map(bool, got.values())) > 100


def converted_by_force(text, table):
    out, i, n = "", 0, 0
    while i < len(text):
        old = max((o for o in table if text.startswith(o, i)), key=len, default=None)
        out, i, n = (out + table[old], i + len(old), n + 1) if old else (out + text[i], i + 1, n)
    return out, n


def test_conversion_takes_the_longest_phrase_from_the_left(spark):
    rng = random.Random(4)
    table = {"a": "A", "ab": "x", "abc": "", "bcd": "longer", "cda": "c", "dd": "d", "后": "後", "皇后": "皇后", "\U00020000": "y"}
    texts = ["".join(rng.choices("abcd后皇\U00020000", k=rng.randrange(40))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "id int, text string, _t string")
    got = {r["id"]: (r["converted"], r["replaced"]) for r in rewrite.convert(df, "text", list(table.items())).collect()}
    assert got == {i: converted_by_force(t, table) if t is not None else (None, 0) for i, t in enumerate(texts)}
    assert rewrite.replaced("abc", rewrite.automaton({})) == ("abc", 0)
    for bad in ([("", "x")], [("a", "b"), ("a", "c")]):
        with pytest.raises(ValueError):
            rewrite.convert(df, "text", bad)


def test_parsed_clauses_query_equals_a_loop(spark):
    """The registered query on the smallest documents."""
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    heading, item, directions, aside = r"^([^.,;:!?]{1,39}?)(?: ?[(]([^)]*)[)])?$", r"[|#]", r"^[^.]*:", r"^[*]"
    want = {}
    for r in pq.read_table(f"{folder}/documents.parquet").to_pylist():
        state, number, name, seen = "text", 0, None, {}
        for line in r["text"].split("\n") if r["text"] is not None else ():
            t = line.strip(" ")
            kind = "blank" if not t else "heading" if re.search(heading, t) else "aside" if re.search(aside, t) else "directions" if re.search(directions, t) else "item" if re.search(item, t) else "plain"
            state = CLAUSES.step(state, kind)
            if kind == "heading":
                name = re.search(heading, t)[1]
            elif kind not in ("blank", "aside"):
                if state == "text":
                    number += 1
                    want[r["doc_id"], number] = hashlib.md5(re.sub("^[0-9]+[.)]? ", "", t).strip(" ").encode()).hexdigest()
                else:
                    seen.setdefault(number, []).append(name)
        for k, names in seen.items():
            if k:
                want[r["doc_id"], k] = (want[r["doc_id"], k], len(names), len(set(names)))
    want = {k: v if isinstance(v, tuple) else (v, 0, 0) for k, v in want.items()}
    got = {(r["doc_id"], r["number"]): (r["digest"], r["attached"], r["headings"]) for r in catalog.QUERIES["parsed_clauses"](spark, folder).collect()}
    assert got == want


def test_titles_in_patterns_equal_a_scan(spark, monkeypatch):
    rng = random.Random(5)
    titles = [(k, "".join(rng.choices("ab c", k=rng.randrange(1, 4)))) for k in range(20)] + [(90, ""), (91, "  "), (92, None), (93, "ab"), (94, "ab")]
    texts = [(k, "".join(rng.choices("abc .", k=rng.randrange(0, 25)))) for k in range(60)] + [(99, None)]
    patterns = ["{} ", " {}", "a{}."]
    monkeypatch.setattr(passages, "TITLE_BLOCK", 40)
    got = passages.attach_by_title(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(titles, "title_id smallint, title string"), patterns)
    want = {(i, k) for i, t in texts for k, n in titles if t and n and n.strip(" ") and any(p.replace("{}", n) in t for p in patterns)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
