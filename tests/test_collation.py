"""Normal forms with places, running values, chains, locating, collation with gaps: each against brute force."""

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions import offsets
from scriptorium.functions.offsets import LOOSE, STRICT, Form, normal_form
from scriptorium.operators import alignment, chains, gapped, locating, scans
from scriptorium.operators.collate import semi_global

TEXTS = ["", "!!", "Ab, c.", "(a(b)c) d) (e", "ｱﾞＡ１ ﬁ 豈", "x&KR12;y [木-口] z", "中 文　字", "é" * 3 + "\U00020000퟿ a", None, "…" + "word " * 50]


def slow_form(text, form):
    out = []
    hidden = [False] * len(text)
    for pattern in (form.drop,):
        for m in re.finditer(pattern, text) if pattern else ():
            hidden[m.start() : m.end()] = [True] * len(m[0])
    if form.notes:
        stack = []
        for i, c in enumerate(text):
            if c in "(（":
                stack.append(i)
            elif c in ")）" and stack:
                a = stack.pop()
                hidden[a : i + 1] = [True] * (i + 1 - a)
    wild = {}
    for pattern, sign in ((form.strict, STRICT), (form.loose, LOOSE)):
        for m in re.finditer(pattern, text) if pattern else ():
            wild[m.start()] = sign
            hidden[m.start() : m.end()] = [True] * len(m[0])
    table = dict(form.variants)
    for i, c in enumerate(text):
        if i in wild:
            out.append((wild[i], i))
        if hidden[i]:
            continue
        if any(a <= ord(c) <= b for a, b in offsets.COMPATIBLE):
            c = unicodedata.normalize("NFKC", c)
        for x in c:
            x = table.get(x, x)
            if unicodedata.category(x)[0] in "LN" or unicodedata.category(x) == "Co":
                out.append((x, i))
    return "".join(c for c, _ in out), [i for _, i in out]


FORMS = [Form(), Form(notes=True), Form(strict=r"&KR\d+;|\[[^\[\]\n]*[-+][^\[\]\n]*\]", loose=r"(?<=[一-鿿])[ 　](?=[一-鿿])"), Form(drop=r"word", variants=(("b", "q"), ("c", "d")))]


@pytest.mark.parametrize("form", FORMS)
def test_normal_forms_and_places(form):
    for text in TEXTS:
        norm, places = normal_form(text or "", form)
        assert (norm, places.tolist()) == slow_form(text or "", form)


@pytest.mark.parametrize("form", FORMS[:3])
def test_offset_maps_lead_both_ways(spark, form):
    rows = [(i, t, "own") for i, t in enumerate(TEXTS)]
    df = offsets.with_offsets(spark.createDataFrame(rows, "id int, text string, _c0 string"), "text", form)
    assert df.columns == ["id", "text", "_c0", "norm", "runs"]
    held = df.withColumn("at", F.explode(F.sequence(F.lit(-1), F.char_length("norm") + 1)))
    held = held.withColumn("src", offsets.to_source(F.col("runs"), F.col("at"))).withColumn("span", offsets.span_to_source(F.col("runs"), F.lit(0), F.col("at")))
    for r in held.collect():
        norm, places = slow_form(r["text"] or "", form)
        assert r["norm"] == norm
        assert r["src"] == (places[r["at"]] if 0 <= r["at"] < len(places) else None)
        if 0 < r["at"] <= len(places):
            assert tuple(r["span"]) == (places[0], places[r["at"] - 1] + 1)
    back = df.withColumn("p", F.explode(F.sequence(F.lit(0), F.char_length(F.coalesce("text", F.lit(""))))))
    for r in back.withColumn("at", offsets.to_normal(F.col("runs"), F.col("p"))).collect():
        _, places = slow_form(r["text"] or "", form)
        assert r["at"] == next((k for k, s in enumerate(places) if s >= r["p"]), len(places))


def test_running_values_equal_windows(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", i, rng.randrange(100) if rng.random() < 0.5 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    w = Window.partitionBy("k").orderBy("i")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("k").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "i", "v", F.coalesce(F.sum("v").over(up), F.lit(0)).alias("s"), F.max("v").over(up).alias("m"), F.min("v").over(down).alias("l"), F.last("v", True).over(down).alias("n"))
    got = scans.running(df, ["k"], ["i"], {"s": ("v", "sum", False, True), "m": ("v", "max", False, True), "l": ("v", "min", True, False), "n": ("v", "last", True, False)})
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    placed = scans.in_ranges(df, ["k"], ["i"]).where("k = 'hot'").groupBy("_part").count().count()
    assert placed > 1


def slow_chain(rows):
    """The greatest weight, by all pairs."""
    rows = sorted(rows)
    best = []
    for i, (p, s, _, w) in enumerate(rows):
        best.append(w + max([best[j] for j in range(i) if rows[j][0] < p and rows[j][2] <= s], default=0))
    return max(best, default=0)


def test_chains_are_heaviest(spark):
    rng = random.Random(2)
    rows = []
    for key in range(12):
        for pos in range(40):
            for _ in range(rng.randrange(4)):
                s = [rng.randrange(300), pos * 10 + rng.randrange(-9, 9), pos * 10 + rng.choice([0, 0, 0, rng.randrange(-200, 200)])][key % 3]
                rows.append((key, pos, s, s + rng.randrange(1, 12), rng.randrange(1, 9)))
    df = spark.createDataFrame(rows, "key int, pos int, start int, `end` int, weight int").repartition(4)
    got = chains.choose(df, ["key"]).collect()
    for key in range(12):
        chain = sorted((r["pos"], r["start"], r["end"], r["weight"]) for r in got if r["key"] == key)
        assert all(a[0] < b[0] and a[2] <= b[1] for a, b in zip(chain, chain[1:], strict=False))
        assert sum(c[3] for c in chain) == slow_chain([r[1:] for r in rows if r[0] == key])
    assert chains.stretches(df, ["key"]).where("key = 1").select("stretch").distinct().count() > 2


def test_chain_of_equals_and_of_nothing():
    assert chains.heaviest_chain(*np.zeros((4, 0))).tolist() == []
    pos, start, end = np.array([0, 0, 1, 1]), np.array([0, 5, 5, 5]), np.array([5, 10, 10, 10])
    assert chains.heaviest_chain(pos, start, end, np.ones(4)).tolist() == [0, 2]


def altered(rng, text, share):
    """text with so large a share of its signs replaced, dropped or doubled."""
    out = list(text)
    for i in rng.sample(range(len(out)), int(share * len(out))):
        out[i] = rng.choice([rng.choice("abcdefgh"), "", out[i] * 2])
    return "".join(out)


def prose(rng, n):
    words = ["river", "stone", "of", "the", "morning", "quiet", "and", "lantern", "walks", "under", "seven", "bridges", "a", "to", "harbour", "glass", "when", "old", "winter", "sings"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


def slow_places(needles, hays, least=0.8):
    out = {}
    for i, n in needles:
        a = normal_form(n or "", locating.PLAIN)[0]
        for h, t in hays:
            b, places = normal_form(t or "", locating.PLAIN)
            if not a or not b:
                continue
            d, s, e = semi_global(a, b)
            if e > s and 1 - d / max(len(a), e - s) >= least - 1e-9:
                out[i, h] = (round(1 - d / max(len(a), e - s), 4), int(places[s]), int(places[e - 1]) + 1)
    return out


def test_locating_equals_brute_force(spark, monkeypatch):
    """Short and long passages, as they are and with edits; in two blocks of passages."""
    rng = random.Random(4)
    passages = [prose(rng, n) for n in (1, 1, 2, 2, 3, 5, 8, 13, 20, 34, 55)] + ["ab", "q", "", "?!", None]
    hays = [(k, prose(rng, 60)) for k in range(12)] + [(20, ""), (21, None), (22, "q"), (23, "A-b!")]
    for k in range(40):
        parts = [prose(rng, 15), *(altered(rng, rng.choice(passages[:11]), rng.choice([0, 0.05, 0.1, 0.15, 0.2])) for _ in range(2)), prose(rng, 9)]
        hays.append((100 + k, " … ".join(parts).upper() if k % 2 else "\n".join(parts)))
    needles = list(enumerate(passages))
    monkeypatch.setattr(locating, "BLOCK", 500)
    got = locating.locate(spark.createDataFrame(needles, "id int, text string"), spark.createDataFrame(hays, "id int, text string").repartition(3))
    found = {(r["needle"], r["hay"]): (r["ratio"], r["start"], r["end"]) for r in got.collect()}
    assert found == slow_places(needles, hays)
    assert locating.locate(spark.createDataFrame([], "id int, text string"), spark.createDataFrame(hays, "id int, text string")).count() == 0


def test_locating_recall_at_the_least_ratio():
    """With a fifth of all signs edited most long passages are still found, with a tenth all."""
    rng = random.Random(5)
    passages = [prose(rng, 40) for _ in range(60)]
    needles = locating.Needles(passages)
    for share, least in ((0.1, 1.0), (0.2, 0.95)):
        found = 0
        for i, p in enumerate(passages):
            text = normal_form(prose(rng, 80) + altered(rng, p, share) + prose(rng, 80), locating.PLAIN)[0]
            found += any(k == i for k, *_ in needles.found(text, 0.75))
        assert found >= least * len(passages)


def test_bit_parallel_distance():
    rng = random.Random(6)
    for _ in range(60):
        a, b = "".join(rng.choices("abc", k=rng.randrange(1, 90))), "".join(rng.choices("abc", k=rng.randrange(0, 60)))
        assert locating.Pattern(offsets.codes(a)).distance(offsets.codes(b)) == semi_global(a, b)[0]


def slow_steps(a, b):
    """The edit distance with wildcards, cell by cell."""
    loose, wild = LOOSE, (STRICT, LOOSE)
    row = [0]
    for y in b:
        row.append(row[-1] + (y != loose))
    for x in a:
        new = [row[0] + (x != loose)]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y and x not in wild and y not in wild), row[j + 1] + (x != loose), new[j] + (y != loose)))
        row = new
    return row[-1]


def test_segments_are_a_cheapest_way():
    rng = random.Random(7)
    for _ in range(150):
        a, b = ("".join(rng.choices("abc" + STRICT + LOOSE, [5, 5, 5, 1, 1], k=rng.randrange(0, 14))) for _ in range(2))
        found = alignment.segments(offsets.codes(a), offsets.codes(b))
        assert alignment.cost_table(offsets.codes(a), offsets.codes(b))[-1, -1] == slow_steps(a, b)
        assert "".join(a[s[1] : s[2]] for s in found) == a and "".join(b[s[3] : s[4]] for s in found) == b
        cost = sum(slow_steps(a[p:q], b[r:s]) for op, p, q, r, s in found if op != "equal")
        assert cost == slow_steps(a, b)
        assert all(slow_steps(a[p:q], b[r:s]) == 0 for op, p, q, r, s in found if op == "equal")
        assert all((x[0] == "equal") != (y[0] == "equal") for x, y in zip(found, found[1:], strict=False))


def test_lost_signs_equal_any_and_may_be_missing():
    assert [s[0] for s in alignment.segments(offsets.codes(f"ab{STRICT}d"), offsets.codes("abcd"))] == ["equal"]
    assert [s[0] for s in alignment.segments(offsets.codes(f"ab{LOOSE}d"), offsets.codes("abd"))] == ["equal"]
    assert [s[0] for s in alignment.segments(offsets.codes(f"ab{STRICT}d"), offsets.codes("abd"))] == ["equal", "delete", "equal"]
    piece = lambda n, closed, low, high, b, d=0: alignment.Piece(n, closed, (0, n), d, low, high, b, [("equal", 0, n, *b)])
    apart = alignment.assemble([piece(10, True, 0, 10, (0, 11)), piece(10, True, 40, 50, (45, 56))])
    assert (apart.ratio, apart.gaps, apart.gap_signs) == (1.0, 1, 30)
    inside = alignment.assemble([piece(10, False, 0, 10, (0, 11)), piece(10, True, 40, 50, (45, 56))])
    assert (inside.gaps, inside.ratio) == (0, 1 - 30 / 50)
    lost = alignment.assemble([piece(10, True, 0, 10, (0, 11)), alignment.Piece(12, True, (10, 22)), piece(10, True, 20, 30, (20, 30))])
    assert lost.ratio == 1 - 12 / 32 and lost.placed == 2
    assert alignment.assemble([alignment.Piece(3, False, (0, 3))]) is None


def slow_span(a, b):
    """distance, start, end of the nearest span: by all starts, each with all ends."""
    x, y = offsets.codes(a), offsets.codes(b)
    near = locating.Pattern(x).distance(y)
    if near >= len(a):
        return len(a), 0, 0
    best = None
    for s in range(len(b)):
        row = alignment.cost_table(x, y[s : s + len(a) + near])[-1]
        for k in np.flatnonzero(row[1:] == near) + 1:
            key = (abs(int(k) - len(a)), s + int(k), -s)
            best = min(best or (key, s, s + int(k)), (key, s, s + int(k)))
    return near, best[1], best[2]


def test_nearest_span():
    rng = random.Random(9)
    for _ in range(80):
        a, b = "".join(rng.choices("abc", k=rng.randrange(1, 12))), "".join(rng.choices("abc", k=rng.randrange(0, 30)))
        got = locating.Pattern(offsets.codes(a)).span(offsets.codes(b), len(a))
        assert (got or (len(a), 0, 0)) == slow_span(a, b)


def collated_by_force(passages, witness, form):
    """Every piece at its best place in the whole witness, and the heaviest chain by all pairs."""
    norm, places = normal_form(witness, form)
    pieces = []
    for pos, text in passages:
        own, at = normal_form(text or "", form)
        for k, (a, z, closed) in enumerate(gapped.piece_bounds(text or "", at)):
            pieces.append((pos, k, own[a:z], closed))
    rows = []
    for i, (_, _, piece, _) in enumerate(pieces):
        n = len(piece.replace(LOOSE, ""))
        d, s, e = locating.Pattern(offsets.codes(piece)).span(offsets.codes(norm), n) or (n, 0, 0)
        if e > s and n > d and 1 - d / max(n, e - s) >= (0.8 if n < gapped.CLOSE else 0.5):
            slack = min(8, (n - d) // 4) if d else 0
            rows.append((i, s + slack, max(s + slack + 1, e - slack), n - d, e, d, s))
    best = []
    for i, r in enumerate(rows):
        before = max(((best[j][0], -j) for j in range(i) if rows[j][0] < r[0] and rows[j][2] <= r[1]), default=(0, 1))
        best.append((before[0] + r[3], -before[1]))
    at = max(range(len(rows)), key=lambda i: best[i][0], default=-1)
    chain = {}
    while at >= 0:
        chain[rows[at][0]] = rows[at]
        at = best[at][1]
    out = {}
    for pos, _ in passages:
        own = [(piece, closed, chain.get(i)) for i, (p, _, piece, closed) in enumerate(pieces) if p == pos]
        placed = [c for _, _, c in own if c]
        if not placed or len(placed) < len(own):
            out[pos] = None
            continue
        distance, length = sum(c[5] for c in placed), sum(c[4] - c[6] for c in placed)
        for (p, closed, c), (q, _, d) in zip(own, own[1:], strict=False):
            between = max(0, d[6] - c[4])
            good = min(1 - c[5] / max(len(p), c[4] - c[6]), 1 - d[5] / max(len(q), d[4] - d[6])) >= 0.8
            if not (closed and good and between >= alignment.STRUCTURAL):
                distance, length = distance + between, length + between
        n = sum(len(p) for p, _, _ in own)
        out[pos] = (round(1 - distance / max(n, length), 4), int(places[placed[0][6]]), int(places[max(c[4] for c in placed) - 1]) + 1)
    return out


def sentences(rng, n):
    return "".join(prose(rng, rng.randrange(4, 16)).capitalize() + rng.choice([". ", "! ", "; "]) for _ in range(n))


def test_gapped_collation_equals_brute_force(spark):
    rng = random.Random(8)
    passages, witnesses, want = [], [], {}
    for source in range(4):
        own = [(k, sentences(rng, rng.randrange(1, 7))) for k in range(25 if source else 60)]
        parts = []
        for k, text in own:
            if source == 2 and k % 7 == 3:
                continue
            text = altered(rng, text, rng.choice([0, 0, 0.05, 0.15]))
            if source == 1 and k % 4 == 1:
                text = text.replace(". ", ". " + prose(rng, 30).upper() + ". ", 1)
            parts.append(text)
        if source == 3:
            parts[5], parts[15] = parts[15], parts[5]
        witness = "\n".join(parts)
        passages += [(f"s{source}", *p) for p in own]
        witnesses.append((f"s{source}", 1, witness))
        want |= {(f"s{source}", pos): r for pos, r in collated_by_force(own, witness, gapped.PLAIN).items()}
    passages += [("s0", 900, "?!"), ("s0", 901, None), ("none", 1, "nowhere")]
    witnesses.append(("alone", 1, "a witness of nothing"))
    df = spark.createDataFrame(passages, "source string, pos int, text string").repartition(3)
    got = gapped.notes(gapped.collate(df, spark.createDataFrame(witnesses, "source string, witness int, text string"))).collect()
    found = {(r["source"], r["pos"]): r for r in got}
    assert set(found) == {*want, ("s0", 900), ("s0", 901)}
    assert found["s0", 900]["verdict"] == "missing" and found["s0", 900]["note"] == "nothing to compare"
    whole = [k for k, w in want.items() if w]
    assert len(whole) > 0.75 * len(want)
    differ = [(k, want[k], (found[k]["ratio"], found[k]["start"], found[k]["end"])) for k in whole if (found[k]["ratio"], found[k]["start"], found[k]["end"]) != want[k]]
    assert not differ
    texts, papers = {(s, p): t for s, p, t in passages}, {s: t for s, _, t in witnesses}
    for k in want:
        r = found[k]
        if r["placed"]:
            spans = [tuple(s) for s in r["segments"]]
            assert "".join(texts[k][a:z] for _, a, z, _, _ in spans) == texts[k]
            assert "".join(papers[k[0]][a:z] for _, _, _, a, z in spans) == papers[k[0]][r["start"] : r["end"]]
            equal = [(normal_form(texts[k][a:z], gapped.PLAIN)[0], normal_form(papers[k[0]][b:c], gapped.PLAIN)[0]) for op, a, z, b, c in spans if op == "equal"]
            assert all(x == y for x, y in equal)
    assert any(r["gaps"] for r in got) and any(r["verdict"] == "missing" for r in got)


def test_pieces_close_at_sentence_ends():
    text = "One two three four. No. Then a longer sentence here! tail"
    norm, places = normal_form(text, gapped.PLAIN)
    assert [norm[a:z] for a, z, _ in gapped.piece_bounds(text, places)] == ["onetwothreefour", "nothenalongersentenceheretail"]
    long = "x" * 1500 + "."
    assert [z - a for a, z, _ in gapped.piece_bounds(long, np.arange(1500))] == [600, 600, 300]
    assert gapped.piece_bounds("..", np.zeros(0, dtype=np.int64)) == []


def test_collation_broadcasts_no_table_of_pieces_or_places(spark):
    passages = spark.createDataFrame([(1, 1, "a first sentence of some length."), (1, 2, "and a second one that is longer.")], "source int, pos int, text string")
    witnesses = spark.createDataFrame([(1, "w", "a first sentence of some length. and a second one that is longer.")], "source int, witness string, text string")
    out = gapped.collate(passages, witnesses)
    places = spark.createDataFrame([(1, 1, 0, 5, 5), (1, 2, 5, 9, 4)], "source int, pos int, start int, end int, weight int")
    for df in (out, chains.stretches(places, ["source"])):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r["pos"], r["verdict"]) for r in out.orderBy("pos").collect()] == [(1, "agree"), (2, "agree")]


def test_distances_at_once_equal_those_one_by_one():
    rng = np.random.default_rng(12)
    pairs = []
    for n in (1, 2, 61, 62, 63, 64, 123, 124, 125, 248, 249, 300):
        for m in (0, 1, 7, n, 2 * n, 8 * n + 65):
            a, b = (rng.integers(97, 101, k).astype(np.uint32) for k in (n, m))
            near = np.delete(np.concatenate([b[: m // 2], a, b[m // 2 :]]), np.arange(m // 2, m // 2 + n, 9))
            pairs += [(locating.Pattern(a), b), (locating.Pattern(a), near)]
    assert locating.distances(pairs).tolist() == [p.distance(t) for p, t in pairs]
    assert len(locating.distances([])) == 0


def test_spans_of_many_windows_are_taken_together():
    rng = random.Random(12)
    needles, texts, least = [], [], []
    for n in [1, 2, 7, 8, 63, 64, 65, 128, 129, 300, *(rng.randrange(1, 90) for _ in range(700))]:
        signs = rng.choice(["ab", "abcdefghijé木"])
        needle = "".join(rng.choice(signs) for _ in range(n))
        inside = altered(rng, needle, rng.random() * 0.6) if rng.random() < 0.7 else ""
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(60))) + inside + "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        needles.append(offsets.codes(needle))
        texts.append(offsets.codes(text))
        least.append(rng.choice([0.3, 0.5, 0.8]))
    most = [int((1 / x - 1) * len(n)) for n, x in zip(needles, least, strict=True)]
    got = locating.spans(needles, texts, most, least)
    for n, t, m, x, g in zip(needles, texts, most, least, got, strict=True):
        want = locating.Pattern(n).span(t, m)
        assert g == (want if want and 1 - want[0] / max(len(n), want[2] - want[1]) >= x else None)
    assert sum(g is not None for g in got) > 200
    assert locating.spans([], [], [], []) == [] and locating.spans([offsets.codes("")], [offsets.codes("ab")], [0], [0.5]) == [None]


def test_steps_without_wildcards_are_those_of_the_table():
    rng = random.Random(13)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(70)))
        b = altered(rng, a, 0.3) if rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(rng.randrange(70)))
        x, y = offsets.codes(a), offsets.codes(b)
        table, i, j, want = alignment.cost_table(x, y), len(a), len(b), []
        while i or j:
            if i and j and a[i - 1] == b[j - 1]:
                want.append((True, 1, 1))
            elif i and j and table[i, j] == table[i - 1, j - 1] + 1:
                want.append((False, 1, 1))
            else:
                want.append((False, 1, 0) if i and table[i, j] == table[i - 1, j] + 1 else (False, 0, 1))
            i, j = i - want[-1][1], j - want[-1][2]
        assert alignment._walk_plain(x.tolist(), y.tolist()) == want[::-1]


def test_seeds_of_many_texts_are_those_of_each():
    rng = random.Random(14)
    parts = [offsets.codes("".join(rng.choice("abcdef" + STRICT) for _ in range(rng.choice([0, 1, 5, 6, 7, 9, 10, 40, 100])))) for _ in range(300)]
    counts, hashes, places = gapped.seeds(parts)
    ends = np.cumsum(counts)
    for p, a, z in zip(parts, ends - counts, ends, strict=True):
        own = locating.run_hashes(p, gapped.RUN)
        near = min(gapped.NEIGHBOURS, len(own))
        want = sorted({i + int(own[i : i + near].argmin()) for i in range(len(own) - near + 1)} if near else [])
        want = [i for i in want if ord(STRICT) not in p[i : i + gapped.RUN]]
        assert places[a:z].tolist() == want and hashes[a:z].tolist() == own[want].view(np.int64).tolist()
