"""Operators on pages: defined results for odd rows, and brute force."""

import hashlib
import json
import random
from collections import Counter

import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from scriptorium.llm import _common, html_extract, url_filter, warc

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for n in ("host", "path", "digest", "payload", "wrapper", "rank", "h", "salt", "_id"):
        df = df.withColumn(n, F.lit("own"))
    return df


# url filters

URLS = [None, "", "no scheme", "http://", "http://NET/", "http://a.net", "http://a.net/x", "http://Example.NET/en/1", "https://b.example.net/en", "http://x.example.com/de/1?q=/fr/", "http://example.com/fr/", "http://org/fr/", "http://my.org/fr/#top", "http://myorg/fr/", "ftp://a.org?x=/fr/", "http://a.net://b.org/fr/", "x://u@h.org:80/fr/1", "http://é.NET/ü/", "http://notexample.net/en/"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(h, p, v) for h, p, v in url_filter.DEFAULT_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    h, p, v = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=(None, None, "allow"))
    return host, path, None if h is None else h + p, v


def test_url_filter(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(None, URLS[6], "x"), (3, URLS[6], "x"), (3, URLS[6], "x")]
    got = Counter(tuple(r) for r in url_filter.judge(pages(spark, rows)).collect())
    assert got == Counter((i, *judged(u)) for i, u, _ in rows)
    assert url_filter.judge(pages(spark, rows).limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages(spark, rows), []).collect()} == {"allow"}


def test_digest_array_confirms_full_strings(tmp_path):
    files = url_filter.DigestArray.build([(f"h{i}.com", "/", "block") for i in range(1000)], tmp_path, "t")
    index = url_filter.DigestArray(files)
    assert (index.find([f"h{i}.com/".encode() for i in range(1000)]) >= 0).all()
    assert (index.find([b"other/", b""]) == -1).all()
    index.keys = index.keys.copy()
    index.keys[:] = index.keys[0]  # all digests collide
    asked = index.stored(0)
    assert index.find([asked])[0] == 0 and index.find([b"absent"])[0] == -1


def test_url_filter_of_very_long_hosts(spark):
    long = "http://" + "a." * 500_000 + "example.net/en/x"
    r = url_filter.judge(pages(spark, [(1, long, None), (2, "http://" + "." * 300_000 + "/", None)])).collect()
    assert {x["page_id"]: x["rule"] for x in r} == {1: "example.net/en/", 2: None}


# WARC


def test_warc_round_trip(spark):
    big, other = "é" * 600, "y" * 999
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (9, None, big), (3, "u\r\nX: 1", other), (4, "u", other), (5, "u", None), (6, "u", ""), (None, "u", big), (None, "u", "z" * 2000), (None, "v", "z" * 2000), (7, "u", "a\r\n\r\nb\u0000" + "x" * 3000)]
    got = Counter(tuple(r) for r in warc.round_trip(pages(spark, rows).repartition(3)).collect())
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max((k for k, _, x in rows if x == h and k is not None), default=None)
        revisit = len(raw) >= 1000 and top is not None and i != top
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    assert got == want
    assert warc.round_trip(pages(spark, rows).limit(0)).count() == 0


def test_warc_frames_and_seek_table(spark):
    rows = [(i, f"http://h/{i}", f"page {i} " * 200) for i in range(50)]
    manifest, folder = warc.write(spark.createDataFrame(rows, SCHEMA), frame_bytes=5000)
    store, root = warc._open(folder)
    for bundle, entries in ((b, manifest.where(F.col("bundle") == b).collect()) for b in {r["bundle"] for r in manifest.collect()}):
        raw = store.open_input_file(f"{root}/{bundle}").read()
        frames = warc.read_seek_table(raw)
        assert len(frames) == 1 + max(e["frame"] for e in entries)
        starts = [sum(f[0] for f in frames[:k]) for k in range(len(frames))]
        for e in entries:
            assert e["frame_start"] == starts[e["frame"]] and e["frame_size"] == frames[e["frame"]][0]
            data = zstandard.ZstdDecompressor().decompress(raw[e["frame_start"] :][: e["frame_size"]])
            fields, payload = warc.parse_record(data[e["offset"] :][: e["size"]])
            assert fields["WARC-Record-ID"] == f"<{e['record_id']}>" and payload.decode() == rows[int(fields["X-Page-ID"])][2]
        whole = b"".join(zstandard.ZstdDecompressor().decompress(raw[s:][: f[0]]) for s, f in zip(starts, frames, strict=True))
        assert whole.count(b"WARC/1.1\r\n") == len(entries)


# main text

PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{x}}</style><script>var a = "</p>";</script></head><body>
<nav><ul><li><a href="/a">menu {i}</a></li></ul></nav><div class="ad">buy {i}</div>
<article><header><h1>not kept</h1></header><h1>Head&nbsp;{i}</h1><p>One &amp; two<br>three {i}<p><b>More <i>inline</b> text</i></p><ul><li>x<li>y</ul>
<form><p>send</p></form><aside>side</aside><div class="cookie-notice">we use cookies</div></article>
<section class="comments"><article><p>nice</p></article></section><footer>&copy; {i}</footer>"""


def test_main_text_of_articles(spark):
    rows = [(i, f"http://h/{i}", PAGE.format(i=i)) for i in range(8)] + [(20, None, None), (21, "x", "  "), (22, "http://h/9", "<p>plain &lt;p&gt; <b>text"), (22, "http://h/9", "<p>plain &lt;p&gt; <b>text"), (None, "http://h/1", PAGE.format(i=1)), (23, "http://h/2", PAGE.format(i=2)[:400])]
    got = html_extract.main_text(pages(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    want = "Head {i}\nOne & two three {i}\nMore inline text\nx\ny"
    for r in got:
        if r["page_id"] is not None and r["page_id"] < 8:
            assert r["text"] == want.format(i=r["page_id"])
        elif r["page_id"] in (20, 21):
            assert r["text"] == ""
        elif r["page_id"] == 22:
            assert r["text"] == "plain <p> text"
        elif r["page_id"] is None:
            assert r["text"] == want.format(i=1)
    assert html_extract.main_text(pages(spark, rows).limit(0)).count() == 0


def test_wrapper_without_an_article():
    page = '<div id="top">Our site</div><div class="c1"><p>Story {i} and a long line of text.</p><p>Second {i}</p><p>Share this story</p></div><div class="end">All the same</div>'
    wrapper = wrapper_of([page.format(i=i) for i in range(5)])
    assert html_extract.extract(page.format(i=77), wrapper) == "Story 77 and a long line of text.\nSecond 77\nShare this story"


def wrapper_of(pages):
    """The wrapper as it comes from its stored form."""
    return html_extract.Wrapper(html_extract.Slot.load(html_extract.induce(pages).dump()))


def match_by_force(a, b):
    """Simple tree matching by its definition."""
    if a.label != b.label:
        return 0
    best = {}
    for i in range(len(a.children) + 1):
        for j in range(len(b.children) + 1):
            best[i, j] = 0 if not i or not j else max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + match_by_force(a.children[i - 1], b.children[j - 1]))
    return 1 + best[len(a.children), len(b.children)]


def test_tree_matching_equals_its_definition():
    rng = random.Random(5)

    def tree(depth):
        inner = "".join(tree(depth - 1) for _ in range(rng.randint(0, 4))) if depth else ""
        tag = rng.choice(["div", "ul", "section"])
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(60):
        keys = {}
        a, b = (html_extract.Shape.of(html_extract.parse(tree(3) + tree(3)), keys) for _ in range(2))
        size, pairs = html_extract.tree_match(a, b, {})
        assert size == match_by_force(a, b)
        assert [*pairs] == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


#: Pages of hosts without a telling word, and what is their main text.
HOSTS = {
    "bars": ('<div class="k1">Our site</div><article><div class="k2"><a>Pass it on</a></div><h1>Head {i}</h1><p>Body of number {i}, quite long.</p></article>', "Head {i}\nBody of number {i}, quite long."),
    "promo": ('<article><p>Buy our book, it is the same offer on all pages of the site.</p></article><div class="k"><h2>Story {i}</h2><p>What happened on day {i} is told here.</p></div>', "Story {i}\nWhat happened on day {i} is told here."),
    "boxes": ('<div><div>About us and all we do, at length, for everybody to read and to know.</div><div><p>Number {i} of our tales.</p></div><div>Write to us. Call us. Visit us. We are at home.</div></div>', "Number {i} of our tales."),
    "about": ('<article><p>Text {i} is here, and it is a long one.</p><section><h3>Who writes</h3><p>A person of letters.</p></section><p>Its end, {i}.</p></article>', "Text {i} is here, and it is a long one.\nIts end, {i}."),
    "weak": ('<article><p>Text {i} is here.</p><ul class="ad-hoc"><li>Get it now</li></ul><div class="ad-hoc">Found {i} of them.</div></article>', "Text {i} is here.\nFound {i} of them."),
}


@pytest.mark.parametrize("host", HOSTS)
def test_wrapper_decides(host):
    page, want = HOSTS[host]
    wrapper = wrapper_of([page.format(i=i) for i in range(6)])
    got, alone = html_extract.extract(page.format(i=77), wrapper), html_extract.extract(page.format(i=77), None)
    assert got == want.format(i=77) and alone != got


def test_classes_that_only_hold_a_telling_word():
    for name in ("post form-body", "note side-effects", "ad-hoc", "notice-of-birth", "has-sidebar", "alert-reader"):
        assert html_extract.extract(f'<article class="{name}">body</article>', None) == "body"
        assert html_extract.extract(f'<article>a<div class="{name}">body</div></article>', None) == "a\nbody"
    for name in ("ad", "ad-slot", "ads top", "side-bar", "cookie-notice", "comments", "share-buttons", "notice", "search-form", "ArticleSidebar"):
        assert html_extract.extract(f'<article>a<div class="{name}">body</div></article>', None) == "a"


def test_copies_are_no_template():
    page = "<article><div>The same long text of an article that was put out many times.</div><p>{i}</p></article>"
    assert html_extract.extract(page.format(i=9), wrapper_of([page.format(i=i) for i in range(6)])).startswith("The same long")


def test_very_deep_and_odd_markup():
    deep = "<div>" * 600 + "text" + "</div>" * 10 + "<p"
    assert html_extract.extract(deep, None) == "text"
    assert html_extract.extract("a < b &#x41; &am <!-- never closed", None) == "a < b A &am"


def test_very_deep_and_very_wide_pages(spark):
    deep = ["<div>" * (5000 + k) + f"text {k}" for k in range(4)]
    wide = ["<div>" + "".join(f"<div>{'<p>x' * (n % 7)}{'<h2>y' * (n % k)}</div>" for n in range(5000)) + "</div>" for k in (2, 3, 4, 5)]
    rows = [(k, "http://deep/", d) for k, d in enumerate(deep)] + [(10 + k, "http://wide/", w) for k, w in enumerate(wide)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k] == f"text {k}" for k in range(4))
    assert all(got[10 + k].count("x") == sum(n % 7 for n in range(5000)) for k in range(4))


def test_wrappers_joined_by_host(spark, monkeypatch):
    rows = [(i, f"http://{'h' if i % 3 else 'g'}/", PAGE.format(i=i)) for i in range(12)] + [(50, "http://none/", None)]
    want = Counter(tuple(r) for r in html_extract.main_text(pages(spark, rows)).collect())
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(_common, "HOT_ROWS", 2)
    assert Counter(tuple(r) for r in html_extract.main_text(pages(spark, rows)).collect()) == want


def split_by_hash(one, other, n):
    """Pages by ``one`` with the n smallest hashes, and pages by ``other`` with larger ones."""
    order = lambda page: xxhash.xxh64_intdigest(page) >> 1
    few = sorted((one(i) for i in range(8 * n)), key=order)[:n]
    return few, [p for i in range(8 * n) if order(p := other(i)) > order(few[-1])][: 3 * n]


def test_all_pages_of_a_host_decide(spark):
    page = '<div class="m">Site</div><article><h1>Head {i}</h1>{box}<p>Body of number {i}, quite long as bodies are.</p></article>'
    made = lambda box: lambda i: page.format(i=i, box=box.format(i=i))
    # Of one host the pages of the smallest hashes lack the box that others share, of the other only they have the same.
    lacking, sharing = split_by_hash(made(""), made("<div>Pass it on</div>"), 10)
    same, own = split_by_hash(made("<div>Part one</div>"), made("<div>Part of {i}</div>"), 10)
    rows = [(i, f"http://{host}/", p) for i, (host, p) in enumerate([("a", p) for p in lacking + sharing] + [("b", p) for p in same + own])]
    got = [r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()]
    assert len(sharing) == len(own) == 30 and not any("Pass it on" in t for t in got[:40])
    assert all("\nPart o" in t for t in got[40:]) and all("Head" in t and "Body" in t for t in got)


def test_wrappers_count_every_page(spark, monkeypatch):
    rng = random.Random(9)
    inner = lambda i: "".join(rng.choice([f"<p>{i}", "<ul><li>x<li>y</ul>", f'<div class="own{"xyz"[i % 3] * (i + 1)}"><h2>{i}</h2></div>', "<div><p>z</div>"]) for _ in range(rng.randint(1, 9)))
    htmls = [f"<div class='top'>Site</div><section>{inner(i)}</section>" for i in range(50)]
    rows = [(f"h{i % 2}", p) for i, p in enumerate(htmls)] + [("h0", htmls[0]), ("h1", None)]
    held = spark.createDataFrame(rows, "host string, html string")
    monkeypatch.setattr(html_extract, "FAN", 3)
    got = {r["host"]: r["wrapper"] for r in html_extract.wrappers(held.repartition(5)).collect()}
    assert got == {r["host"]: r["wrapper"] for r in html_extract.wrappers(held.coalesce(1)).collect()}
    for k in range(2):
        slots = html_extract._preorder(html_extract.Slot.load(json.loads(got[f"h{k}"])))
        shapes = [html_extract._preorder(html_extract.Shape.of(html_extract.parse(p), {})) for p in htmls[k::2]]
        assert slots[0].pages == 25 and sum(s.pages for s in slots) == sum(map(len, shapes))
        assert sum(s.chars for s in slots) == sum(len(s.text()) for nodes in shapes for s in nodes)
    # By the same steps in one process; pages of one structure, as the order of merging is another.
    alike = [PAGE.format(i=i) for i in range(7)]
    (one,) = html_extract.wrappers(spark.createDataFrame([("h", p) for p in alike], "host string, html string")).collect()
    assert json.loads(one["wrapper"]) == json.loads(json.dumps(html_extract.induce(alike).dump()))


def test_names_of_single_pages_make_no_slots():
    page = '<div id="top">Site</div><div class="post {name}"><h1>Head {i}</h1><div>Pass it on</div><p>Body of number {i}, quite long as bodies are.</p></div>'
    named = [page.format(i=i, name="".join(chr(97 + int(d)) for d in str(i))) for i in range(60)]
    wrapper = wrapper_of(named)
    assert len(html_extract._preorder(wrapper.root)) == 6
    assert {html_extract.extract(p, wrapper) for p in named} == {f"Head {i}\nBody of number {i}, quite long as bodies are." for i in range(60)}
