"""Queries over texts, the property graph and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import offsets, text
from scriptorium.operators import gapped, graph, linkage, locating, postings, search
from scriptorium.operators.lineage import new_folder
from scriptorium.plans.registry import query, table
from scriptorium.sources import sections

GRAMS = "list_distinct(CASE WHEN length(t) < 3 THEN [t] ELSE [t[i:i+2] FOR i IN range(1, length(t) - 1)] END)"


@query("similarity_verdict", "SELECT a.p_partkey AS id, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS ratio, CASE WHEN 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) >= 0.95 - 1e-9 THEN 'agree' WHEN 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) >= 0.8 - 1e-9 THEN 'variant' ELSE 'mismatch' END AS verdict FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def similarity_verdict(spark, d):
    """Edit similarity of neighbours and what it amounts to."""
    p = table(spark, d, "part")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    r = text.similarity(F.col("p_name"), F.col("other"))
    return p.join(q, "p_partkey").select(F.col("p_partkey").alias("id"), F.round(r, 6).alias("ratio"), text.verdict(r).alias("verdict"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    right = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return left, right


DICE = f"""
WITH a AS (SELECT item_id AS left_id, {GRAMS} AS g FROM (SELECT item_id, coalesce(text, '') AS t FROM benchmark)), b AS (SELECT doc_id AS right_id, {GRAMS} AS g FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
la AS (SELECT left_id, len(g) AS na, unnest(g) AS gram FROM a), lb AS (SELECT right_id, len(g) AS nb, unnest(g) AS gram FROM b),
p AS (SELECT left_id, right_id, 2 * count(*) / (any_value(na) + any_value(nb)) AS dice FROM la JOIN lb USING (gram) GROUP BY 1, 2)
"""


@query("dice_best_match", DICE + "SELECT item_id AS left_id, CASE WHEN max(round(dice, 3)) >= 0.35 THEN arg_max(right_id, (round(dice, 3), -right_id)) END AS right_id, coalesce(max(round(dice, 3)), 0.0) AS score FROM benchmark LEFT JOIN p ON left_id = item_id GROUP BY 1")
def dice_best_match(spark, d):
    """The best partner of each passage by trigrams, through an index of grams."""
    left, right = _sides(spark, d)
    return linkage.best_match(left, linkage.dice_pairs(left, right, best=True), 0.35)


ORDERED_PASS = """
, s AS (SELECT left_id, right_id, round(dice, 3) AS score FROM p WHERE round(dice, 3) >= 0.42), o AS (SELECT left_id, row_number() OVER (ORDER BY left_id) AS k FROM (SELECT DISTINCT left_id FROM s)),
g AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS left_id, NULL::BIGINT AS right_id, NULL::DOUBLE AS score
  UNION ALL
  SELECT o.k, CASE WHEN count(s.right_id) = 0 THEN g.taken ELSE list_append(g.taken, arg_min(s.right_id, (-s.score, s.right_id))) END, o.left_id, arg_min(s.right_id, (-s.score, s.right_id)), max(s.score)
  FROM g JOIN o ON o.k = g.k + 1 LEFT JOIN s ON s.left_id = o.left_id AND NOT list_contains(g.taken, s.right_id) GROUP BY o.k, o.left_id, g.taken
)
SELECT 0 AS grp, left_id, right_id, score FROM g WHERE right_id IS NOT NULL
"""


@query("one_to_one", DICE.replace("WITH a AS", "WITH RECURSIVE a AS") + ORDERED_PASS)
def one_to_one(spark, d):
    """Greedy assignment of passages to texts in the order of the passages."""
    left, right = _sides(spark, d)
    # Scores are rounded, so a little less is let pass.
    pairs = linkage.dice_pairs(left, right, least=0.419).select(F.lit(0).alias("grp"), "left_id", "right_id", F.round("dice", 3).alias("score"))
    return linkage.one_to_one(pairs, "grp", 0.42)


@query("locate_quotes")
def locate_quotes(spark, d):
    """Where the benchmark's passages stand in the documents, with small differences."""
    left, right = _sides(spark, d)
    return locating.locate(left, right)


REMARK = "\n~ a remark of another hand, which no turn has ~\n"

KEEP = r"[\p{L}\p{N}\p{Co}]"
DROP = r"[^\p{L}\p{N}\p{Co}]"


def _witness(turns: DataFrame, between: str) -> DataFrame:
    whole = turns.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), between).alias("text"))
    return whole.withColumn("witness", F.lit("w"))


@query(
    "ordered_collation",
    f"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations),
w AS (SELECT *, CAST(sum(length(x) + {len(REMARK)}) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) - length(x) - {len(REMARK)} AS base, regexp_matches(x, '{KEEP}') AS has FROM t)
SELECT conv_id AS source, turn AS pos, CASE WHEN has THEN 'agree' ELSE 'missing' END AS verdict, CASE WHEN has THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ratio,
CASE WHEN has THEN base + length(regexp_extract(x, '^{DROP}*')) END AS "start", CASE WHEN has THEN base + length(regexp_replace(x, '{DROP}*$', '')) END AS "end" FROM w
""",
)
def ordered_collation(spark, d):
    """Where the turns of each conversation stand in its whole text, in which an editor has put remarks between them."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("pos"), "text")
    out = gapped.collate(turns, _witness(turns, REMARK))
    return out.select("source", F.col("pos").cast(dict(turns.dtypes)["pos"]).alias("pos"), "verdict", "ratio", "start", "end")


@query("gapped_collation")
def gapped_collation(spark, d):
    """The turns of each conversation in a damaged copy: every third turn is gone, one of seven words lacks its middle, and a remark follows each first sentence."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("pos"), "text")
    damaged = F.regexp_replace(F.regexp_replace("text", r"((?:\w+\W+){6}\w)\w+(\w)", "$1$2"), r"^([^.]{20,}\. )", f"$1{REMARK.strip()}. ")
    copy = turns.where("pos % 3 <> 2").withColumn("text", damaged)
    out = gapped.notes(gapped.collate(turns, _witness(copy, "\n")))
    return out.select("source", "pos", "verdict", "ratio", "start", "end", "pieces", "placed", "gaps", "gap_signs", F.size("segments").alias("segments"), "note")


@query(
    "offset_maps",
    f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), '') AS c, coalesce(text, '') AS x FROM documents WHERE coalesce(length(text), 0) > 0), p AS (SELECT doc_id, x, list_filter(range(1, len(c) + 1), lambda i: regexp_matches(c[i], '{KEEP}')) AS places FROM s)
SELECT doc_id, CAST(len(places) AS BIGINT) AS n, md5(regexp_replace(x, '{DROP}', '', 'g')) AS form, CASE WHEN len(places) > 0 THEN places[len(places) // 2 + 1] - 1 END AS middle, CASE WHEN len(places) > 0 THEN x[places[len(places) // 2 + 1]] END AS sign,
CAST(length(regexp_replace(x[1:length(x) // 3], '{DROP}', '', 'g')) AS BIGINT) AS third FROM p
UNION ALL SELECT doc_id, 0, md5(''), NULL, NULL, 0 FROM documents WHERE coalesce(length(text), 0) = 0
""",
)
def offset_maps(spark, d):
    """Texts in normal form with a map to where its signs stood: from its middle back to the source, and from a third of the source on."""
    docs = offsets.with_offsets(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", offsets.Form(compatible=False))
    n, half = F.char_length("norm"), F.floor(F.char_length("norm") / 2)
    middle = offsets.to_source(F.col("runs"), half)
    third = offsets.to_normal(F.col("runs"), F.floor(F.char_length("text") / 3))
    return docs.select("doc_id", n.cast("long").alias("n"), F.md5("norm").alias("form"), middle.cast("long").alias("middle"), F.when(n > 0, F.substring(F.col("text"), middle.cast("int") + 1, F.lit(1))).alias("sign"), third.cast("long").alias("third"))


@query("content_keys", "SELECT doc_id, substr(sha256(coalesce(text, '') || chr(10) || coalesce(lang, '')), 1, 16) AS key FROM documents")
def content_keys(spark, d):
    """Short content hashes for incremental caches."""
    return table(spark, d, "documents").select("doc_id", text.content_key(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))).alias("key"))


@query("loose_forms", "SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}\\p{Co}]', '', 'g')) AS n FROM documents")
def loose_forms(spark, d):
    """Texts without what doesn't count in comparisons."""
    return table(spark, d, "documents").select("doc_id", F.char_length(text.letters_and_digits(F.coalesce("text", F.lit("")))).cast("long").alias("n"))


@query("padded_ids", "SELECT c_custkey AS id, c_mktsegment || '-' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS key FROM customer")
def padded_ids(spark, d):
    """Ids of a source, a chapter and a number."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.padded_id(F.col("c_mktsegment"), (F.col("c_nationkey"), 3), (F.col("c_custkey"), 9)).alias("key"))


@query("line_sections", "WITH l AS (SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line FROM documents, generate_series(1, len(string_split(coalesce(text, ''), chr(10)))) t(i)), m AS (SELECT *, len(string_split(trim(line), ' ')) <= 2 AS head FROM l), s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM m) SELECT doc_id, section::BIGINT AS section, max(CASE WHEN head THEN line END) AS heading, count(*) FILTER (WHERE NOT head) AS lines, coalesce(sum(length(line)) FILTER (WHERE NOT head), 0)::BIGINT AS chars FROM s GROUP BY 1, 2")
def line_sections(spark, d):
    """Sections opened by heading lines (of at most two words)."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    head = lambda line: F.size(F.split(F.trim(line), " ")) <= 2
    return sections.line_sections(docs, "doc_id", "text", head)


@query("paragraph_units", "WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), p AS (SELECT doc_id, unnest(ls) AS body, generate_subscripts(ls, 1) AS pos FROM l) SELECT doc_id, pos::INT AS pos, length(body) AS n FROM p WHERE length(body) >= 24 OR (length(body) >= 10 AND regexp_matches(body, '^[\\[【(]'))")
def paragraph_units(spark, d):
    """Paragraphs numbered first and then sieved by length, so that numbers don't move."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return sections.paragraphs(docs, "doc_id", "text", "\n").select("doc_id", "pos", F.char_length("body").cast("long").alias("n"))


@query("markup_strip", "SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n FROM pages")
def markup_strip(spark, d):
    """Markup taken off by a chain of rewrites."""
    return table(spark, d, "pages").select("page_id", F.char_length(sections.strip_tags(F.coalesce("html", F.lit("")))).cast("long").alias("n"))


@query("link_extraction", "SELECT page_id, len(regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1)) AS links, len(list_distinct(regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1))) AS targets FROM pages")
def link_extraction(spark, d):
    """Links of pages and their distinct targets."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("links"), F.size(F.array_distinct(links)).cast("long").alias("targets"))


@query("vocabulary_mentions")
def vocabulary_mentions(spark, d):
    """Mentions of a controlled vocabulary, longest first, without overlaps."""
    terms = [(w, f"term.{i}") for i, w in enumerate(["the", "tion", "ation", "there", "her", "ing", "hein", "the thing"])]
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.annotate(docs, terms).select("id", F.size("mentions").alias("n"), F.aggregate("mentions", F.lit(0), lambda a, m: a + m["end"] - m["start"]).alias("chars"))


BM25 = r"""
WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
h AS (SELECT id, len(w) AS n, term, len(list_filter(w, lambda x: starts_with(x, term))) AS tf FROM t, (VALUES ('thing'), ('queaux'), ('idiot')) v(term)), f AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY 1)
SELECT id, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * h.n / mean))), 6) AS score FROM h JOIN f USING (term), s WHERE tf > 0 GROUP BY 1 ORDER BY score DESC, id LIMIT 40
"""


@query("full_text_search", BM25)
def full_text_search(spark, d):
    """The forty best documents for prefixes of words (a top-k report)."""
    return search.bm25(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), ["thing", "queaux", "idiot"], 40)


@query("stored_search", BM25)
def stored_search(spark, d):
    """The forty best documents by a stored index of posting blocks (a top-k report)."""
    index = postings.build(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), new_folder(spark, "postings"), fuzzy=False)
    return index.search(["thing", "queaux", "idiot"], 40)


# One edit, by signs: equal lengths with one other sign, or one word is the other without a sign.
ONE_EDIT = "(length(x) = length(term) AND len(list_filter(range(1, length(term) + 1), lambda i: x[i] <> term[i])) <= 1) OR (length(x) = length(term) + 1 AND len(list_filter(range(1, length(x) + 1), lambda i: x[1:i - 1] || x[i + 1:] = term)) > 0) OR (length(x) = length(term) - 1 AND len(list_filter(range(1, length(term) + 1), lambda i: term[1:i - 1] || term[i + 1:] = x)) > 0)"
FUZZY = BM25.replace("starts_with(x, term)", f"starts_with(x, term) OR {ONE_EDIT}").replace("('thing'), ('queaux'), ('idiot')", "('other'), ('haus'), ('monde')")


@query("stored_fuzzy_search", FUZZY)
def stored_fuzzy_search(spark, d):
    """The forty best documents for prefixes or words with one edit, by a stored index (a top-k report)."""
    index = postings.build(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), new_folder(spark, "postings"))
    return index.search(["other", "haus", "monde"], 40, fuzzy=True)


@query("search_documents", "SELECT 'part' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand || ' ' || p_type AS text FROM part UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, s_name FROM supplier UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name, c_mktsegment FROM customer")
def search_documents(spark, d):
    """One table of what can be searched."""
    return search.search_documents(
        {
            "part": table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("text")),
            "supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_name").alias("text")),
            "customer": table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("text")),
        }
    )


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    key = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    c, o, n, s = (table(spark, d, t) for t in ("customer", "orders", "nation", "supplier"))
    nodes = graph.union_nodes(
        [
            n.select(key("n", "n_nationkey").alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("label")),
            c.select(key("c", "c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_name").alias("label")),
            s.select(key("s", "s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_name").alias("label")),
            o.where("o_orderstatus <> 'P'").select(key("o", "o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_orderpriority").alias("label")),
        ]
    )
    edges = graph.edge(c, "lives", key("c", "c_custkey"), key("n", "c_nationkey")).union(graph.edge(s, "lives", key("s", "s_suppkey"), key("n", "s_nationkey"))).union(graph.edge(o, "placed", key("c", "o_custkey"), key("o", "o_orderkey")))
    return nodes, edges


EDGES = """
WITH nodes AS (SELECT 'n' || n_nationkey AS id, 'nation' AS kind, n_name AS label FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'order', o_orderpriority FROM orders WHERE o_orderstatus <> 'P'),
every AS (SELECT 'lives' AS kind, 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'lives', 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'placed', 'c' || o_custkey, 'o' || o_orderkey FROM orders),
edges AS (SELECT kind || ':' || src || '->' || dst AS id, * FROM every WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))
"""


@query("graph_statistics", EDGES + "SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY 1")
def graph_statistics(spark, d):
    """Edges by kind, after those without a node are gone."""
    nodes, edges = _graph(spark, d)
    return graph.statistics(graph.keep_joined(edges, nodes)[0])


@query("graph_dangling", EDGES + "SELECT kind, count(*) AS skipped FROM every WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes) GROUP BY 1")
def graph_dangling(spark, d):
    """Edges without a node, by kind; too many would stop the build."""
    nodes, edges = _graph(spark, d)
    return graph.guard(edges, nodes, 10**12)[1]


@query("graph_neighbours", EDGES + "SELECT e.dst AS seed, e.id AS edge, e.kind, e.src AS id, n.label FROM edges e JOIN nodes n ON n.id = e.src WHERE e.dst LIKE 'n%'")
def graph_neighbours(spark, d):
    """What points to the nations."""
    nodes, edges = _graph(spark, d)
    good, _ = graph.keep_joined(edges, nodes)
    return graph.neighbours(good, nodes, nodes.where("kind = 'nation'"), "in")


@query("graph_adjacency", EDGES + "SELECT nodes.id, nodes.kind, count(edges.id) AS n FROM nodes LEFT JOIN edges ON src = nodes.id GROUP BY 1, 2")
def graph_adjacency(spark, d):
    """The outgoing edges of each node."""
    nodes, edges = _graph(spark, d)
    good, _ = graph.keep_joined(edges, nodes)
    return graph.adjacency(good, nodes).select("id", "kind", F.size("edges").cast("long").alias("n"))


@query("graph_neighbourhood", EDGES + ", h1 AS (SELECT src AS id FROM edges WHERE dst = 'n3'), h2 AS (SELECT dst AS id FROM edges WHERE src IN (SELECT id FROM h1) AND dst NOT IN (SELECT id FROM h1) AND dst <> 'n3'), a AS (SELECT 'n3' AS id, 0 AS hop UNION SELECT id, 1 FROM h1 UNION SELECT id, 2 FROM h2) SELECT * FROM a ORDER BY hop, id LIMIT 80")
def graph_neighbourhood(spark, d):
    """Two steps around a nation, eighty nodes at most (the feature's bound)."""
    nodes, edges = _graph(spark, d)
    good, _ = graph.keep_joined(edges, nodes)
    return graph.neighbourhood(good, nodes, "n3", 2)[0]


@query("graph_search", EDGES + "SELECT id, kind, label, CASE WHEN id = 'c11' THEN 0 WHEN label = 'c11' THEN 1 ELSE 2 END AS tier FROM nodes WHERE id = 'c11' OR label = 'c11' OR contains(lower(label), 'c11') ORDER BY tier, label, id LIMIT 20")
def graph_search(spark, d):
    """Nodes by id, label and part of a label."""
    return graph.find_nodes(_graph(spark, d)[0], "c11", 20)


@query("symmetric_neighbours", "WITH p AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey <> s_nationkey), b AS (SELECT a, b FROM p UNION SELECT b, a FROM p) SELECT a AS id, count(*) AS n, min(b) AS least FROM b GROUP BY 1")
def symmetric_neighbours(spark, d):
    """Links taken in both directions."""
    p = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey").select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"))
    both = p.union(p.select("b", "a")).distinct()
    return both.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("least"))


@query("tree_reachability", "WITH RECURSIVE w AS (SELECT c_custkey AS id, 0 AS depth FROM customer WHERE c_custkey = 1 UNION ALL SELECT c_custkey, depth + 1 FROM w JOIN customer ON c_custkey IN (2 * w.id, 2 * w.id + 1)) SELECT id, min(depth)::INT AS depth FROM w GROUP BY 1")
def tree_reachability(spark, d):
    """What the root of a decision tree reaches, by recursion."""
    c = table(spark, d, "customer").where("c_custkey > 1").select(F.lit(0).alias("tree"), F.floor(F.col("c_custkey") / 2).cast("long").alias("src"), F.col("c_custkey").alias("dst"))
    roots = table(spark, d, "customer").where("c_custkey = 1").select(F.lit(0).alias("tree"), F.col("c_custkey").alias("id"))
    return graph.reachable(c, roots).select("id", "depth")
