"""Queries over passages, blocks and their counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions import rewrite
from scriptorium.operators import covers, derivations, passages, transducer
from scriptorium.plans.registry import query, table
from scriptorium.sources import parsers, sections

LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)"


def _lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return sections.lines(docs, "doc_id", "text")


@query("numbered_passages", f"WITH {LINES}, n AS (SELECT doc_id, trim(line, ' ') AS p, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS number FROM l WHERE trim(line, ' ') <> '') SELECT doc_id, number, md5(p) AS digest FROM n WHERE length(p) >= 12")
def numbered_passages(spark, d):
    """Numbered passages of the documents, whole."""
    return passages.numbered(_lines(spark, d), "doc_id").select("doc_id", "number", F.md5("passage").alias("digest"))


@query("line_blocks", f"""
WITH {LINES}, m AS (SELECT *, CASE WHEN length(line) < 40 THEN 'head' WHEN position('|' IN line) > 0 OR position('#' IN line) > 0 THEN 'items' WHEN ends_with(line, '.') THEN 'prose' END AS own FROM l WHERE trim(line, ' ') <> ''),
p AS (SELECT *, sum(CASE WHEN own = 'head' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM m),
s AS (SELECT *, CASE WHEN own = 'head' THEN 'head' ELSE coalesce(last_value(CASE WHEN own <> 'head' THEN own END IGNORE NULLS) OVER (PARTITION BY doc_id, block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'intro') END AS kind FROM p WHERE block > 0)
SELECT doc_id, block::BIGINT AS block, kind, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM s GROUP BY 1, 2, 3
""")
def line_blocks(spark, d):
    """Blocks of headings, items and prose by a state machine over lines."""
    kinds = {"head": F.char_length("line") < 40, "items": F.col("line").rlike("[|#]"), "prose": F.col("line").endswith(".")}
    out = passages.blocks(_lines(spark, d), "doc_id", kinds, "head", "intro")
    return out.select("doc_id", F.col("block").cast("long").alias("block"), "kind", "n", F.md5("text").alias("digest"))


@query("heading_parts", "SELECT p_partkey AS id, regexp_extract(p_name || ' (' || p_brand || ')', '^\\s*([a-zA-Z ]+?)\\s*\\(([^)]*)\\)\\s*$', 1) AS name, p_brand AS note, contains(p_brand, '3') AS lost FROM part")
def heading_parts(spark, d):
    """Name, note and lost flag of headings."""
    line = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), passages.heading(line, "[a-zA-Z ]+?", "3").alias("h")).select("id", "h.*")


@query("title_attachment", """
WITH t AS (SELECT item_id AS title_id, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS title FROM benchmark)
SELECT DISTINCT doc_id AS text_id, title_id FROM documents JOIN t ON trim(title) <> '' AND (contains(text, title || ' ') OR contains(text, title || '.') OR contains(text, title || ',') OR contains(text, ' ' || title))
""")
def title_attachment(spark, d):
    """Documents attached to passages whose first words they hold in one of four patterns."""
    titles = table(spark, d, "benchmark").select(F.col("item_id").alias("title_id"), F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2))).alias("title"))
    return passages.attach_by_title(table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"), titles, ["{} ", "{}.", "{},", " {}"])


@query("derivation_phrases", "SELECT doc_id, array_to_string(list_distinct(list_filter([regexp_extract(t, 'the ([a-z]+) of', 1), regexp_extract(t, 'of ([a-z]+)', 1), regexp_extract(t, 'de ([a-z]+)', 1), regexp_extract(t, 'und ([a-z]+)', 1)], lambda x: x <> '').list_sort()).list_sort(), '|') AS phrases FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def derivation_phrases(spark, d):
    """The first hit of each of four phrases, without repeats."""
    hits = passages.derivations(F.coalesce("text", F.lit("")), ["the ([a-z]+) of", "of ([a-z]+)", "de ([a-z]+)", "und ([a-z]+)"])
    return table(spark, d, "documents").select("doc_id", F.array_join(F.sort_array(hits), "|").alias("phrases"))


@query("stated_counts", "SELECT l_orderkey AS bag, CASE WHEN max(l_linenumber) = count(*) THEN 'all' WHEN max(l_linenumber) = count(*) FILTER (l_discount = 0) THEN 'missing' ELSE 'differs' END AS fit FROM (SELECT l_orderkey, least(l_linenumber, 3) AS l_linenumber, l_discount FROM lineitem) GROUP BY 1")
def stated_counts(spark, d):
    """Whether a stated number of items is that of all, or of those without a dose."""
    own = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("bag")).agg(F.collect_list("l_discount").alias("items"), F.max(F.least("l_linenumber", F.lit(3))).alias("stated"))
    return own.select("bag", passages.stated_count(F.col("items"), F.size(F.filter("items", lambda x: x == 0)), F.col("stated")).alias("fit"))


@query("orphan_fold", "SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), turn) AS owner FROM conversations")
def orphan_fold(spark, d):
    """Turns that aren't the user's belong to the user's last one before."""
    return passages.fold_orphans(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") != "user")


@query("interleaved", """
WITH x AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, text AS a FROM conversations WHERE role = 'user'), y AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, text AS b FROM conversations WHERE role <> 'user')
SELECT coalesce(x.conv_id, y.conv_id) AS conv_id, coalesce(x.pos, y.pos) AS pos, a, b FROM x FULL JOIN y ON x.conv_id = y.conv_id AND x.pos = y.pos
""")
def interleaved(spark, d):
    """The n-th question of a conversation beside its n-th answer."""
    c = table(spark, d, "conversations")
    return passages.interleave(c.where("role = 'user'"), c.where("role <> 'user'"), "conv_id", "turn", "text")


@query("anomaly_hints", """
WITH r AS (SELECT source, count(*) AS n, avg(CASE WHEN text IS NULL OR text = '' THEN 1.0 ELSE 0.0 END) AS empty, avg(CASE WHEN length(text) < 200 THEN 1.0 ELSE 0.0 END) AS short, avg(CASE WHEN position('|' IN coalesce(text, '')) > 0 THEN 1.0 ELSE 0.0 END) AS listed FROM documents GROUP BY 1)
SELECT source, n, concat_ws('|', CASE WHEN empty > 0.05 THEN 'empty' END, CASE WHEN short > 0.1 THEN 'short' END, CASE WHEN listed > 0.02 THEN 'lists' END, CASE WHEN n < 20 THEN 'few' END) AS hints FROM r
""")
def anomaly_hints(spark, d):
    """Hints by thresholds on the rates of a source."""
    rate = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    text = F.coalesce("text", F.lit(""))
    rates = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), rate(text == "").alias("empty"), rate(F.char_length("text") < 200).alias("short"), rate(F.contains(text, F.lit("|"))).alias("listed"))
    rules = [("empty", F.col("empty") > 0.05), ("short", F.col("short") > 0.1), ("lists", F.col("listed") > 0.02), ("few", F.col("n") < 20)]
    return passages.hints(rates, rules).select("source", "n", F.array_join("hints", "|").alias("hints"))


@query("markup_counters", "SELECT kind, coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT unnest([{'kind': 'comment', 'n': len(regexp_extract_all(html, '<!--'))}, {'kind': 'entity', 'n': len(regexp_extract_all(html, '&[a-z]+;'))}, {'kind': 'paragraph', 'n': len(regexp_extract_all(html, '<p[ >]'))}], recursive := true) FROM pages) GROUP BY 1")
def markup_counters(spark, d):
    """How often kinds of markup occur in all pages."""
    return passages.counters(table(spark, d, "pages"), "html", {"comment": "<!--", "entity": "&[a-z]+;", "paragraph": "<p[ >]"})


@query("corpus_comparison", "SELECT o_orderstatus AS corpus, l_shipmonth AS item, n, rank FROM (SELECT o_orderstatus, l_shipmonth, count(*) AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, l_shipmonth) AS rank FROM (SELECT o_orderstatus, l_partkey % 100 AS l_shipmonth FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1, 2) WHERE rank <= 8")
def corpus_comparison(spark, d):
    """The eight most frequent items of each corpus (a report)."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderstatus").alias("corpus"), (F.col("l_partkey") % 100).alias("item"))
    return passages.top_of_group(rows, "corpus", "item", 8)


@query("shown_statements", """
SELECT event_id, CASE WHEN props IS NULL OR trim(props) = '' THEN '-' WHEN event_type = 'purchase' THEN c WHEN event_type = 'view' THEN '(' || c || ')' ELSE '? ' || c END AS shown
FROM (SELECT *, CASE WHEN length(props) > 12 THEN substr(props, 1, 12) || '…' ELSE props END AS c FROM events)
""")
def shown_statements(spark, d):
    """Statements as shown by their status."""
    status = F.when(F.col("event_type") == "purchase", "verified").when(F.col("event_type") == "view", "inferred").otherwise("open")
    return table(spark, d, "events").select("event_id", passages.shown(status, F.col("props"), 12).alias("shown"))


@query("projected_evidence", """
SELECT event_id, coalesce(props, 'none') AS licence, CASE WHEN value < 50 THEN 'changed' END AS variant FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL
""")
def projected_evidence(spark, d):
    """Evidence with all needed fields, a default licence, and variants only where one differs."""
    op = F.array(F.struct(F.when(F.col("value") < 50, "changed").otherwise("equal").alias("op"), F.lit("t").alias("text")))
    records = table(spark, d, "events").select("event_id", "user_id", "value", F.col("props").alias("licence"), op.alias("variants"))
    return passages.projected(records, ["user_id", "value"], {"licence": "none"}, "variants").select("event_id", "licence", F.get("variants", F.lit(0))["op"].alias("variant"))


#: Items stop at a blank line, and only a heading opens them again.
SHELVES = transducer.Machine(
    ("outside", "open", "items", "closed"),
    "outside",
    ("blank", "head", "item", "plain"),
    {("*", "head"): "open", ("open", "item"): "items", ("open", "plain"): "closed", ("items", "blank"): "outside", ("items", "plain"): "closed", ("closed", "item"): "outside"},
)


def _step(state: str) -> str:
    """The machine's move in SQL."""
    cases = " ".join(f"WHEN {state} = '{s}' AND k.kind = '{k}' THEN '{SHELVES.step(s, k)}'" for s in SHELVES.states for k in SHELVES.kinds if SHELVES.step(s, k) != s)
    return f"CASE {cases} ELSE {state} END"


@query("machine_states", f"""
WITH RECURSIVE {LINES}, k AS (SELECT doc_id, pos, CASE WHEN trim(line, ' ') = '' THEN 'blank' WHEN length(line) < 40 THEN 'head' WHEN contains(line, '|') OR contains(line, '#') OR contains(line, ',') THEN 'item' ELSE 'plain' END AS kind FROM l),
s AS (SELECT doc_id, pos, kind, {_step("'outside'")} AS state FROM k WHERE pos = 1 UNION ALL SELECT k.doc_id, k.pos, k.kind, {_step("s.state")} FROM s JOIN k ON k.doc_id = s.doc_id AND k.pos = s.pos + 1)
SELECT doc_id, kind, state, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM s GROUP BY 1, 2, 3
""")
def machine_states(spark, d):
    """States of a machine over the lines of documents, in which blank lines close lists."""
    line = F.col("line")
    kind = F.when(F.trim(line) == "", "blank").when(F.char_length(line) < 40, "head").when(line.rlike("[|#,]"), "item").otherwise("plain")
    held = transducer.run(_lines(spark, d).withColumn("doc", F.col("doc_id")), "doc_id", kind, SHELVES)
    first = _lines(spark, d).agg(F.min("pos")).first()[0] or 0
    return held.groupBy("doc_id", "kind", "state").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pos") - first + 1).cast("long").alias("places"))


@query("parsed_clauses")
def parsed_clauses(spark, d):
    """Numbered clauses of documents and what is attached to the headings between them: the parser with patterns for plain prose."""
    style = parsers.Style(number=r"^[0-9]+[.)]? ", heading=r"^([^.,;:!?]{1,39}?)(?: ?[(]([^)]*)[)])?$", item=r"[|#]", directions=r"^[^.]*:", aside=r"^[*]")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source"), "text")
    tables = parsers.clauses(docs, style)
    sizes = tables["attached"].groupBy("source", "number").agg(F.count(F.lit(1)).alias("attached"), F.countDistinct("name").alias("headings"))
    out = tables["clauses"].join(sizes, ["source", "number"], "left")
    return out.select(F.col("source").alias("doc_id"), "number", F.md5("text").alias("digest"), F.coalesce("attached", F.lit(0)).alias("attached"), F.coalesce("headings", F.lit(0)).alias("headings"))


@query("label_cover", """
WITH t AS (SELECT term, min(concept) AS concept FROM (SELECT unnest(string_split(p_name, ' ')) AS term, p_brand AS concept FROM part WHERE p_size <= 10) GROUP BY 1),
a AS (SELECT DISTINCT item_id AS id, unnest(string_split(lower(coalesce(text, '')), ' ')) AS term FROM benchmark UNION SELECT DISTINCT p_partkey + 1000000, unnest(string_split(p_name, ' ')) FROM part)
SELECT id, count(*) = count(concept) AS covered, coalesce(string_agg(concept, '|' ORDER BY term) FILTER (WHERE concept IS NOT NULL), '') AS concepts, coalesce(string_agg(term, '|' ORDER BY term) FILTER (WHERE concept IS NULL), '') AS rest FROM a LEFT JOIN t USING (term) GROUP BY 1
""")
def label_cover(spark, d):
    """Which passages and names the words of small parts cover as a whole, and what is left of the others."""
    part, items = table(spark, d, "part"), table(spark, d, "benchmark")
    words = part.where("p_size <= 10").select(F.explode(F.split("p_name", " ")).alias("term"), F.col("p_brand").alias("concept"))
    labels = items.select(F.col("item_id").alias("id"), F.split(F.lower(F.coalesce("text", F.lit(""))), " ").alias("parts")).union(part.select(F.col("p_partkey") + 1000000, F.split("p_name", " ")))
    return covers.cover(labels, words).select("id", "covered", F.array_join("concepts", "|").alias("concepts"), F.array_join("rest", "|").alias("rest"))


@query("derived_bundles", """
WITH RECURSIVE b AS (SELECT p_brand AS brand, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, string_split(p_name, ' ') AS w, lower(p_type) AS kind, p_size % 7 = 0 AS own FROM part),
r AS (SELECT brand, id, k, CASE WHEN own THEN list_append(w, kind) ELSE []::VARCHAR[] END AS items FROM b WHERE k = 1
UNION ALL SELECT b.brand, b.id, b.k, CASE WHEN own THEN list_append(w, kind) WHEN len(r.items) = 0 THEN []::VARCHAR[] ELSE list_concat(list_filter(r.items, lambda x: x <> w[2]), [w[1]]) END FROM r JOIN b ON b.brand = r.brand AND b.k = r.k + 1)
SELECT id, array_to_string(items, ' ') AS items FROM r
""")
def derived_bundles(spark, d):
    """Bundles that are the one before them of their brand, without one word and with another."""
    part = table(spark, d, "part")
    before = F.lag("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    words, own = F.split("p_name", " "), F.col("p_size") % 7 == 0
    blocks = part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("name"), before.alias("base"), F.array(F.get(words, F.lit(1))).alias("removed"), F.array(F.get(words, F.lit(0))).alias("added"), F.when(own, F.array_append(words, F.lower("p_type"))).alias("items"))
    return derivations.resolve(blocks, "brand").select(F.col("pos").alias("id"), F.array_join("items", " ").alias("items"))


PHRASES = {"the": "<the>", "there": "<there>", "other": "<other>", "er": "<er>", "ation": "<ation>", "ti": "<ti>", "e t": "<e t>", "a": "<a>", "und": "<und>", "unde": "<unde>"}


@query("phrase_conversion", f"SELECT doc_id, md5(regexp_replace(text, '({'|'.join(sorted(PHRASES, key=len, reverse=True))})', '<\\1>', 'g')) AS digest, (length(regexp_replace(text, '({'|'.join(sorted(PHRASES, key=len, reverse=True))})', '<\\1>', 'g')) - length(text)) // 2 AS replaced FROM documents WHERE text IS NOT NULL")
def phrase_conversion(spark, d):
    """Texts rewritten by overlapping phrases: the longest first, from the left, in one pass."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return rewrite.convert(docs, "text", list(PHRASES.items())).select("doc_id", F.md5("converted").alias("digest"), "replaced")
