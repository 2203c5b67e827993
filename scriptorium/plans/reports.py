"""Queries of the analytical pages: facets, top lists, rates, matrices and cross-checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions import numerals, rules, text
from scriptorium.operators import crosscheck, joins, linkage, meetings
from scriptorium.plans.registry import query, table
from scriptorium.streaming.incremental import windowed_counts


@query("faceted_filter", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE lang = 'en' AND quality = 1 AND toxic IN (0) AND contains(lower(text), 'thing') AND source IN ('src1', 'src2', 'src3')")
def faceted_filter(spark, d):
    """Several facets at once, the annotated only."""
    marks = table(spark, d, "labels").where("quality = 1 AND toxic IN (0)").select("doc_id")
    docs = table(spark, d, "documents").where((F.col("lang") == "en") & F.col("source").isin("src1", "src2", "src3") & F.contains(F.lower("text"), F.lit("thing")))
    return docs.join(marks, "doc_id", "left_semi").select("doc_id")


@query("top_by_group", "SELECT c_mktsegment AS grp, o_orderpriority AS tag, n FROM (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, o_orderpriority) <= 3")
def top_by_group(spark, d):
    """The most frequent tags of each corpus (a top-k report)."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("grp"))
    n = table(spark, d, "orders").join(c, "o_custkey").groupBy("grp", F.col("o_orderpriority").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "tag"))
    return n.withColumn("rank", rank).where("rank <= 3").drop("rank")


@query("tag_rates", "WITH b AS (SELECT l_partkey AS item, l_orderkey, o_orderpriority AS tag FROM lineitem JOIN orders ON o_orderkey = l_orderkey), n AS (SELECT item, count(DISTINCT l_orderkey) AS n FROM b GROUP BY 1) SELECT b.item, tag, round(count(DISTINCT l_orderkey) / greatest(any_value(n), 1), 6) AS rate FROM b JOIN n ON n.item = b.item GROUP BY 1, 2")
def tag_rates(spark, d):
    """How often a tag goes with an item, over the item's distinct passages."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), "l_orderkey").where("item IS NOT NULL")
    many = joins.parts(lines)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.struct(F.col("o_orderpriority").alias("tag")).alias("t"))
    tags = o.repartition(many, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("t").alias("tags"))
    b = lines.repartition(many, "l_orderkey").distinct().join(tags.hint("merge"), "l_orderkey").select("item", F.posexplode("tags").alias("at", "t"))
    # A passage counts for its item once, at its first tag, so the item's passages are the sum over its tags.
    per = b.repartition(many, "item").groupBy("item", F.col("t.tag").alias("tag")).agg(F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("at") == 0, 1)).alias("firsts"))
    n = F.sum("firsts").over(Window.partitionBy("item"))
    return per.withColumn("n", n).select("item", "tag", F.round(F.col("k") / F.greatest("n", F.lit(1)), 6).alias("rate"))


@query("incidence_matrix", "WITH i AS (SELECT l_partkey AS item FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15), s AS (SELECT l_suppkey AS source FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15) SELECT l_partkey AS item, l_suppkey AS source, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT item FROM i) AND l_suppkey IN (SELECT source FROM s) GROUP BY 1, 2")
def incidence_matrix(spark, d):
    """Counts of the most frequent items by the most frequent sources (top-k reports)."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("source"))
    top = lambda c: lines.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), c).limit(15).select(c)
    return lines.join(F.broadcast(top("item")), "item", "left_semi").join(F.broadcast(top("source")), "source", "left_semi").groupBy("item", "source").agg(F.count(F.lit(1)).alias("n"))


@query("first_seen_chapters", "SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2")
def first_seen_chapters(spark, d):
    """Distinct chapters with the place where each is first seen."""
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))


@query("commentary_index", "SELECT o_custkey AS passage, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderkey) AS comments FROM orders GROUP BY 1")
def commentary_index(spark, d):
    """Comments of a passage in the order of a rank list."""
    rank = F.when(F.col("o_orderpriority") == "2-HIGH", 0).when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(2)
    own = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("passage")).agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "o_orderkey"))).alias("c"))
    return own.select("passage", F.array_join(F.transform("c", lambda x: x["o_orderkey"].cast("string")), ",").alias("comments"))


@query("role_dose_points", "SELECT p_type AS role, CAST(floor(l_quantity / 10) AS INT) AS band, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity IS NOT NULL GROUP BY 1, 2")
def role_dose_points(spark, d):
    """Roles by dose, the undosed left out."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("role"))
    return table(spark, d, "lineitem").where("l_quantity IS NOT NULL").join(p, "l_partkey").groupBy("role", F.floor(F.col("l_quantity") / 10).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("dose_ratio", "SELECT l_partkey AS item, round(min(l_quantity) / max(l_quantity), 6) AS ratio FROM lineitem GROUP BY 1")
def dose_ratio(spark, d):
    """The smallest over the largest dose of an item, as its unit is one."""
    own = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"))
    return own.select("item", F.round(numerals.comparable_ratio(F.col("a"), F.col("b"), F.lit(True)), 6).alias("ratio"))


@query("what_if", "WITH mine AS (SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_orderkey = 7 UNION SELECT unnest([3, 5, 8, 13])), one AS (SELECT DISTINCT l_orderkey AS bag, l_partkey AS item FROM lineitem WHERE l_orderkey <> 7), s AS (SELECT bag, count(*) AS n, count(mine.item) AS shared FROM one LEFT JOIN mine USING (item) GROUP BY 1) SELECT bag, shared, round(shared / (n + (SELECT count(*) FROM mine) - shared), 6) AS jaccard FROM s WHERE shared > 0 ORDER BY jaccard DESC, bag LIMIT 5")
def what_if(spark, d):
    """Bundles like one with items added (a top-k report)."""
    one = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bag"), F.col("l_partkey").alias("item")).distinct()
    return crosscheck.what_if(one, 7, [], [3, 5, 8, 13])


@query("link_judgement", "WITH a AS (SELECT DISTINCT c_custkey % 50 AS passage, c_mktsegment AS bundle FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT c_custkey % 50 AS passage, c_mktsegment AS bundle FROM customer WHERE c_acctbal < 2000), s AS (SELECT DISTINCT c_custkey % 50 AS passage, c_mktsegment AS bundle FROM customer WHERE c_custkey % 50 < 20) SELECT passage, bundle, CASE WHEN a.bundle IS NOT NULL AND b.bundle IS NOT NULL THEN 'agree' ELSE 'mismatch' END AS verdict, CASE WHEN a.bundle IS NOT NULL AND b.bundle IS NOT NULL THEN CASE WHEN s.bundle IS NOT NULL THEN 'fine' ELSE 'review' END WHEN b.bundle IS NOT NULL AND s.bundle IS NOT NULL THEN 'missing here' WHEN b.bundle IS NOT NULL THEN 'extra there' WHEN s.bundle IS NOT NULL THEN 'missing there' ELSE 'review' END AS conclusion FROM a FULL JOIN b USING (passage, bundle) LEFT JOIN s USING (passage, bundle)")
def link_judgement(spark, d):
    """Links of two editions held against each other, judged by how strongly the passage speaks."""
    c = table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("passage"), F.col("c_mktsegment").alias("bundle"), "c_acctbal")
    strengths = c.where("passage < 20").select("passage", "bundle", F.lit("prescribed").alias("strength")).distinct()
    return crosscheck.judge_links(c.where("c_acctbal > 0"), c.where("c_acctbal < 2000"), strengths)


@query("item_set_comparison", "WITH s AS (SELECT p_brand, list_distinct(list(p_name) FILTER (WHERE p_size <= 25)) AS a, list_distinct(list(p_name) FILTER (WHERE p_size > 20)) AS b FROM part GROUP BY 1) SELECT p_brand, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) AS jaccard, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS only_b FROM s WHERE a IS NOT NULL AND b IS NOT NULL")
def item_set_comparison(spark, d):
    """Item sets of two editions: Jaccard and what either has alone."""
    s = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set(F.when(F.col("p_size") <= 25, F.col("p_name"))).alias("a"), F.collect_set(F.when(F.col("p_size") > 20, F.col("p_name"))).alias("b")).where("size(a) > 0 AND size(b) > 0")
    v = s.select("p_brand", crosscheck.compare_items(F.col("a"), F.col("b"), []).alias("v"))
    return v.select("p_brand", "v.jaccard", F.size("v.only_a").cast("long").alias("only_a"), F.size("v.only_b").cast("long").alias("only_b"))


@query("family_relations", "WITH f AS (SELECT p_name AS name, p_partkey AS id FROM part WHERE p_size = 7), r AS (SELECT name, min(id) AS root FROM f GROUP BY 1 HAVING count(*) >= 2) SELECT root AS a, id AS b FROM f JOIN r USING (name) WHERE id <> root")
def family_relations(spark, d):
    """A root and its members, as a star rather than all pairs."""
    f = table(spark, d, "part").where("p_size = 7").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    roots = f.groupBy("name").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return f.join(roots, "name").where("id <> a").select("a", F.col("id").alias("b"))


@query("shortened_titles", "SELECT doc_id, CASE WHEN length(line) > 20 THEN substr(line, 1, 20) || '…' ELSE line END AS title FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS line FROM documents)")
def shortened_titles(spark, d):
    """First lines, cut with an ellipsis."""
    line = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return table(spark, d, "documents").select("doc_id", rules.shortened(line, 20).alias("title"))


@query("readable_names", "SELECT c_custkey, trim(regexp_replace(c_name, '\\s*[-#(]?[0-9]+\\)?\\s*$', '')) AS name FROM customer")
def readable_names(spark, d):
    """Titles without trailing numbers."""
    return table(spark, d, "customer").select("c_custkey", text.readable_title(F.col("c_name")).alias("name"))


@query("payload_values", "SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def payload_values(spark, d):
    """Values out of JSON payloads."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("windowed_counts", "SELECT event_type AS kind, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    """Counts in hours of event time; the same plan runs on a stream."""
    return windowed_counts(table(spark, d, "events").select("ts", F.col("event_type").alias("kind")))


@query("family_heads", "SELECT regexp_replace(p_name, ' .*$', '') AS base, count(*) AS n, min(p_partkey) AS head FROM part GROUP BY 1")
def family_heads(spark, d):
    """Bases of names and their first members."""
    return table(spark, d, "part").groupBy(text.base_name(F.col("p_name"), " ", "?").alias("base")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("head"))


@query("dose_aware_best", """
WITH one AS (SELECT l_orderkey AS bag, l_partkey AS item, arg_max(l_quantity, (l_linenumber, l_quantity)) AS dose FROM lineitem GROUP BY 1, 2), sizes AS (SELECT bag, count(*) AS n FROM one GROUP BY 1),
p AS (SELECT x.bag AS a, y.bag AS b, count(*) AS shared, sum(least(x.dose, y.dose) / greatest(x.dose, y.dose)) AS c FROM one x JOIN one y ON x.item = y.item AND x.bag < y.bag GROUP BY 1, 2),
s AS (SELECT a, b, round(c / (m.n + n.n - shared), 6) AS score FROM p JOIN sizes m ON m.bag = a JOIN sizes n ON n.bag = b), sides AS (SELECT a AS bag, b AS other, score FROM s UNION ALL SELECT b, a, score FROM s)
SELECT bag, arg_max(other, (score, -other)) AS other, max(score) AS score FROM sides GROUP BY 1
""")
def dose_aware_best(spark, d):
    """Each bundle's nearest by items and doses."""
    one = linkage.bags(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_quantity", ["l_linenumber", "l_quantity"])
    return meetings.nearest(one)


@query("seeded_quiz")
def seeded_quiz(spark, d):
    """Ten questions with wrong answers drawn by a seed (a sampling operator)."""
    facts = table(spark, d, "part").select(F.concat_ws(" ", F.lit("brand of"), "p_name", F.col("p_partkey").cast("string")).alias("question"), F.col("p_brand").alias("answer"))
    return crosscheck.quiz(facts, 7, 10).select("question", "answer", F.array_join("options", "|").alias("options"))
