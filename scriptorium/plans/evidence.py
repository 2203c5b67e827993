"""Queries over evidence (events: user as entity, group by value, verdict by type), windows, sorts and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import rules, text
from scriptorium.operators import evidence, joins
from scriptorium.plans.registry import query, table


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Events as evidence: entity, field, source, grp, verdict, ratio, pos."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.col("user_id").alias("entity"),
        F.concat(F.lit("f"), (k % 3).cast("string")).alias("field"),
        F.concat(F.lit("s"), (k % 7).cast("string")).alias("source"),
        F.concat(F.lit("g"), (k % 4).cast("string")).alias("grp"),
        F.when(F.col("event_type") == "view", "agree").when(F.col("event_type") == "click", "variant").when(F.col("event_type") == "error", "missing").otherwise("mismatch").alias("verdict"),
        F.floor(F.col("value")).cast("long").alias("locator"),
        F.least(F.floor(F.col("value")) / 100, F.lit(1.0)).alias("ratio"),
        F.col("event_id").alias("pos"),
    )


RECORDS = """
WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events), r AS (
  SELECT user_id AS entity, 'f' || (k % 3) AS field, 's' || (k % 7) AS source, 'g' || (k % 4) AS grp,
         CASE event_type WHEN 'view' THEN 'agree' WHEN 'click' THEN 'variant' WHEN 'error' THEN 'missing' ELSE 'mismatch' END AS verdict,
         floor(value)::BIGINT AS locator, least(floor(value) / 100, 1.0) AS ratio, event_id AS pos FROM e)
"""
FIELDS = (
    RECORDS
    + """, f AS (SELECT entity, field,
  bool_or(counts AND verdict IN ('agree', 'variant')) AS yes, bool_or(counts AND verdict = 'mismatch') AS no, bool_or(counts AND verdict = 'mismatch' AND grp = 'g2') AS against
  FROM (SELECT *, grp <> 'g0' AND NOT (grp = 'g1' AND verdict = 'mismatch') AS counts FROM r) GROUP BY 1, 2),
l AS (SELECT entity, field, CASE WHEN yes AND against THEN 'disputed' WHEN yes THEN 'corroborated' WHEN no THEN 'disputed' ELSE 'single' END AS level FROM f)
"""
)


def _fields(spark, d):
    return evidence.field_levels(_records(spark, d), "g0", ["g1"], ["g2"])


@query("evidence_merge", RECORDS + "SELECT entity, field, source, locator, verdict, min(pos) AS pos FROM r WHERE ratio <= 0.5 GROUP BY 1, 2, 3, 4, 5")
def evidence_merge(spark, d):
    """Valid records, the first of each five-part key."""
    key = ["entity", "field", "source", "locator", "verdict"]
    good, _ = evidence.merge(_records(spark, d), key, ["pos"], F.col("ratio") <= 0.5)
    return good.select(*key, "pos")


@query("field_levels", FIELDS + "SELECT * FROM l")
def field_levels(spark, d):
    """What the evidence of a field amounts to."""
    return _fields(spark, d)


@query("entity_levels", FIELDS + "SELECT entity, CASE WHEN bool_or(level = 'disputed') THEN 'disputed' ELSE arg_min(level, field) END AS level FROM l WHERE field IN ('f0', 'f1') GROUP BY 1")
def entity_levels(spark, d):
    """What the key fields of an entity amount to."""
    return evidence.entity_levels(_fields(spark, d), ["f0", "f1"])


@query(
    "levels_by_source",
    FIELDS
    + """, v AS (SELECT entity, CASE WHEN bool_or(level = 'disputed') THEN 'disputed' ELSE arg_min(level, field) END AS level FROM l WHERE field IN ('f0', 'f1') GROUP BY 1)
SELECT c_mktsegment AS source, count(*) FILTER (WHERE level = 'single') AS single, count(*) FILTER (WHERE level = 'corroborated') AS corroborated, count(*) FILTER (WHERE level = 'disputed') AS disputed, count(*) FILTER (WHERE level IS NULL) AS unchecked
FROM customer LEFT JOIN v ON entity = c_custkey GROUP BY 1""",
)
def levels_by_source(spark, d):
    """Levels as columns, by source."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("source"))
    return evidence.levels_by_source(evidence.entity_levels(_fields(spark, d), ["f0", "f1"]), c)


@query(
    "verdict_tally",
    RECORDS
    + """SELECT source, count(*) AS records, count(*) FILTER (WHERE verdict = 'agree') AS agree, count(*) FILTER (WHERE verdict = 'variant') AS variant, count(*) FILTER (WHERE verdict = 'mismatch') AS mismatch, count(*) FILTER (WHERE verdict = 'missing') AS missing,
round(count(*) FILTER (WHERE verdict = 'agree') / count(*), 4) AS agree_rate, round(count(*) FILTER (WHERE verdict = 'variant') / count(*), 4) AS variant_rate, round(count(*) FILTER (WHERE verdict = 'mismatch') / count(*), 4) AS mismatch_rate, round(count(*) FILTER (WHERE verdict = 'missing') / count(*), 4) AS missing_rate,
round(avg(ratio) FILTER (WHERE verdict <> 'missing'), 4) AS mean_ratio FROM r GROUP BY 1""",
)
def verdict_tally(spark, d):
    """Counts, rates and mean ratio of verdicts."""
    return evidence.tally(_records(spark, d), ["source"])


@query("verdict_pivot", RECORDS + "SELECT field, source, count(*) FILTER (WHERE verdict = 'agree') AS agree, count(*) FILTER (WHERE verdict = 'variant') AS variant, count(*) FILTER (WHERE verdict = 'mismatch') AS mismatch, count(*) FILTER (WHERE verdict = 'missing') AS missing FROM r GROUP BY 1, 2")
def verdict_pivot(spark, d):
    """Verdicts by two keys."""
    return _records(spark, d).groupBy("field", "source").pivot("verdict", evidence.VERDICTS).agg(F.count(F.lit(1))).fillna(0)


@query("ranked_pairs", RECORDS + "SELECT CAST(locator % 10 AS VARCHAR) AS local, field AS witness, count(*) AS n, count(DISTINCT source) AS sources, min(pos) AS example FROM r WHERE verdict = 'variant' GROUP BY 1, 2 ORDER BY n DESC, local, witness LIMIT 20")
def ranked_pairs(spark, d):
    """The most frequent replacements (a top-k report), merged from partial counts by source."""
    part = _records(spark, d).where("verdict = 'variant'").groupBy((F.col("locator") % 10).cast("string").alias("local"), F.col("field").alias("witness"), "source").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("example"))
    return evidence.ranked_pairs(part, ["source"], 20)


@query("hotspots", RECORDS + "SELECT entity, field, count(*) AS n, count(*) FILTER (WHERE verdict IN ('mismatch', 'missing')) AS anomalies, min(pos) AS first FROM r GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) FILTER (WHERE verdict IN ('mismatch', 'missing')) >= 0.8 * count(*) ORDER BY anomalies DESC, first LIMIT 5")
def hotspots(spark, d):
    """Where nearly all is an anomaly (a top-k report)."""
    return evidence.hotspots(_records(spark, d), ["entity", "field"])


@query("licence_gate", RECORDS + "SELECT pos, CASE WHEN grp NOT IN ('g1', 'g3') THEN locator END AS quote FROM r")
def licence_gate(spark, d):
    """Quotations of closed groups are masked."""
    return _records(spark, d).select("pos", rules.gated(F.col("locator"), F.col("grp"), ["g1", "g3"], False).alias("quote"))


@query("verified_only", RECORDS + "SELECT entity, count(*) AS kept FROM r WHERE verdict = 'agree' GROUP BY 1")
def verified_only(spark, d):
    """Nested records filtered by what is verified; entities left with none drop out. Held long, not nested."""
    return _records(spark, d).where("verdict = 'agree'").groupBy("entity").agg(F.count(F.lit(1)).alias("kept"))


@query("orphan_evidence", RECORDS + "SELECT pos FROM r WHERE entity NOT IN (SELECT s_suppkey FROM supplier) AND entity NOT IN (SELECT n_nationkey FROM nation)")
def orphan_evidence(spark, d):
    """Evidence about nothing that exists."""
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity")).union(table(spark, d, "nation").select(F.col("n_nationkey").cast("long")))
    return _records(spark, d).join(ids, "entity", "left_anti").select("pos")


@query("strategy_counters", RECORDS + "SELECT count(*) AS n, count(*) FILTER (WHERE ratio >= 0.5) AS strong, count(*) FILTER (WHERE ratio < 0.1) AS weak, count(DISTINCT entity) AS entities, CASE WHEN count(*) FILTER (WHERE verdict = 'missing') > 0.3 * count(*) THEN 'missing' ELSE 'fine' END AS hint FROM r")
def strategy_counters(spark, d):
    """Several conditional sums at once, and a hint by thresholds."""
    n = F.count(F.lit(1))
    lost = F.count(F.when(F.col("verdict") == "missing", 1))
    return _records(spark, d).agg(n.alias("n"), F.count(F.when(F.col("ratio") >= 0.5, 1)).alias("strong"), F.count(F.when(F.col("ratio") < 0.1, 1)).alias("weak"), F.countDistinct("entity").alias("entities"), F.when(lost > 0.3 * n, "missing").otherwise("fine").alias("hint"))


@query("previous_row", "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN 'own' ELSE 'inherited' END AS origin FROM conversations")
def previous_row(spark, d):
    """The row before in the same chapter, and what is inherited from it."""
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", before.alias("previous"), F.when(before.isNull(), "own").otherwise("inherited").alias("origin"))


@query("sessions", "SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations")
def sessions(spark, d):
    """Sections opened by marker rows."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("section"))


@query("next_boundary", "SELECT user_id, ts, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts) AS length FROM events WHERE event_type = 'signup'")
def next_boundary(spark, d):
    """Where a section ends: at the next start."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    starts = table(spark, d, "events").where("event_type = 'signup'").withColumn("_next", F.lead("ts").over(w))
    return starts.select("user_id", "ts", F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("_next")).alias("length"))


@query("back_fill", "SELECT user_id, event_id, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS dose FROM events")
def back_fill(spark, d):
    """A value shared by the rows before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, Window.unboundedFollowing)
    return table(spark, d, "events").select("user_id", "event_id", F.first(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("dose"))


@query("main_and_alternates", "SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1 THEN 'main' ELSE 'alternate' END AS rank, first_value(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS parent FROM conversations")
def main_and_alternates(spark, d):
    """The first of a group and its alternates, with running numbers."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.row_number().over(w) == 1, "main").otherwise("alternate").alias("rank"), F.first("turn").over(w).alias("parent"))


@query("chapter_cap", "SELECT doc_id, n > 5 AS truncated, least(n, 5) AS kept FROM (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)")
def chapter_cap(spark, d):
    """The first five paragraphs of a chapter are kept and others are said to be cut (the feature is the cap)."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    return table(spark, d, "documents").select("doc_id", (n > 5).alias("truncated"), F.least(n, F.lit(5)).alias("kept"))


@query("even_sample", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) WHERE i IN (SELECT (k * n) // 10 FROM range(10) t(k))")
def even_sample(spark, d):
    """Ten rows at even distances in the order of ids (a sampling operator). Places come from counts of id ranges, not from one sort."""
    c = table(spark, d, "customer").select("c_custkey")
    block = F.floor(F.col("c_custkey") / 1000)
    counts = c.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("first"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    placed = c.withColumn("block", block).withColumn("own", F.row_number().over(Window.partitionBy("block").orderBy("c_custkey")) - 1).join(F.broadcast(first), "block")
    i = F.col("first") + F.col("own")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.floor(k * F.col("total") / 10))
    return placed.where(F.array_contains(wanted, i.cast("long"))).select("c_custkey")


@query("ranked_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 9 END, o_totalprice DESC, o_orderkey LIMIT 40")
def ranked_sort(spark, d):
    """Source rank before relevance, and forty of them (a top-k report)."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(9)
    return table(spark, d, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey", "o_totalprice")


@query("review_queue", RECORDS + "SELECT pos, CASE verdict WHEN 'mismatch' THEN 0 WHEN 'missing' THEN 1 ELSE 2 END AS priority FROM r WHERE verdict <> 'agree' ORDER BY priority, ratio, pos LIMIT 200")
def review_queue(spark, d):
    """What needs review, most urgent first; two hundred of it (a report's cap)."""
    p = F.when(F.col("verdict") == "mismatch", 0).when(F.col("verdict") == "missing", 1).otherwise(2)
    return _records(spark, d).where("verdict <> 'agree'").withColumn("priority", p).orderBy("priority", F.coalesce("ratio", F.lit(-1.0)), "pos").limit(200).select("pos", "priority")


@query("natural_order", "SELECT s_name AS name, regexp_extract(s_name, '^(.*?)([0-9]+)$', 1) AS prefix, CAST(regexp_extract(s_name, '^(.*?)([0-9]+)$', 2) AS BIGINT) AS number FROM supplier ORDER BY prefix, number LIMIT 50")
def natural_order(spark, d):
    """Ids in natural order: by prefix and then by number (a top-k report)."""
    part = lambda g: F.regexp_extract("s_name", r"^(.*?)([0-9]+)$", g)
    return table(spark, d, "supplier").select(F.col("s_name").alias("name"), part(1).alias("prefix"), part(2).cast("long").alias("number")).orderBy("prefix", "number").limit(50)


@query("seeded_shuffle")
def seeded_shuffle(spark, d):
    """Twenty customers in an order drawn from a seed (a sampling operator)."""
    return table(spark, d, "customer").orderBy(F.xxhash64("c_custkey", F.lit(42)), "c_custkey").limit(20).select("c_custkey")


@query("union_sources", "SELECT 'customer' AS source, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part")
def union_sources(spark, d):
    """Outputs of several sources as one."""
    parts = [("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")]
    a, b, c = (table(spark, d, t).select(F.lit(t).alias("source"), F.col(i).alias("id"), F.col(n).alias("name")) for t, i, n in parts)
    return a.unionByName(b).unionByName(c)


@query("first_wins_union", "SELECT id, arg_min(source, rank) AS source FROM (SELECT s_suppkey AS id, 'supplier' AS source, 0 AS rank FROM supplier UNION ALL SELECT c_custkey, 'customer', 1 FROM customer) GROUP BY 1")
def first_wins_union(spark, d):
    """A union in which the first of equal ids stays."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("source"), F.lit(0).alias("rank"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("source"), F.lit(1).alias("rank"))
    return joins.first_wins(s.union(c), ["id"], ["rank"]).select("id", "source")


@query("id_conflicts", "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer)")
def id_conflicts(spark, d):
    """Ids that both sides of a union claim."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")).join(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id", "left_semi")


@query("unaligned_rest", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def unaligned_rest(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("duplicates", "SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, d):
    """Groups of more than one."""
    return table(spark, d, "part").groupBy("p_name", "p_brand").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("sequence_gaps", "SELECT i AS missing FROM range(0, (SELECT max(o_custkey) + 1 FROM orders)) t(i) WHERE i NOT IN (SELECT o_custkey FROM orders)")
def sequence_gaps(spark, d):
    """Numbers of a sequence that are missing."""
    used = table(spark, d, "orders").select(F.col("o_custkey").alias("missing")).distinct()
    top = used.agg(F.max("missing")).first()[0]
    return spark.range((top + 1) if top is not None else 0).select(F.col("id").alias("missing")).join(used, "missing", "left_anti")


@query("work_queue", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS batch FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))")
def work_queue(spark, d):
    """What isn't cached yet, in batches of fifty: rows are numbered within ranges of ids, whose counts give the offsets."""
    todo = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    block = F.floor(F.col("doc_id") / 100_000)
    counts = todo.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("first"))
    own = F.row_number().over(Window.partitionBy("block").orderBy("doc_id")) - 1
    placed = todo.withColumn("block", block).withColumn("own", own).join(first, "block")
    return placed.select("doc_id", F.floor((F.col("first") + F.col("own")) / 50).cast("long").alias("batch"))


@query("cache_validity", "SELECT d.doc_id, l.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) l ON l.doc_id = d.doc_id AND l.n_chars = d.n_chars")
def cache_validity(spark, d):
    """Cached rows count only if id and content agree."""
    docs = table(spark, d, "documents").select("doc_id", text.content_key(F.col("text")).alias("key"))
    cached = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("hit", F.lit(True))
    return docs.join(cached, ["doc_id", "key"], "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("annotation_check", "SELECT quality, toxic, count(*) AS n, count(*) FILTER (WHERE d.doc_id IS NULL) AS orphan, CASE WHEN count(*) FILTER (WHERE quality NOT IN (0, 1)) > 0.2 * count(*) THEN 'warn' ELSE 'ok' END AS state FROM labels LEFT JOIN documents d USING (doc_id) GROUP BY 1, 2")
def annotation_check(spark, d):
    """Annotations held against their sources, with a warning by reject rate."""
    docs = table(spark, d, "documents").select("doc_id", F.lit(1).alias("there"))
    n = F.count(F.lit(1))
    bad = F.count(F.when(~F.col("quality").isin(0, 1), 1))
    return table(spark, d, "labels").join(docs, "doc_id", "left").groupBy("quality", "toxic").agg(n.alias("n"), F.count(F.when(F.col("there").isNull(), 1)).alias("orphan"), F.when(bad > 0.2 * n, "warn").otherwise("ok").alias("state"))


@query("dispute_counts", "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS user, count(*) FILTER (WHERE role = 'assistant') AS assistant, count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS none FROM conversations GROUP BY 1")
def dispute_counts(spark, d):
    """Kinds counted by source, with a bucket for none."""
    kind = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("none")
    return table(spark, d, "conversations").withColumn("kind", kind).groupBy("conv_id").pivot("kind", ["user", "assistant", "none"]).agg(F.count(F.lit(1))).fillna(0)


@query("registry_violations", "SELECT n_nationkey AS id, CASE WHEN n_regionkey NOT IN (SELECT r_regionkey FROM region) THEN 'region' WHEN n_name IS NULL THEN 'name' END AS violation FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region) OR n_name IS NULL UNION ALL SELECT NULL, 'none' WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name IS NULL)")
def registry_violations(spark, d):
    """All violations of a registry's rules, or one row that says there are none."""
    n, r = table(spark, d, "nation"), table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"))
    lost = n.join(r, "n_regionkey", "left_anti").select(F.col("n_nationkey").alias("id"), F.lit("region").alias("violation"))
    unnamed = n.where("n_name IS NULL").select(F.col("n_nationkey").alias("id"), F.lit("name").alias("violation"))
    none = unnamed.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(None).cast("int").alias("id"), F.lit("none").alias("violation"))
    return lost.union(unnamed).union(none)
