"""Cross-checks of two editions: links, item sets, quotations, roles."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import verdict
from scriptorium.operators.collate import Haystack, length_of, normalise
from scriptorium.operators.joins import small
from scriptorium.operators.lineage import cut
from scriptorium.shipping import ship

# How strongly a passage names a bundle, from strong to weak.
STRENGTHS = ["prescribed", "heading", "mentioned", "alias", "negated", "absent"]
LEAST_PIECE, CLOSE_PIECE, LONGEST_PIECE = 16, 8, 600
#: Quotations that are looked for together in a witness.
QUOTE_BLOCK = 256


def sentence_pieces(text: str) -> list[str]:
    """Pieces for separate alignment: a short text is one; else a piece closes at a sentence end
    once it has enough signs, at the latest at a length, and a short tail joins the piece before."""
    if length_of(normalise(text)[0]) < LEAST_PIECE:
        return [text] if text else []
    out, at = [], ""
    for part in re.findall(r"[^。！？；.!?;]*[。！？；.!?;]+|[^。！？；.!?;]+$", text):
        at += part
        while len(at) > LONGEST_PIECE:
            out.append(at[:LONGEST_PIECE])
            at = at[LONGEST_PIECE:]
        if length_of(normalise(at)[0]) >= CLOSE_PIECE:
            out.append(at)
            at = ""
    if at:
        if out:
            out[-1] += at
        else:
            out.append(at)
    return out


def chunk(text: str, least: int = 24, split: int = 40, most: int = 900) -> list[str]:
    """A text in chunks of paragraphs: a chunk closes once it reaches ``split`` signs, none passes ``most``, those under ``least`` go."""
    out, at = [], ""
    for p in re.split(r"\n+", text):
        for k in range(0, max(len(p), 1), most):
            part = p[k : k + most]
            if at and len(at) + 1 + len(part) > most:
                out.append(at)
                at = ""
            at = f"{at}\n{part}" if at else part
            if len(at) >= split:
                out.append(at)
                at = ""
    return [c for c in [*out, at] if len(c.strip()) >= least]


def replace_pairs(segments: DataFrame) -> DataFrame:
    """local, witness, n from rows (source, segments: array of (op, a, b)): the character pairs of replacements of equal length up to two."""
    one = segments.select("source", F.explode("segments").alias("s")).where("s.op = 'replace' AND char_length(s.a) = char_length(s.b) AND char_length(s.a) BETWEEN 1 AND 2")
    signs = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    pairs = one.select("source", F.explode(F.arrays_zip(signs(F.col("s.a")).alias("local"), signs(F.col("s.b")).alias("witness"))).alias("p")).select("source", "p.local", "p.witness").where("local <> witness")
    return pairs.groupBy("local", "witness").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


def compare_items(a: Column, b: Column, auxiliaries: list[str]) -> Column:
    """verdict, jaccard, only_a, only_b of two item sets: what auxiliaries and near names explain is a variant.

    Names are near if one holds the other (two signs at least) or they are of one length and differ in one sign."""
    left, right, both = F.array_except(a, b), F.array_except(b, a), F.array_intersect(a, b)
    aux = F.array(*[F.lit(x) for x in auxiliaries]) if auxiliaries else F.array().cast("array<string>")

    def near(x: Column, y: Column) -> Column:
        shorter = F.least(F.char_length(x), F.char_length(y))
        return ((shorter >= 2) & (F.contains(x, y) | F.contains(y, x))) | ((F.char_length(x) == F.char_length(y)) & (F.levenshtein(x, y) == 1))

    def unexplained(xs: Column, ys: Column) -> Column:
        return F.filter(xs, lambda x: ~F.array_contains(aux, x) & ~F.exists(ys, lambda y: near(x, y)))

    rest = F.size(unexplained(left, right)) + F.size(unexplained(right, left))
    level = F.when((F.size(left) == 0) & (F.size(right) == 0), "agree").when(rest == 0, "variant").otherwise("mismatch")
    union = F.size(F.array_union(a, b))
    jaccard = F.when(union == 0, 1.0).otherwise(F.size(both) / union)
    return F.struct(level.alias("verdict"), F.round(jaccard, 4).alias("jaccard"), left.alias("only_a"), right.alias("only_b"))


def judge_links(local: DataFrame, other: DataFrame, strengths: DataFrame) -> DataFrame:
    """passage, bundle, verdict, conclusion of links (passage, bundle) of two editions; strengths say how a passage names the bundle."""
    a, b = local.select("passage", "bundle", F.lit(True).alias("_a")).distinct(), other.select("passage", "bundle", F.lit(True).alias("_b")).distinct()
    rows = a.join(b, ["passage", "bundle"], "full_outer").join(strengths, ["passage", "bundle"], "left")
    s = F.coalesce("strength", F.lit("absent"))
    strong = s.isin(STRENGTHS[:3])
    agree = F.col("_a") & F.col("_b")
    conclusion = F.when(agree, F.when(strong, "fine").otherwise("review")).when(F.col("_b") & strong, "missing here").when(F.col("_b"), "extra there").when(strong, "missing there").otherwise("review")
    return rows.select("passage", "bundle", F.when(agree, "agree").otherwise("mismatch").alias("verdict"), conclusion.alias("conclusion"))


def mention_strength(text: Column, name: Column, verbs: list[str], negations: list[str]) -> Column:
    """How strongly a text names a bundle."""
    at = F.instr(text, name)
    before = F.substring(text, F.greatest(at - 4, F.lit(1)), F.least(at - 1, F.lit(4)))
    return F.when(at == 0, "absent").when(F.length(before) == 0, F.when(text == name, "heading").otherwise("mentioned")).when(before.rlike("|".join(negations)), "negated").when(before.rlike(f"(?:{'|'.join(verbs)})$"), "prescribed").otherwise("mentioned")


def verify_quotes(quotes: DataFrame, witnesses: DataFrame) -> DataFrame:
    """id, ratio, witness, verdict of quotations (id, own, segments) in witnesses (witness, text).

    All segments must be found, and the worst counts. The quotation's own witness is
    taken if it agrees, else the best. Quotations are a stated query set: they are
    gathered in blocks of ``QUOTE_BLOCK``, and each witness's text goes once to each block,
    where it is indexed once."""
    ship(quotes.sparkSession)
    rows = quotes.select("id", "own", F.coalesce("segments", F.array().cast(dict(quotes.dtypes)["segments"])).alias("segments"))
    count = rows.count()
    blocks = -(-count // QUOTE_BLOCK) or 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    texts = witnesses.select("witness", "text").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = texts.join(small(dealt.groupBy("block").agg(F.collect_list(F.struct("id", "own", "segments")).alias("asked"))), "block")

    def run(batches):
        for b in batches:
            for asked, witness, text in zip(b["asked"], b["witness"], b["text"], strict=True):
                hay, rows = Haystack(text or ""), []
                for q in asked:
                    hits = [hay.locate(normalise(s)[0]) for s in q["segments"]] or [None]
                    rows.append((q["id"], q["own"] == witness, witness, min((h[0] if h else 0.0) for h in hits)))
                yield pd.DataFrame(rows, columns=["id", "mine", "witness", "ratio"])

    kinds = dict(quotes.dtypes)
    found = pairs.select("asked", "witness", "text").mapInPandas(run, f"id {kinds['id']}, mine boolean, witness string, ratio double")
    order = F.struct((F.col("mine") & (F.col("ratio") >= 0.95)).alias("own"), F.col("ratio").alias("ratio"), F.col("mine").alias("mine"), F.col("witness").alias("witness"))
    best = found.groupBy("id").agg(F.max(order).alias("b")).select("id", F.round("b.ratio", 4).alias("ratio"), "b.witness")
    return best.withColumn("verdict", verdict(F.col("ratio"), floor=True))


def roles(texts: DataFrame, items: DataFrame, patterns: list[str]) -> DataFrame:
    """bundle, item, role, sentence from commentaries (bundle, text): per sentence the first pattern that hits.

    A pattern has two groups, item and role; the item must be one of the bundle's (bundle, name), by itself or by its first two signs."""
    sentences = texts.select("bundle", F.explode(F.split("text", "[。；;]")).alias("sentence")).where("trim(sentence) <> ''")
    hits = [F.when(F.regexp_extract("sentence", p, 1) != "", F.struct(F.regexp_extract("sentence", p, 1).alias("item"), F.regexp_extract("sentence", p, 2).alias("role"))) for p in patterns]
    found = sentences.withColumn("h", F.coalesce(*hits)).where("h IS NOT NULL").select("bundle", "sentence", F.col("h.item").alias("raw"), F.col("h.role").alias("role"))
    own = items.select("bundle", F.col("name").alias("item"))
    same = found.join(own, "bundle").where((F.col("raw") == F.col("item")) | (F.substring("raw", 1, 2) == F.col("item")) | (F.substring("item", 1, 2) == F.col("raw")))
    return same.select("bundle", "item", "role", "sentence").distinct()


def what_if(one: DataFrame, bag: int, remove: list, add: list, limit: int = 5) -> DataFrame:
    """The bags most like one with items taken away and added (a top-k report); one has (bag, item)."""
    mine = one.where(F.col("bag") == bag).where(~F.col("item").isin(remove) if remove else F.lit(True)).select("item")
    if add:
        mine = mine.union(one.sparkSession.createDataFrame([(a,) for a in add], f"item {dict(one.dtypes)['item']}"))
    mine = mine.distinct()
    n = mine.count()
    others = one.where(F.col("bag") != bag)
    shared = others.join(F.broadcast(mine), "item", "left_semi").groupBy("bag").agg(F.count(F.lit(1)).alias("shared"))
    sizes = others.join(shared, "bag", "left_semi").groupBy("bag").agg(F.count(F.lit(1)).alias("n"))
    j = F.col("shared") / (F.col("n") + n - F.col("shared"))
    return shared.join(sizes, "bag").select("bag", "shared", F.round(j, 6).alias("jaccard")).orderBy(F.desc("jaccard"), "bag").limit(limit)


def tree_paths(options: DataFrame, roots: DataFrame, depth: int = 20) -> DataFrame:
    """tree, path (labels), result of all walks from the roots to results; options (tree, id, label, next, result)."""
    walk = roots.select("tree", "id", F.array().cast("array<string>").alias("path"))
    done = None
    for _ in range(depth):
        step = walk.join(options, ["tree", "id"]).select("tree", F.concat("path", F.array("label")).alias("path"), "next", "result")
        ends = step.where("result IS NOT NULL").select("tree", "path", "result")
        done = ends if done is None else done.union(ends)
        walk = cut(step.where("next IS NOT NULL").select("tree", F.col("next").alias("id"), "path"))
        if walk.isEmpty():
            break
    return done


def quiz(facts: DataFrame, seed: int, n: int, choices: int = 4) -> DataFrame:
    """question, answer, options of n seeded questions from facts (question, answer); wrong options are answers to other questions (a sampling operator)."""
    order = F.xxhash64(F.lit(seed), "question", "answer")
    asked = facts.orderBy(order, "question", "answer").limit(n)
    pool = [r["answer"] for r in facts.select("answer").distinct().orderBy(F.xxhash64(F.lit(seed + 1), "answer"), "answer").limit(50).collect()]
    others = F.slice(F.filter(F.array(*[F.lit(p) for p in pool]), lambda x: x != F.col("answer")), 1, choices - 1)
    options = F.transform(F.array_sort(F.transform(F.concat(F.array("answer"), others), lambda x: F.struct(F.xxhash64(F.lit(seed), F.col("question"), x).alias("k"), x.alias("x")))), lambda s: s["x"])
    return asked.select("question", "answer", options.alias("options"))


def stitched_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """root, text: pages (title, text) joined in the order of their root's links (root, pos, title), each after a comment with its title."""
    own = links.join(pages, "title").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "text"))).alias("parts"))
    return own.select("root", F.array_join(F.transform("parts", lambda p: F.concat(F.lit("<!-- "), p["title"], F.lit(" -->\n"), p["text"])), "\n\n").alias("text"))


def cards(rows: DataFrame, kinds: dict[str, dict[str, str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables of cards (path, reason, fields map) by kind, and the skipped with why.

    kinds name, for each value of the field ``type``, the columns and the fields they come from; a card that lacks one is skipped, none stops the import."""
    kind = F.col("fields")["type"]
    why = F.coalesce(F.col("reason"), F.when(kind.isNull(), "no type").when(~kind.isin(list(kinds)), "unknown type"))
    lacks = F.lit(None).cast("string")
    for name, columns in kinds.items():
        for field in columns.values():
            lacks = F.when((kind == name) & F.col("fields")[field].isNull(), f"no {field}").otherwise(lacks)
    marked = rows.withColumn("why", F.coalesce(why, lacks))
    tables = {name: marked.where(F.col("why").isNull() & (kind == name)).select("path", *[F.col("fields")[f].alias(c) for c, f in columns.items()]) for name, columns in kinds.items()}
    return tables, marked.where("why IS NOT NULL").select("path", "why")
