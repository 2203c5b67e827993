"""Readers of texts and tables with checks. Bad input becomes rows that say so, unless a check is meant to stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a wrongly decoded text shows.
MOJIBAKE = ["锟斤拷", "ï»¿", "Ã©", "â€"]
REPLACEMENT, LEAST_REPLACEMENTS, REPLACEMENT_SHARE = "�", 3, 0.01


def clean_text(text: Column) -> Column:
    """Without byte order mark, with line feeds only."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def problem(text: Column) -> Column:
    """What is wrong with a text's decoding, or null."""
    marks = F.lit(False)
    for m in MOJIBAKE:
        marks = marks | F.contains(text, F.lit(m))
    lost = F.char_length(text) - F.char_length(F.replace(text, F.lit(REPLACEMENT), F.lit("")))
    return F.when(marks, "mojibake").when((lost >= LEAST_REPLACEMENTS) & (lost >= REPLACEMENT_SHARE * F.char_length(text)), "replacement characters")


def texts(spark: SparkSession, path: str, glob: str = "*", strict: bool = True) -> DataFrame:
    """path, text of the files under a folder, sorted by nothing. With ``strict`` a wrongly decoded file is an error, else ``problem`` names it."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    out = raw.select(F.col("_metadata.file_path").alias("path"), clean_text(F.col("value")).alias("text"))
    bad = problem(F.col("text"))
    if strict:
        stop = F.raise_error(F.concat(F.col("path"), F.lit(": "), bad)).cast("string")
        return out.withColumn("text", F.when(bad.isNotNull(), stop).otherwise(F.col("text")))
    return out.withColumn("problem", bad)


def csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A quoted CSV with a header; missing columns and broken quotes are errors, blank rows go."""
    out = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    lost = [c for c in required if c not in out.columns]
    if lost:
        raise ValueError(f"no columns {lost} in {path}")
    return out.where(F.coalesce(*[F.when(F.trim(c) != "", F.lit(1)) for c in out.columns]).isNotNull())


def registry(spark: SparkSession, path: str, schema: str, key: str, order: str, members: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON array in order, and all violations (key, rule): repeated or missing keys and values that aren't members."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    repeated = rows.groupBy(key).count().where("count > 1").select(F.col(key).alias("key"), F.lit("repeated").alias("rule"))
    bad = rows.where(F.col(key).isNull()).select(F.col(key).alias("key"), F.lit("no key").alias("rule"))
    for column, allowed in members.items():
        bad = bad.union(rows.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False))).select(F.col(key), F.lit(column)))
    return rows.orderBy(order), repeated.union(bad)


def json_cache(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the JSON files that can be read, and the paths of the broken ones; missing paths are left out."""
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    there = [p for p in paths if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    if not there:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "path string")
    raw = spark.read.text(there, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").isNull().alias("broken"), "value")
    rows = raw.where("NOT broken").select(F.explode(F.from_json("value", f"array<struct<{_as_fields(schema)}>>")).alias("r")).select("r.*")
    return rows, raw.where("broken").select("path")


def _as_fields(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.split(" ", 1) for x in schema.split(", ")))


def with_offsets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line, start (of the line in the text, from 0)."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("start", F.coalesce(F.sum(F.char_length("line") + 1).over(before), F.lit(0)).cast("long"))


def tagged(docs: DataFrame, key: str, text: str, tag: str = r"^<([^<>/]+)>$", title: str = r"^【(.+)】$") -> DataFrame:
    """key, section, tag, title, start, body: a tag line or a title line opens a section."""
    lines = with_offsets(docs, key, text)
    own_tag, own_title = F.regexp_extract("line", tag, 1), F.regexp_extract("line", title, 1)
    opens = (own_tag != "") | (own_title != "")
    running = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("section", F.sum(opens.cast("int")).over(running)).withColumn("tag", F.last(F.when(own_tag != "", own_tag), True).over(running))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~opens, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return placed.groupBy(key, "section").agg(F.first("tag", True).alias("tag"), F.max(F.when(own_title != "", own_title)).alias("title"), F.min("start").alias("start"), body.alias("body"))


def header_fields(text: Column) -> Column:
    """Map of the ``#+KEY: value`` lines a text begins with; the first value of a key stays."""
    head = F.regexp_extract(text, r"^((?:#[^\n]*(?:\n|$))*)", 1)
    keys = F.regexp_extract_all(head, F.lit(r"(?m)^#\+([A-Za-z_]+):[ \t]*(.*?)[ \t]*$"), F.lit(1))
    values = F.regexp_extract_all(head, F.lit(r"(?m)^#\+([A-Za-z_]+):[ \t]*(.*?)[ \t]*$"), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.map_from_entries(first)


def pages(docs: DataFrame, key: str, text: str, mark: str = r"<pb:([^>]+)>") -> DataFrame:
    """key, page, start, body of a page-marked text: without header, paragraph signs and line breaks; start counts in the bodies' concatenation."""
    body = F.regexp_replace(text, r"^(?:#[^\n]*(?:\n|$))*", "")
    parts = docs.select(key, F.posexplode(F.split(F.regexp_replace(body, mark, "\x01$1\x02"), "\x01")).alias("pos", "part"))
    has = F.instr("part", "\x02") > 0
    clean = F.regexp_replace(F.when(has, F.substring_index("part", "\x02", -1)).otherwise(F.col("part")), "[¶\n]", "")
    rows = parts.select(key, "pos", F.when(has, F.substring_index("part", "\x02", 1)).alias("page"), clean.alias("body"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.char_length("body")).over(before), F.lit(0)).cast("long")).where("page IS NOT NULL OR body <> ''").drop("pos")


def front_matter(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, reason (why there are no fields, or null), fields (map), body of Markdown files. Nested values stay text."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---(?:\n|$)", 1)
    starts = F.col(text).startswith("---\n")
    reason = F.when(~starts, "no front matter").when(block == "", "not closed or empty").when(~block.rlike(r"(?m)^[A-Za-z_][\w-]*:"), "no fields")
    keys, values = (F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.*?)[ \t]*$"), F.lit(g)) for g in (1, 2))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    body = F.regexp_replace(text, r"(?s)^---\n.*?\n---(?:\n|$)", "")
    strip = F.transform_values(F.map_from_entries(last), lambda _, v: F.regexp_replace(v, "^[\"'](.*)[\"']$", "$1"))
    return docs.select(key, reason.alias("reason"), F.when(reason.isNull(), strip).alias("fields"), F.when(reason.isNull(), body).otherwise(F.col(text)).alias("body"))


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, title, body cut at ``## `` lines outside fenced code."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    running = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fenced = lines.withColumn("fences", F.sum(F.col("line").rlike("^```").cast("int")).over(running))
    head = (F.col("fences") % 2 == 0) & F.col("line").startswith("## ")
    placed = fenced.withColumn("head", head).withColumn("section", F.sum(F.col("head").cast("int")).over(running))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return placed.groupBy(key, "section").agg(F.max(F.when(F.col("head"), F.substring("line", 4, 1000))).alias("title"), body.alias("body"))


def digests(files: DataFrame, content: str) -> DataFrame:
    """files with sha256, the blob hash of version control, and bytes."""
    body = F.col(content)
    blob = F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(body).cast("string")), "UTF-8"), F.unhex(F.lit("00")), body))
    return files.select("*", F.sha2(body, 256).alias("sha256"), blob.alias("blob"), F.octet_length(body).alias("bytes"))


def lock_violations(lock: DataFrame) -> DataFrame:
    """path, rule of a lock (id, path, sha256): unsafe paths, malformed hashes, repeated ids and paths, folders within folders."""
    one = lambda cond, rule: lock.where(cond).select("path", F.lit(rule).alias("rule"))
    out = one(F.col("path").rlike(r"^/|(^|/)\.\.(/|$)|\\"), "unsafe path").union(one(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "malformed hash"))
    for c in ("id", "path"):
        many = lock.groupBy(c).count().where("count > 1").select(c)
        out = out.union(lock.join(many, c, "left_semi").select("path", F.lit(f"repeated {c}")))
    parents = lock.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))).alias("parent")).where("path <> parent")
    return out.union(parents.join(lock.select(F.col("path").alias("parent")), "parent", "left_semi").select("path", F.lit("within another")).distinct())
