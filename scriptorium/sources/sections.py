"""Texts into lines, sections and paragraphs, and markup off them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str, text: str, by: str = "\n") -> DataFrame:
    """key, pos (from 1), line."""
    return docs.select(key, F.posexplode(F.split(text, by)).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


def line_sections(docs: DataFrame, key: str, text: str, head: Callable[[Column], Column]) -> DataFrame:
    """key, section (0 before the first heading), heading, lines, chars."""
    marked = lines(docs, key, text).withColumn("head", head(F.col("line")))
    running = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("section", F.sum(F.col("head").cast("long")).over(running))
    body = F.when(~F.col("head"), F.char_length("line"))
    return placed.groupBy(key, "section").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("heading"), F.count(body).alias("lines"), F.coalesce(F.sum(body), F.lit(0)).cast("long").alias("chars"))


def section_bodies(docs: DataFrame, key: str, text: str, heading: str, least: int = 20) -> DataFrame:
    """key, section, title, body of texts cut at headings (a pattern with the title as its group); short bodies go.

    A text without headings is one section."""
    marked = F.regexp_replace(text, f"(?m)^{heading}$", "\x01$1\x02")
    parts = docs.select(key, F.posexplode(F.split(marked, "\x01")).alias("section", "part"))
    has = F.instr("part", "\x02") > 0
    title = F.when(has, F.trim(F.substring_index("part", "\x02", 1)))
    body = F.trim(F.when(has, F.substring_index("part", "\x02", -1)).otherwise(F.col("part")))
    return parts.select(key, "section", title.alias("title"), body.alias("body")).where(F.char_length("body") >= least)


def paragraphs(docs: DataFrame, key: str, text: str, by: str = "\n{2,}", least: int = 24, least_titled: int = 10) -> DataFrame:
    """key, pos, body; short ones go unless they begin with a bracketed title. Numbers are given before the sieve."""
    n = F.char_length("body")
    return lines(docs, key, text, by).withColumnRenamed("line", "body").where((n >= least) | ((n >= least_titled) & F.col("body").rlike(r"^[\[【(]")))


def strip_tags(html: Column) -> Column:
    """Text of markup: scripts and styles off, tags to spaces, white space to one space."""
    out = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]*>", " "), r"\s+", " "))


def drop_templates(text: Column) -> Column:
    """A text without templates ({{...}} without single braces inside), however deep they stand in each other.

    The text is cut at its double braces. Working from left to right, a closing
    pair takes all back to the last open pair that it can close; what is never closed stays."""
    parts = F.split(F.regexp_replace(text, r"(\{\{(?!\{)|\}\})", "\u0001$1\u0001"), "\u0001")

    def step(held: Column, part: Column) -> Column:
        top = F.element_at(held, -1)
        closes = (part == "}}") & (F.size(held) > 1) & ~F.substring(top, 3, 1 << 30).rlike("[{}]")
        opened = F.concat(held, F.array(part))
        ended = F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))
        joined = lambda x, more: F.concat(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.array(F.concat(F.element_at(x, -1), more)))
        return F.when(part == "{{", opened).when(closes, ended).otherwise(joined(held, part))

    return F.aggregate(parts, F.array(F.lit("")), step, lambda held: F.array_join(held, ""))


def strip_wiki(text: Column) -> Column:
    """Wiki markup off a text: comments, references, templates of any depth, links to their labels, emphasis."""
    out = F.regexp_replace(text, r"(?s)<!--.*?-->|<ref[^>/]*/>|<ref[^>]*>.*?</ref>", "")
    out = drop_templates(out)
    out = F.regexp_replace(out, r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", "$1")
    out = F.regexp_replace(out, r"\[https?://\S+\s+([^\]]*)\]", "$1")
    return F.regexp_replace(F.regexp_replace(out, "'{2,}|</?[A-Za-z][^>]*>|__[A-Z]+__", ""), r"\n{3,}", "\n\n")


def wiki_links(text: Column) -> Column:
    """array of (target, label) of the links of a text."""
    raw = F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    return F.transform(raw, lambda x: F.struct(F.element_at(F.split(F.substring_index(x, "|", 1), "/"), -1).alias("target"), F.element_at(F.split(x, r"\|"), -1).alias("label")))
