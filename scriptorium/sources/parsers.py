"""Parsers of line-wise sources: numbered clauses with recipes between them, and recipe blocks.

Both are machines over kinds of lines (``operators.transducer``), then groupings. What a line is, is
told by the patterns of a ``Style``, so that sources of other tongues need other patterns and no other parser.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import transducer
from scriptorium.operators.scans import running
from scriptorium.sources.dispatch import parser


@dataclass(frozen=True)
class Style:
    """Patterns over a trimmed line: numbers before a clause, headings with a name (first group) and perhaps a note (second), items, directions and asides."""

    number: str = r"^(?:第?\d+条?[.、)]?|[一二三四五六七八九十百零〇]+、)\s*"
    heading: str = r"^([^。，；：.,;:!?]{1,24}?[方汤湯散丸饮飲])\s*(?:[（(]([^）)]*)[）)])?$"
    item: str = r"[（(][^）)]*[两兩钱錢枚升合斤分铢銖个個][^）)]*[）)]"
    directions: str = r"^(?:上|右)[^。]{0,8}味|以水|煮取"
    aside: str = r"^(?:本云|疑非)"
    lost: str = "佚"


CLAUSES = transducer.Machine(
    ("text", "recipe", "made"),
    "text",
    ("heading", "directions", "item", "aside", "blank", "plain"),
    {("*", "heading"): "recipe", ("recipe", "directions"): "made", ("*", "plain"): "text", ("text", "directions"): "text"},
)

BLOCKS = transducer.Machine(
    ("outside", "named", "items", "made", "lost"),
    "outside",
    ("lost", "heading", "item", "directions", "aside", "blank", "plain"),
    {
        ("*", "heading"): "named",
        ("*", "lost"): "lost",
        ("named", "item"): "items",
        ("items", "directions"): "made",
        ("named", "directions"): "made",
        ("named", "plain"): "outside",
        ("items", "plain"): "outside",
        ("items", "blank"): "outside",
        ("made", "plain"): "outside",
        ("made", "item"): "outside",
        ("lost", "blank"): "outside",
    },
)


def kinds(line: Column, style: Style, lost: bool = False) -> Column:
    """The kind of a line: the first of blank, lost heading, heading, aside, directions, item and plain that fits."""
    t = F.trim(line)
    head = t.rlike(style.heading)
    out = F.when(t == "", "blank")
    if lost:
        out = out.when(head & F.contains(F.regexp_extract(t, style.heading, 2), F.lit(style.lost)), "lost")
    return out.when(head, "heading").when(t.rlike(style.aside), "aside").when(t.rlike(style.directions), "directions").when(t.rlike(style.item), "item").otherwise("plain")


def lines_of(texts: DataFrame) -> DataFrame:
    """source, pos, line of texts (source, text); a null text has no lines."""
    return texts.select("source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def clauses(texts: DataFrame, style: Style = Style()) -> dict[str, DataFrame]:  # noqa: B008
    """Tables clauses (source, number, text) and attached (source, number, name, note, kind, text) of texts (source, text).

    A plain line is a clause, without the number it may begin with; blank lines and asides are none. What stands between a
    heading and the next clause is attached to that heading, and with it to the clause before it (number 0: none); directions
    that no heading precedes are clauses. ``kind`` says whether it comes before (recipe) or after (made) the directions began."""
    held = transducer.run(lines_of(texts), "source", kinds(F.col("line"), style), CLAUSES)
    trimmed = F.trim("line")
    is_clause = (F.col("state") == "text") & F.col("kind").isin("plain", "directions", "item")
    marked = held.withColumn("one", is_clause.cast("int")).withColumn("head", F.when(F.col("kind") == "heading", trimmed))
    placed = running(marked, ["source"], ["pos"], {"number": ("one", "sum", False, True), "name": ("head", "last", False, True)})
    texts_ = placed.where("one = 1").select("source", "number", F.trim(F.regexp_replace(trimmed, style.number, "")).alias("text"))
    inside = placed.where("state <> 'text' AND kind NOT IN ('heading', 'blank', 'aside')")
    part = lambda i: F.nullif(F.regexp_extract("name", style.heading, i), F.lit(""))
    attached = inside.select("source", "pos", "number", part(1).alias("name"), part(2).alias("note"), F.col("state").alias("kind"), trimmed.alias("text"))
    return {"clauses": texts_, "attached": attached}


def blocks(texts: DataFrame, style: Style = Style()) -> dict[str, DataFrame]:  # noqa: B008
    """Table blocks (source, block, name, note, lost, items, directions) of texts (source, text).

    A heading opens a block. Its items stop at a blank or plain line or at directions; directions go on to the next plain line or item. A
    heading whose note says so is a lost recipe, which has neither, whatever follows. Items and directions keep their order."""
    held = transducer.run(lines_of(texts), "source", kinds(F.col("line"), style, lost=True), BLOCKS)
    head = F.col("kind").isin("heading", "lost")
    placed = running(held.withColumn("one", head.cast("int")), ["source"], ["pos"], {"block": ("one", "sum", False, True)}).where("block > 0")
    trimmed = F.trim("line")
    row = F.struct("pos", trimmed.alias("line"))
    some = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, row))), lambda x: x["line"])
    item = (F.col("kind") == "item") & (F.col("state") == "items")
    made = (F.col("state") == "made") & ~F.col("kind").isin("blank", "aside")
    title = F.max(F.when(head, trimmed))
    part = lambda i: F.nullif(F.regexp_extract("title", style.heading, i), F.lit(""))
    out = placed.groupBy("source", "block").agg(title.alias("title"), F.max(F.col("kind") == "lost").alias("lost"), some(item).alias("items"), some(made).alias("directions"))
    return {"blocks": out.select("source", "block", part(1).alias("name"), part(2).alias("note"), "lost", "items", "directions")}


@parser("numbered clauses")
def _clauses(texts: DataFrame) -> dict[str, DataFrame]:
    return clauses(texts)


@parser("recipe blocks")
def _blocks(texts: DataFrame) -> dict[str, DataFrame]:
    return blocks(texts)
