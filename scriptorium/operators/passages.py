"""Lines of texts into numbered passages and blocks, and counts over them."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium.shipping import ship


def numbered(lines: DataFrame, key: str, least: int = 12, most: int | None = None) -> DataFrame:
    """key, number, passage, whole of lines (key, pos, line).

    Blank lines have no number; short passages go after numbering, so that numbers
    say where a passage stands. If ``most`` is given, longer ones are cut there, and ``whole`` is false for them."""
    body = lines.withColumn("passage", F.trim("line")).where("passage <> ''")
    number = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    kept = body.withColumn("number", number).where(F.char_length("passage") >= least)
    if most is None:
        return kept.select(key, "number", "passage", F.lit(True).alias("whole"))
    return kept.select(key, "number", F.substring("passage", 1, most).alias("passage"), (F.char_length("passage") <= most).alias("whole"))


def heading(line: Column, marks: str, lost: str) -> Column:
    """name, note, lost of a heading such as ``name (note)``; null where the line is none.

    marks is the pattern of a name, lost the word in a note that says the text is lost."""
    name = F.regexp_extract(line, rf"^\s*({marks})\s*(?:[（(]([^）)]*)[）)])?\s*$", 1)
    note = F.nullif(F.regexp_extract(line, rf"^\s*({marks})\s*(?:[（(]([^）)]*)[）)])?\s*$", 2), F.lit(""))
    return F.when(name != "", F.struct(name.alias("name"), note.alias("note"), F.coalesce(F.contains(note, F.lit(lost)), F.lit(False)).alias("lost")))


def blocks(lines: DataFrame, key: str, kinds: dict[str, Column], starts: str, first: str) -> DataFrame:
    """key, block, kind, n, text: lines (key, pos, line) grouped by a small state machine.

    A line that fits a kind (the first that fits) puts the block into that state,
    other lines stay in the state before; the kind ``starts`` opens a block, whose
    state is ``first`` at once after. Lines before the first block belong to none. States
    are the last kinds seen, so the machine is two running windows, not a loop."""
    kind = F.coalesce(*[F.when(test, F.lit(name)) for name, test in kinds.items()])
    running = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.where(F.trim("line") != "").withColumn("own", kind)
    placed = marked.withColumn("block", F.sum(F.when(F.col("own") == starts, 1).otherwise(0)).over(running)).where("block > 0")
    within = Window.partitionBy(key, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    later = F.last(F.when(F.col("own") != starts, F.col("own")), ignorenulls=True).over(within)
    stated = placed.withColumn("kind", F.when(F.col("own") == starts, starts).otherwise(F.coalesce(later, F.lit(first))))
    body = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return stated.groupBy(key, "block", "kind").agg(F.count(F.lit(1)).alias("n"), F.array_join(body, "\n").alias("text"))


#: Signs of titles that go to all tasks at once; each further block of them is one more pass over the texts.
TITLE_BLOCK = 4_000_000


def attach_by_title(texts: DataFrame, titles: DataFrame, patterns: list[str]) -> DataFrame:
    """text_id, title_id of the texts (text_id, text) that hold a title (title_id, title) in one of the patterns, ``{}`` being the title.

    An automaton over all titles in all patterns reads each text once; texts stay where they are."""
    ship(texts.sparkSession)
    asked = titles.where("trim(title) <> ''").distinct()
    size = asked.agg(F.sum(F.char_length("title"))).first()[0] or 0
    blocks = -(-size * len(patterns) // TITLE_BLOCK) or 1
    dealt = asked.select("title_id", "title", F.pmod(F.xxhash64("title"), F.lit(blocks)).alias("block"))
    kinds = [to_arrow_type(texts.schema["text_id"].dataType), to_arrow_type(titles.schema["title_id"].dataType)]
    ddl = f"text_id {dict(texts.dtypes)['text_id']}, title_id {dict(titles.dtypes)['title_id']}"
    out = None
    for block in range(blocks):
        rows = [(r["title_id"], r["title"]) for r in dealt.where(F.col("block") == block).collect()]
        part = texts.select("text_id", "text").mapInArrow(_title_pass(rows, patterns, kinds), ddl)
        out = part if out is None else out.union(part)
    return out.distinct()


def _title_pass(titles: list[tuple], patterns: list[str], kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, list] = {}
        for key, title in titles:
            for p in patterns:
                words.setdefault(p.replace("{}", title), []).append(key)
        found = ahocorasick.Automaton()
        for w, keys in words.items():
            found.add_word(w, keys)
        if words:
            found.make_automaton()
        for b in batches:
            own = []
            for key, text in zip(b["text_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                if text and words:
                    own += [(key, k) for k in dict.fromkeys(k for _, keys in found.iter(text) for k in keys)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in own], kinds[i]) for i in range(2)], ["text_id", "title_id"])

    return run


def derivations(text: Column, patterns: list[str]) -> Column:
    """The first hit of each pattern (its group), without repeats."""
    hits = F.array(*[F.regexp_extract(text, p, 1) for p in patterns])
    return F.array_distinct(F.filter(hits, lambda x: x != ""))


def stated_count(items: Column, missing: Column, stated: Column) -> Column:
    """Whether a stated number of equal doses is that of the items, or of those without a dose."""
    return F.when(stated == F.size(items), "all").when(stated == missing, "missing").otherwise("differs")


def fold_orphans(cases: DataFrame, key: str, order: str, orphan: Column) -> DataFrame:
    """key, order, owner: rows that are orphans belong to the last row before them that is none; those before the first own themselves."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(~orphan, F.col(order)), ignorenulls=True).over(w)
    return cases.select(key, order, F.coalesce(owner, F.col(order)).alias("owner"))


def interleave(a: DataFrame, b: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, pos, a, b: the n-th of each side together, with nulls where one is shorter."""
    w = Window.partitionBy(key).orderBy(order)
    x, y = (d.select(key, F.row_number().over(w).alias("pos"), F.col(value).alias(n)) for d, n in ((a, "a"), (b, "b")))
    return x.join(y, [key, "pos"], "full")


def hints(rates: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """rates with ``hints``: the names of the rules that hold, in order."""
    return rates.withColumn("hints", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules])))


def counters(texts: DataFrame, text: str, kinds: dict[str, str]) -> DataFrame:
    """kind, n: how often each pattern occurs in all texts together."""
    own = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count(F.col(text), F.lit(p)).alias("n")) for k, p in kinds.items()]))
    return texts.select(own.alias("x")).groupBy("x.kind").agg(F.coalesce(F.sum("x.n"), F.lit(0)).cast("long").alias("n"))


def top_of_group(rows: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """group, item, n, rank: the k most frequent items of each group, the smaller of equals first (a report)."""
    n = rows.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), item))
    return n.withColumn("rank", rank).where(F.col("rank") <= k)


def shown(status: Column, text: Column, longest: int) -> Column:
    """What a reader sees of a statement by its status, cut with an ellipsis."""
    cut = F.when(F.char_length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("…"))).otherwise(text)
    return F.when(text.isNull() | (F.trim(text) == ""), "-").when(status == "verified", cut).when(status == "inferred", F.concat(F.lit("("), cut, F.lit(")"))).otherwise(F.concat(F.lit("? "), cut))


def projected(records: DataFrame, needed: list[str], defaults: dict[str, str], ops: str) -> DataFrame:
    """Records with all needed fields, defaults where fields are null, and their variants (array of (op, text)) only if one isn't equal."""
    full = records.where(" AND ".join(f"{c} IS NOT NULL" for c in needed))
    for c, value in defaults.items():
        full = full.withColumn(c, F.coalesce(c, F.lit(value)))
    return full.withColumn(ops, F.when(F.exists(ops, lambda o: o["op"] != "equal"), F.col(ops)))
