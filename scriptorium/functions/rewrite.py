"""Rewriting by phrases: of all phrases that begin at a place the longest one is replaced, from left to right.

Conversions between scripts need that: a phrase says how its signs are written, a sign alone only where
no phrase does. The table is the caller's, and is held as an automaton by each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.shipping import ship, small_batches

#: Signs of a table, at most; it goes to all tasks.
MOST = 8_000_000


def automaton(phrases: dict[str, str]) -> ahocorasick.Automaton | None:
    out = ahocorasick.Automaton()
    for old, new in phrases.items():
        out.add_word(old, (len(old), new))
    if not len(out):
        return None
    out.make_automaton()
    return out


def replaced(text: str, found: ahocorasick.Automaton | None) -> tuple[str, int]:
    """The text rewritten in one pass, and how many phrases were replaced; what has been written isn't read again."""
    if found is None:
        return text, 0
    # Where a phrase begins, the longest that does; the automaton reports ends.
    longest: dict[int, tuple[int, str]] = {}
    for end, (n, new) in found.iter(text):
        at = end - n + 1
        if n > longest.get(at, (0, ""))[0]:
            longest[at] = (n, new)
    out, cursor, count = [], 0, 0
    for at in sorted(longest):
        if at >= cursor:
            n, new = longest[at]
            out += [text[cursor:at], new]
            cursor, count = at + n, count + 1
    out.append(text[cursor:])
    return "".join(out), count


def convert(df: DataFrame, text: str, phrases: list[tuple[str, str]], into: str = "converted", count: str = "replaced") -> DataFrame:
    """df with the rewritten text and the number of phrases replaced; null stays null, with none.

    A phrase that is given twice with other replacements, or is empty, is an error."""
    table = dict(phrases)
    if "" in table or any(table[old] != new for old, new in phrases):
        raise ValueError("phrases must be neither empty nor ambiguous")
    if sum(len(old) + len(new) for old, new in table.items()) > MOST:
        raise ValueError(f"the table has more than {MOST} signs")
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    held = [f"_c{i}" for i in range(len(df.columns))]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(table)
        for b in batches:
            made = [(None, 0) if t is None else replaced(t, found) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], [*held, "_t", "_n"])

    kinds = ", ".join(f"{h} {t}" for h, (_, t) in zip(held, df.dtypes, strict=True))
    return df.toDF(*held).mapInArrow(run, f"{kinds}, _t string, _n long").toDF(*df.columns, into, count)
