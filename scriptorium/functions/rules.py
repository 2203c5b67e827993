"""Predicates and gates as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_corpus(source_corpus: Column, corpus: str) -> Column:
    """Rows of the corpus, and rows of no source."""
    return source_corpus.isNull() | (source_corpus == corpus)


def any_of_group(items: Column, members: list) -> Column:
    """Whether any member of an alias group is among items."""
    return F.arrays_overlap(items, F.array(*[F.lit(m) for m in members]))


def matches_any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns], F.lit(False))


def junk_item(name: Column, allowed_short: list[str], blacklist: list[str], longest: int = 6, numerals: str = "0-9") -> Column:
    """Names of numerals alone, too long, of one sign unless allowed, or on the blacklist (patterns)."""
    return name.isNull() | name.rlike(f"^[{numerals}]+$") | (F.char_length(name) > longest) | ((F.char_length(name) <= 1) & ~name.isin(allowed_short)) | matches_any(name, blacklist)


def clean_items(items: Column, renames: dict[str, str], junk) -> Column:
    """Items renamed and then without junk; junk is a function of a name's column."""
    table = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv]) if renames else None
    named = F.transform(items, lambda x: F.coalesce(table[x], x)) if renames else items
    return F.filter(named, lambda x: ~junk(x))


def negated_before(text: Column, at: Column, negations: list[str], reach: int = 6) -> Column:
    """Whether a negation ends within reach signs before the place ``at`` (from 1)."""
    before = F.substring(text, F.greatest(at - reach, F.lit(1)), F.least(at - 1, F.lit(reach)))
    return F.when(at > 1, matches_any(before, negations)).otherwise(False)


def gated(value: Column, group: Column, closed: list[str], opened: bool) -> Column:
    """The value, but null for closed groups unless the gate is open."""
    return value if opened else F.when(~group.isin(closed), value)


def visible(value: Column, status: Column, shown: str = "reviewed") -> Column:
    return F.when(status == shown, value)


def single_addition(kind: Column, added: Column, removed: Column) -> Column:
    return (kind == "add") | ((F.size(added) == 1) & (F.size(removed) == 0))


def shortened(text: Column, longest: int) -> Column:
    return F.when(F.char_length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("…"))).otherwise(text)
