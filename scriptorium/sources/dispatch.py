"""Pluggable parsers: a registry names a parser for each source."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

Parser = Callable[[DataFrame], dict[str, DataFrame]]

_PARSERS: dict[str, Parser] = {}


def parser(name: str) -> Callable[[Parser], Parser]:
    """Registers a parser: from (source, path, text) to tables by name."""

    def add(f: Parser) -> Parser:
        if name in _PARSERS:
            raise ValueError(f"two parsers named {name}")
        _PARSERS[name] = f
        return f

    return add


def run(texts: DataFrame, sources: list[tuple[str, str]]) -> dict[str, DataFrame]:
    """Tables of all sources (source, parser), one union by name for each kind; sources of one parser go through it together."""
    by_parser: dict[str, list[str]] = {}
    for source, name in sources:
        if name not in _PARSERS:
            raise ValueError(f"no parser {name} for {source}")
        by_parser.setdefault(name, []).append(source)
    made: dict[str, list[DataFrame]] = {}
    for name, own in by_parser.items():
        for kind, df in _PARSERS[name](texts.where(texts["source"].isin(own))).items():
            made.setdefault(kind, []).append(df)
    return {k: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) for k, parts in made.items()}
