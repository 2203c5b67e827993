"""Sinks: tables as files by key, and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, by: list[str] | None = None, form: str = "parquet") -> None:
    """Overwrites a table, partitioned by keys if given. Spark's commit makes it appear whole or not at all."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).format(form).save(path)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; more than ``most`` rows are an error, as a report is no dump."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a report")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(x) for x in r) + " |" for r in rows]) + "\n"
