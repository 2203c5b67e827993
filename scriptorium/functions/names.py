"""Names of items and bundles: canonical forms, plausibility, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import HAN
from scriptorium.operators.joins import small


def bare_name(name: Column) -> Column:
    """A name without brackets' contents and signs that aren't Han."""
    return F.regexp_replace(F.regexp_replace(name, r"[（(][^（()）]*[)）]", ""), f"[^{HAN}]", "")


def canonical(df: DataFrame, column: str, aliases: dict[str, str], slack: int = 2) -> DataFrame:
    """df with ``canonical``: the alias of the bare name, else of an alias it holds and exceeds by at most ``slack`` signs (the longest), else the bare name."""
    table = F.create_map(*[F.lit(x) for kv in sorted(aliases.items()) for x in kv]) if aliases else None
    held = F.array(*[F.lit(a) for a in sorted(aliases, key=lambda a: (-len(a), a))]) if aliases else F.array().cast("array<string>")
    bare = df.withColumn("_bare", bare_name(F.col(column)))
    part = F.get(F.filter(held, lambda a: F.contains(F.col("_bare"), a) & (F.char_length("_bare") <= F.char_length(a) + slack)), F.lit(0))
    found = F.coalesce(table["_bare"], table[part], F.col("_bare")) if aliases else F.col("_bare")
    return bare.withColumn("canonical", found).drop("_bare")


def partition_by_lexicon(items: DataFrame, name: str, lexicon: DataFrame, recover: Column) -> DataFrame:
    """items with ``status``: resolved (known), recovered (known under the name ``recover``) or unresolved, and the name that counts."""
    known = small(lexicon.select(F.col("name").alias("_k")).distinct())
    out = items.withColumn("_second", recover).join(known.withColumn("_a", F.lit(True)), F.col(name) == F.col("_k"), "left").drop("_k")
    again = known.withColumn("_b", F.lit(True))
    out = out.join(again, F.col("_second") == F.col("_k"), "left").drop("_k")
    status = F.when(F.col("_a"), "resolved").when(F.col("_b"), "recovered").otherwise("unresolved")
    return out.withColumn("status", status).withColumn("resolved", F.when(F.col("_a"), F.col(name)).when(F.col("_b"), F.col("_second"))).drop("_a", "_b", "_second")


def names_in_use(text: Column, verbs: list[str], endings: list[str], governs: list[str]) -> Column:
    """Distinct names of bundles in a text, in order of kind: after a verb that prescribes, and before one that says what it governs."""
    name = f"[{HAN}]{{1,8}}?(?:{'|'.join(endings)})"
    after = F.regexp_extract_all(text, F.lit(f"(?:{'|'.join(verbs)})({name})"), F.lit(1))
    before = F.regexp_extract_all(text, F.lit(f"({name})(?:{'|'.join(governs)})"), F.lit(1))
    return F.array_distinct(F.concat(after, before))


def plausible_name(name: Column, endings: list[str], stops: list[str], longest: int = 10) -> Column:
    """Whether a string may be a bundle's name: Han only, of a length, with a known ending and none of the stop words."""
    ok = name.rlike(f"^[{HAN}]{{2,{longest}}}$") & name.rlike(f"(?:{'|'.join(endings)})$")
    return ok & ~name.rlike("|".join(stops)) if stops else ok


def contrast(text: Column, common: str, true: str) -> Column:
    """(common view, true view) of a passage that sets one against the other, or null."""
    pattern = f"{common}([^。；;]+)[，,。；;][^。]*?{true}([^。；;]+)"
    first = F.regexp_extract(text, pattern, 1)
    return F.when(first != "", F.struct(first.alias("common"), F.regexp_extract(text, pattern, 2).alias("true")))


def properties(text: Column, natures: list[str], flavours: list[str], head: int = 80) -> Column:
    """nature, flavours, toxic from the head of an entry."""
    top = F.substring(text, 1, head)
    nature = F.regexp_extract(top, f"({'|'.join(sorted(natures, key=lambda x: (-len(x), x)))})", 1)
    tastes = F.array_distinct(F.regexp_extract_all(top, F.lit(f"({'|'.join(flavours)})"), F.lit(1)))
    return F.struct(F.nullif(nature, F.lit("")).alias("nature"), tastes.alias("flavours"), F.when(F.contains(top, F.lit("无毒")), False).when(top.rlike("[大小有]毒"), True).alias("toxic"))
