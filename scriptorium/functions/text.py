"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of a comparison's verdict.
AGREE, VARIANT, MISSING, EPSILON = 0.95, 0.80, 0.50, 1e-9

HAN = "一-鿿"


def han_and_digits(text: Column) -> Column:
    """The text without what is neither Han nor a digit, for loose comparison."""
    return F.regexp_replace(text, f"[^{HAN}0-9]", "")


def letters_and_digits(text: Column) -> Column:
    """The text without what is neither letter nor digit nor private-use sign."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}\p{Co}]", "")


def variant_faults(pairs: list[tuple[str, str]]) -> list[str]:
    """What is wrong with a list of (variant, standard), one line for each fault."""
    olds = [old for old, _ in pairs]
    step = dict(pairs)
    faults = [f"{old!r} to {new!r}: not single characters" for old, new in pairs if (len(old), len(new)) != (1, 1)]
    faults += [f"{old!r}: maps to itself" for old, new in pairs if old == new]
    faults += [f"{old!r}: mapped {olds.count(old)} times" for old in dict.fromkeys(olds) if olds.count(old) > 1]
    ends = _closure(step)
    return faults + [f"{old!r}: in a circle" for old in step if ends[old] in step and step[old] != old]


def _closure(step: dict[str, str]) -> dict[str, str]:
    """Where each key leads, by doubling the steps as often as a chain can need."""
    ends = dict(step)
    for _ in range(len(step).bit_length()):
        ends = {old: ends.get(new, new) for old, new in ends.items()}
    return ends


def resolve_variants(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """A character map with chains followed to their end (a to b and b to c give a to c)."""
    if faults := variant_faults(pairs):
        raise ValueError("; ".join(faults))
    return _closure(dict(pairs))


def fold_variants(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The text with each variant character replaced by its standard one."""
    table = resolve_variants(pairs)
    return F.translate(text, "".join(table), "".join(table.values())) if table else text


def ratio(distance: Column, a: Column, b: Column) -> Column:
    """1 - distance / the longer length; two empty texts are equal."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - distance / longest)


def similarity(a: Column, b: Column) -> Column:
    return ratio(F.levenshtein(a, b), a, b)


def verdict(r: Column, floor: bool = False) -> Column:
    """agree, variant or mismatch; with a floor, missing below it. A ratio outside 0..1 is an error."""
    bad = (r < -EPSILON) | (r > 1 + EPSILON)
    out = F.when(bad, F.raise_error(F.concat(F.lit("ratio out of range: "), r.cast("string"))).cast("string"))
    if floor:
        out = out.when(r < MISSING, "missing")
    return out.when(r >= AGREE - EPSILON, "agree").when(r >= VARIANT - EPSILON, "variant").otherwise("mismatch")


def grams(text: Column, n: int = 3) -> Column:
    """The set of a text's n-grams; a shorter text is its own and only gram, the empty one included."""
    length = F.char_length(text)
    inner = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
    return F.when(length < n, F.array(text)).otherwise(inner)


def content_key(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts joined by line feeds."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 16)


def base_name(name: Column, markers: str, default: str) -> Column:
    """What stands before the first marker (an alternation), else the whole name; empty gives default."""
    head = F.trim(F.regexp_replace(name, f"(?s)(?:{markers}).*$", ""))
    return F.when(head == "", F.lit(default)).otherwise(head)


def readable_title(title: Column, source: Column | None = None) -> Column:
    """A title without leading order marks and trailing numbers, after its source's title."""
    out = F.trim(F.regexp_replace(F.regexp_replace(title, r"^\s*[0-9]+[.)、]\s*", ""), r"\s*[-#(]?[0-9]+\)?\s*$", ""))
    return out if source is None else F.concat_ws(" · ", source, out)


def parse_concept(concept: Column, kinds: list[str]) -> Column:
    """kind and label of an id ``kind.label``; null if the kind isn't known."""
    kind = F.substring_index(concept, ".", 1)
    label = F.substring(concept, F.length(kind) + 2, F.length(concept))
    return F.when(F.instr(concept, ".") > 0, F.when(kind.isin(kinds) & (label != ""), F.struct(kind.alias("kind"), label.alias("label"))))


def quote_segments(quote: Column) -> Column:
    """A quotation's parts between ellipses, without empty ones."""
    return F.filter(F.transform(F.split(quote, r"(?:…+|\.{3,}|⋯+)"), lambda s: F.trim(s)), lambda s: s != "")


def mask_gaps(text: Column, strict: str = "\ue000", loose: str = "\ue001") -> Column:
    """Signs of lost glyphs as strict wildcards and a lone space between Han as a loose one; the length stays."""
    out = F.regexp_replace(text, "[□■◯○�]", strict)
    return F.regexp_replace(out, f"(?<=[{HAN}{strict}]) (?=[{HAN}{strict}])", loose)


def highlight(text: Column, terms: list[str]) -> Column:
    """The text cut at the terms, longest first: array of (part, hit)."""
    import re

    either = "|".join(re.escape(t) for t in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)))
    if not either:
        return F.array(F.struct(text.alias("part"), F.lit(False).alias("hit")))
    marked = F.regexp_replace(text, f"({either})", "\x01\x02$1\x01")
    return F.transform(F.filter(F.split(marked, "\x01"), lambda p: p != ""), lambda p: F.struct(F.regexp_replace(p, "^\x02", "").alias("part"), p.startswith("\x02").alias("hit")))


def padded_id(prefix: Column, *numbers: tuple[Column, int]) -> Column:
    """prefix and zero-padded numbers joined by hyphens."""
    return F.concat_ws("-", prefix, *[F.lpad(n.cast("string"), w, "0") for n, w in numbers])


def contains_loosely(text: Column, needle: Column) -> Column:
    """Whether needle is in text when white space doesn't count; an empty needle never is."""
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    return (squeeze(needle) != "") & F.contains(squeeze(text), squeeze(needle))
