"""Bundles from text: blocks of a name, an item list and a preparation into items with doses.

The kernels are Python over one block; they run as Arrow UDFs over the blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.numerals import COUNTS, DIGITS, FINANCIAL, HALF, LIANG, QIAN, SHENG, TENS
from scriptorium.shipping import ship

_NUMBER = rf"[{''.join([*DIGITS, *FINANCIAL, *TENS, HALF])}0-9.]+"
_UNIT = "|".join(dict.fromkeys([*LIANG, *SHENG, *QIAN, *COUNTS]))
_DOSE = re.compile(rf"(?:各)?(?:{_NUMBER}(?:{_UNIT}){HALF}?)+$")
EACH = "各"
_OPEN, _CLOSE = "（(", "）)"
ITEM = "struct<name:string,dose:string,note:string>"


def split_items(line: str) -> list[str]:
    """Parts of a line between separators that stand outside brackets; unclosed brackets are closed at the end."""
    parts, depth, at = [""], 0, 0
    for c in line:
        depth += (c in _OPEN) - (c in _CLOSE and depth > 0)
        if depth == 0 and c in "、，,;； \t　":
            parts.append("")
        else:
            parts[-1] += c
        at += 1
    if depth:
        parts[-1] += "）" * depth
    return [p for p in parts if p.strip()]


def parse_item(token: str) -> dict:
    """name, dose, note of one token: notes stand in brackets, the dose ends the name or stands in brackets."""
    notes = re.findall(rf"[{_OPEN}]([^{_OPEN}{_CLOSE}]*)[{_CLOSE}]", token)
    name = re.sub(rf"[{_OPEN}][^{_OPEN}{_CLOSE}]*[{_CLOSE}]", "", token).strip(" 。.")
    dose = None
    if m := _DOSE.search(name):
        dose, name = m[0], name[: m.start()]
    rest = []
    for n in notes:
        if dose is None and _DOSE.fullmatch(n.strip()):
            dose = n.strip()
        else:
            rest.append(n.strip())
    return {"name": name.strip(), "dose": dose, "note": "；".join(r for r in rest if r) or None}


def segment(token: str, lexicon: frozenset[str]) -> list[str] | None:
    """A glued token cut into known names, longest first, all of it or nothing."""
    longest = max(map(len, lexicon), default=0)
    out, at = [], 0
    while at < len(token):
        for n in range(min(longest, len(token) - at), 0, -1):
            if token[at : at + n] in lexicon:
                out.append(token[at : at + n])
                at += n
                break
        else:
            return None
    return out


def share_doses(items: list[dict]) -> list[dict]:
    """A dose of "each" goes to the undosed items before it, back to a dosed one; a token that is only a dose joins its predecessor."""
    out: list[dict] = []
    for item in items:
        if not item["name"] and item["dose"] and out and out[-1]["dose"] is None and not item["dose"].startswith(EACH):
            out[-1] = out[-1] | {"dose": item["dose"]}
            continue
        each = bool(item["dose"]) and item["dose"].startswith(EACH)
        dose = item["dose"].removeprefix(EACH) if each else item["dose"]
        if each:
            for k in range(len(out) - 1, -1, -1):
                if out[k]["dose"] is not None:
                    break
                out[k] = out[k] | {"dose": dose}
        if item["name"]:
            out.append(item | {"dose": dose})
    return out


def parse_line(line: str, lexicon: frozenset[str] = frozenset()) -> list[dict]:
    """The items of a line."""
    items = []
    for token in split_items(line):
        item = parse_item(token)
        cut = segment(item["name"], lexicon) if lexicon and item["name"] not in lexicon and len(item["name"]) > 2 else None
        if cut and len(cut) > 1:
            items += [{"name": n, "dose": None, "note": None} for n in cut[:-1]] + [item | {"name": cut[-1]}]
        else:
            items.append(item)
    return share_doses(items)


def parse_items(df: DataFrame, key: str, line: str, lexicon: Iterable[str] = ()) -> DataFrame:
    """key, items of lines."""
    ship(df.sparkSession)
    known = frozenset(lexicon)

    @F.pandas_udf(f"array<{ITEM}>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: parse_line(x or "", known))

    return df.select(key, run(F.col(line)).alias("items"))


def list_quality(items: list[dict], junk: re.Pattern[str] = re.compile(r"^$|[。：:]|.{7,}")) -> int:
    """How much an item list looks like one: its length up to 16, three for each dose, less six for each junk name; -1 if half is junk."""
    bad = sum(bool(junk.search(i["name"])) for i in items)
    if not items or 2 * bad >= len(items):
        return -1
    return min(len(items), 16) + 3 * sum(i["dose"] is not None for i in items) - 6 * bad


def modifications(text: str) -> list[dict]:
    """cause, removed, added of clauses "if C, remove R, add A"."""
    out = []
    for clause in re.split(r"[。；;]", text):
        m = re.match(r"\s*(?:若|如)(.+?)[者，,]", clause)
        if m:
            take = lambda k, c=clause: [x for y in re.findall(rf"{k}([^，,加去减]+)", c) for x in re.split("[、 ]", y) if x]
            removed, added = take("[去减]"), take("加")
            if removed or added:
                out.append({"cause": m[1], "removed": removed, "added": added})
    return out


def resolve_derivations(blocks: list[dict]) -> list[dict]:
    """Blocks (name, base, removed, added, items) of one document whose items follow from their base's, until nothing more follows."""
    known = {b["name"]: b["items"] for b in blocks if b["items"]}
    before = -1
    while len(known) != before:
        before = len(known)
        for b in blocks:
            if b["name"] not in known and b.get("base") in known:
                known[b["name"]] = [i for i in known[b["base"]] if i["name"] not in b["removed"]] + [{"name": a, "dose": None, "note": None} for a in b["added"]]
    return [b | {"items": known.get(b["name"], [])} for b in blocks]
