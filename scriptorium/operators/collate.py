"""Collation: where passages stand in a witness, and how well they agree.

The kernels align code points with numpy. A passage is first sought as it is;
else the diagonals on which its grams meet the witness's vote for windows, and
a semi-global alignment scores these. Passages of a source are collated in
order: each is sought near where the last was found, then everywhere.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import AGREE, EPSILON, MISSING, VARIANT
from scriptorium.shipping import ship

GRAM, DIAGONAL, WINDOWS, LEAST_SLACK = 4, 16, 8, 8
BACK, AHEAD = 64, 3000
#: Signs that stand for a lost glyph, and for one that may be lost.
STRICT, LOOSE = "\ue000", "\ue001"

_DROP = re.compile(rf"[^\w{STRICT}{LOOSE}]|_")


def normalise(text: str) -> tuple[str, np.ndarray]:
    """Lower-case letters and digits (and wildcards), and the place each had in text."""
    places = [i for i, c in enumerate(text) if not _DROP.match(c)]
    return "".join(text[i] if len(text[i].lower()) != 1 else text[i].lower() for i in places), np.array([*places, len(text)], dtype=np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def semi_global(needle: str, window: str) -> tuple[int, int, int]:
    """distance, start, end of the best place of needle in window, whose ends are free.

    A strict wildcard on either side replaces one sign for nothing, a loose one
    may also be missing. Of equal distances the span nearest to the needle's length is
    taken, then the earlier end."""
    a, b = _codes(needle), _codes(window)
    n, m = len(a), len(b)
    strict, loose = ord(STRICT), ord(LOOSE)
    cost = np.zeros(m + 1, dtype=np.int64)
    start = np.arange(m + 1)
    free_b = np.where(b == loose, 0, 1)
    for i in range(n):
        wild = a[i] in (strict, loose)
        sub = cost[:-1] + np.where((b == a[i]) | wild | (b == strict) | (b == loose), 0, 1)
        drop = cost + (0 if a[i] == loose else 1)
        took = sub <= drop[1:]
        new = np.concatenate([drop[:1], np.where(took, sub, drop[1:])])
        own = np.concatenate([start[:1], np.where(took, start[:-1], start[1:])])
        run = np.concatenate([[0], np.cumsum(free_b)])
        lower = np.minimum.accumulate(new - run)
        better = lower + run < new
        if better.any():
            origin = np.maximum.accumulate(np.where(new - run == lower, np.arange(m + 1), 0))
            own = np.where(better, own[origin], own)
            new = lower + run
        cost, start = new, own
    best = np.flatnonzero(cost == cost.min())
    spans = np.abs(best - start[best] - n)
    end = int(best[np.argmin(spans)])
    return int(cost[end]), int(start[end]), end


def length_of(text: str) -> int:
    """The length that counts: without signs that may be missing."""
    return len(text) - text.count(LOOSE)


class Haystack:
    """A witness, normalised once, with an index of its grams."""

    def __init__(self, text: str):
        self.text, self.places = normalise(text)
        self.grams: dict[str, list[int]] | None = None

    def index(self) -> dict[str, list[int]]:
        if self.grams is None:
            self.grams = {}
            for i in range(len(self.text) - GRAM + 1):
                self.grams.setdefault(self.text[i : i + GRAM], []).append(i)
        return self.grams

    def locate(self, needle: str, low: int = 0, high: int | None = None) -> tuple[float, int, int] | None:
        """ratio, start, end (normalised) of needle, all of it in low..high."""
        n, high = length_of(needle), len(self.text) if high is None else min(high, len(self.text))
        if not n:
            return None
        at = self.text.find(needle, low, high)
        if at >= 0:
            return 1.0, at, at + len(needle)
        wild = STRICT in needle or LOOSE in needle
        if n < GRAM and not wild:
            return None
        slack = max(LEAST_SLACK, n // 4)
        spots = [(low, high)] if high - low <= 2 * n + 2 * slack else self._spots(needle, low, high, slack)
        best = None
        for a, z in spots:
            d, s, e = semi_global(needle, self.text[a:z])
            r = 1 - d / max(n, e - s, 1)
            if best is None or r > best[0]:
                best = (r, a + s, a + e)
        return best

    def _spots(self, needle: str, low: int, high: int, slack: int) -> list[tuple[int, int]]:
        """Windows around the diagonals with the most common grams."""
        votes: Counter[int] = Counter()
        for i in range(len(needle) - GRAM + 1):
            for p in self.index().get(needle[i : i + GRAM], ()):
                if low <= p < high:
                    votes[(p - i) // DIAGONAL] += 1
        spans = sorted((max(low, k * DIAGONAL - slack), min(high, k * DIAGONAL + DIAGONAL + len(needle) + slack)) for k, _ in sorted(votes.items(), key=lambda x: (-x[1], x[0]))[:WINDOWS])
        out: list[tuple[int, int]] = []
        for a, z in spans:
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(z, out[-1][1]))
            else:
                out.append((a, z))
        return out


def verdict(ratio: float | None) -> str:
    if ratio is None or ratio < MISSING:
        return "missing"
    return "agree" if ratio >= AGREE - EPSILON else "variant" if ratio >= VARIANT - EPSILON else "mismatch"


def diff(a: str, b: str) -> list[tuple[str, str, str]]:
    """(op, from, to) segments of the cheapest edit of a into b: equal or replace, neighbours merged."""
    x, y = _codes(a), _codes(b)
    table = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int32)
    table[0] = np.arange(len(y) + 1)
    for i in range(1, len(x) + 1):
        sub = table[i - 1, :-1] + (y != x[i - 1])
        row = np.concatenate([[i], np.minimum(sub, table[i - 1, 1:] + 1)])
        steps = np.arange(len(y) + 1)
        table[i] = np.minimum.accumulate(row - steps) + steps
    ops, i, j = [], len(x), len(y)
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + (x[i - 1] != y[j - 1]):
            i, j = i - 1, j - 1
            ops.append((x[i] == y[j], a[i], b[j]))
        elif i and table[i, j] == table[i - 1, j] + 1:
            i -= 1
            ops.append((False, a[i], ""))
        else:
            j -= 1
            ops.append((False, "", b[j]))
    out: list[list] = []
    for same, p, q in reversed(ops):
        if out and out[-1][0] == same:
            out[-1][1] += p
            out[-1][2] += q
        else:
            out.append([same, p, q])
    return [("equal" if s else "replace", p, q) for s, p, q in out]


def in_order(passages: list[str], witness: str) -> list[tuple[str, float, int, int]]:
    """verdict, ratio, start, end (in witness) of each passage, sought in order.

    The cursor moves to the end of what was found well; what is found far
    away and weakly, or is short, doesn't move it."""
    hay, cursor, out = Haystack(witness), 0, []
    for p in passages:
        needle, _ = normalise(p)
        n = length_of(needle)
        low, high = max(0, cursor - BACK), cursor + max(AHEAD, 3 * len(needle))
        hit = hay.locate(needle, low, high) if n else None
        near = hit is not None and hit[0] >= VARIANT
        if not near and n >= 2 * GRAM:
            wide = hay.locate(needle)
            if wide and (hit is None or wide[0] > hit[0]):
                hit = wide
        if hit is None:
            out.append(("missing", 0.0, -1, -1))
            continue
        ratio, s, e = hit
        if near or (ratio >= VARIANT and n >= 2 * GRAM):
            cursor = max(cursor, e) if near else e
        out.append((verdict(ratio), round(ratio, 4), int(hay.places[s]), int(hay.places[max(e - 1, s)]) + 1))
    return out


def collate(passages: DataFrame, witnesses: DataFrame) -> DataFrame:
    """source, witness, pos, verdict, ratio, start, end; passages have (source, pos, text), witnesses (source, witness, text).

    One task takes a source with a witness, as the cursor makes the pass sequential."""
    ship(passages.sparkSession)
    both = passages.select("source", "pos", F.col("text").alias("passage")).join(witnesses.select("source", "witness"), "source")

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("pos")
        found = in_order([t or "" for t in left["passage"]], "".join(t or "" for t in right["text"][:1])) if len(right) else []
        rows = [(*key, p, *f) for p, f in zip(left["pos"], found, strict=False)]
        return pd.DataFrame(rows, columns=["source", "witness", "pos", "verdict", "ratio", "start", "end"])

    kinds = dict(both.dtypes)
    ddl = f"source {kinds['source']}, witness {kinds['witness']}, pos {kinds['pos']}, verdict string, ratio double, start long, `end` long"
    other = witnesses.select(F.col("source").alias("s"), F.col("witness").alias("w"), "text")
    return both.groupBy("source", "witness").cogroup(other.groupBy("s", "w")).applyInPandas(run, ddl)
