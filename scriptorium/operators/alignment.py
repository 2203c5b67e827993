"""Alignments with wildcards and what they say: steps, segments, and a passage put together from its pieces."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from scriptorium.functions.offsets import LOOSE, STRICT
from scriptorium.functions.text import VARIANT

#: Signs that a witness has more between two sentences, from which on they count as an insertion of its own.
STRUCTURAL = 20
_WILD = np.array([ord(STRICT), ord(LOOSE)], dtype=np.uint32)

Span = tuple[str, int, int, int, int]


def solid(signs: np.ndarray) -> int:
    """The length that counts: without signs that may be missing."""
    return int((signs != ord(LOOSE)).sum())


def cost_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of all beginnings of a and b; a wildcard equals any sign, and one that may be missing costs nothing to leave out."""
    drop_a = np.where(a == ord(LOOSE), 0, 1).astype(np.int32)
    run = np.concatenate([[0], np.cumsum(np.where(b == ord(LOOSE), 0, 1))]).astype(np.int32)
    free_b = np.isin(b, _WILD)
    free_a = np.isin(a, _WILD)
    table = np.empty((len(a) + 1, len(b) + 1), dtype=np.int32)
    table[0] = run
    for i in range(len(a)):
        row = table[i] + drop_a[i]
        row[1:] = np.minimum(row[1:], table[i, :-1] + (~free_b & (b != a[i]) if not free_a[i] else 0))
        table[i + 1] = np.minimum.accumulate(row - run) + run
    return table


def steps(a: np.ndarray, b: np.ndarray) -> list[tuple[bool, int, int]]:
    """The cheapest way from a to b as (equal, signs of a, signs of b), from the front.

    What both begin and end with is equal. Between, going back from the ends, a free step is preferred to a paid one, and in each kind a pair of signs to one sign of a, and
    that to one of b."""
    head, tail = _ends(a, b)
    same = [(True, 1, 1)]
    return same * head + _walk(a[head : len(a) - tail], b[head : len(b) - tail]) + same * tail


def _ends(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many signs both begin with, and end with behind these."""
    most = min(len(a), len(b))
    differ = (a[:most] != b[:most]).nonzero()[0]
    head = int(differ[0]) if len(differ) else most
    most -= head
    differ = (a[len(a) - most :][::-1] != b[len(b) - most :][::-1]).nonzero()[0]
    return head, int(differ[0]) if len(differ) else most


def _wild(signs: np.ndarray) -> bool:
    return bool(((signs == _WILD[0]) | (signs == _WILD[1])).any())


def _walk(a: np.ndarray, b: np.ndarray) -> list[tuple[bool, int, int]]:
    if not _wild(a) and not _wild(b):
        return _walk_plain(a.tolist(), b.tolist())
    table, loose, wild = cost_table(a, b).tolist(), ord(LOOSE), set(_WILD.tolist())
    a, b = a.tolist(), b.tolist()
    out, i, j = [], len(a), len(b)
    while i or j:
        here = table[i][j]
        pair = i > 0 and j > 0
        if pair and here == table[i - 1][j - 1] and (a[i - 1] == b[j - 1] or a[i - 1] in wild or b[j - 1] in wild):
            step = (True, 1, 1)
        elif i and a[i - 1] == loose and here == table[i - 1][j]:
            step = (True, 1, 0)
        elif j and b[j - 1] == loose and here == table[i][j - 1]:
            step = (True, 0, 1)
        elif pair and here == table[i - 1][j - 1] + 1:
            step = (False, 1, 1)
        elif i and here == table[i - 1][j] + 1:
            step = (False, 1, 0)
        else:
            step = (False, 0, 1)
        out.append(step)
        i, j = i - step[1], j - step[2]
    return out[::-1]


def _walk_plain(a: list[int], b: list[int]) -> list[tuple[bool, int, int]]:
    """The same without wildcards, from bits of where the table rises and falls along a (down a column) and along b (from column to column)."""
    n, masks = len(a), {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, up, down = (1 << n) - 1, (1 << n) - 1, 0
    columns, rows = [(up, down)], [(0, 0)]
    for c in b:
        eq = masks.get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = (down | ~(h | up) & full) << 1 | 1, (up & h) << 1
        up, down = minus & full | ~(x | plus) & full, plus & x
        columns.append((up, down))
        rows.append((plus, minus))
    out, i, j = [], n, len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            step = (True, 1, 1)
        else:
            (up, down), (plus, minus) = columns[j], rows[j]
            rises = (up >> i - 1 & 1) - (down >> i - 1 & 1)
            if rises + (plus >> i - 1 & 1) - (minus >> i - 1 & 1) == 1:
                step = (False, 1, 1)
            else:
                step = (False, 1, 0) if rises == 1 else (False, 0, 1)
        out.append(step)
        i, j = i - step[1], j - step[2]
    out += [(False, 1, 0)] * i + [(False, 0, 1)] * j
    return out[::-1]


def kind(equal: bool, a: int, b: int) -> str:
    return "equal" if equal else "replace" if a and b else "delete" if a else "insert"


def joined(parts: list[tuple[bool, int, int, int, int]]) -> list[Span]:
    """Neighbours of one kind (equal or not) put together; empty ones go."""
    out: list[list] = []
    for equal, a0, a1, b0, b1 in parts:
        if a0 == a1 and b0 == b1:
            continue
        if out and out[-1][0] == equal and out[-1][2] == a0 and out[-1][4] == b0:
            out[-1][2], out[-1][4] = a1, b1
        else:
            out.append([equal, a0, a1, b0, b1])
    return [(kind(e, a1 - a0, b1 - b0), a0, a1, b0, b1) for e, a0, a1, b0, b1 in out]


def segments(a: np.ndarray, b: np.ndarray, at: int = 0, bt: int = 0) -> list[Span]:
    """(op, a_start, a_end, b_start, b_end) of the cheapest way from a to b, counted from at and bt."""
    head, tail = _ends(a, b)
    i, j = at + head, bt + head
    parts = [(True, at, i, bt, j)]
    for equal, p, q in _walk(a[head : len(a) - tail], b[head : len(b) - tail]):
        parts.append((equal, i, i + p, j, j + q))
        i, j = i + p, j + q
    return joined([*parts, (True, i, i + tail, j, j + tail)])


@dataclass
class Piece:
    """A piece of a passage: a is its span in the passage's source, b in the witness's; low and high count signs of the witness's normal form."""

    n: int
    closed: bool
    a: tuple[int, int]
    distance: int = 0
    low: int | None = None
    high: int = 0
    b: tuple[int, int] = (0, 0)
    spans: list[Span] = field(default_factory=list)

    @property
    def ratio(self) -> float:
        return 0.0 if self.low is None else 1 - self.distance / max(self.n, self.high - self.low, 1)


@dataclass
class Record:
    ratio: float
    start: int
    end: int
    placed: int
    gaps: int
    gap_signs: int
    spans: list[Span]


def assemble(pieces: list[Piece], structural: int = STRUCTURAL) -> Record | None:
    """A passage from its pieces, which stand in order; None if none is placed.

    The distance adds up those of the pieces and what the witness has between them. A piece that isn't placed and the
    text between its neighbours count as replacing one another, so the longer of both counts. Text between two adjacent, well placed
    pieces, of which the first ends a sentence, is an insertion of its own if it is long: it is counted apart, and neither
    the distance nor the length has it."""
    placed = [p for p in pieces if p.low is not None]
    if not placed:
        return None
    distance = length = gaps = gap_signs = waiting = 0
    last: Piece | None = None
    parts: list[tuple[bool, int, int, int, int]] = []
    cursor = placed[0].b[0]
    for p in pieces:
        distance += p.n if p.low is None else p.distance
        if p.low is None:
            waiting += p.n if last else 0
            parts.append((False, *p.a, cursor, cursor))
            continue
        length += p.high - p.low
        between = max(0, p.low - last.high) if last else 0
        if between and not waiting and between >= structural and last.closed and min(last.ratio, p.ratio) >= VARIANT:
            gaps, gap_signs = gaps + 1, gap_signs + between
        elif between:
            distance += max(0, between - waiting)
            length += between
        if p.b[0] > cursor and between:
            parts.append((False, p.a[0], p.a[0], cursor, p.b[0]))
        elif p.b[0] > cursor and parts:
            parts[-1] = (*parts[-1][:4], p.b[0])  # only what doesn't count is in between, and goes with what is before it
        for op, a0, a1, b0, b1 in p.spans:
            # What two pieces both claim stays with the first.
            parts.append((op == "equal" and b0 >= cursor, a0, a1, max(b0, cursor), max(b1, cursor)))
        cursor, last, waiting = max(cursor, p.b[1]), p, 0
    whole = max(sum(p.n for p in pieces), length)
    return Record(max(0.0, 1 - distance / whole) if whole else 1.0, placed[0].b[0], cursor, len(placed), gaps, gap_signs, joined(parts))
