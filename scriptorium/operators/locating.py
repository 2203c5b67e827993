"""Where passages stand in texts, with small differences.

One pass over the texts, in place, with all passages of a block at hand: every run of a few
signs of a text is looked up among the runs of the passages (a sorted table of hashes), a hit
votes for a diagonal (its place in the text less its place in the passage), and hits of a
passage whose diagonals lie close together open a window. In a window a bit-parallel edit
distance says whether the passage can be there; only then a full alignment gives the span.
These distances are most of the work, so those of many texts' windows are taken at once.

What is found for certain: with n signs and at most k = n // 4 edits, a passage that is in a
text with a ratio of ``least`` = 0.8 or more shares runs with it. Up to ``SHORT`` signs the
run's length is chosen so that at least n + 1 - q * (k + 1) of them must be left on nearby
diagonals, so all such places are found, passages of one or two words included. Longer
passages are found where ``VOTES`` of their runs of ``RUN`` signs are left; an edit touches RUN runs
at most, so that holds for certain with up to (n + 1 - VOTES) // RUN - 1 edits (a ratio of about
0.88), and fails at 0.8 only where edits leave hardly a run of that length anywhere.

Texts are never shuffled. Passages go to all tasks in blocks of ``BLOCK`` signs; each further
block is one more pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium.functions.offsets import Form, codes, normal_form
from scriptorium.functions.text import EPSILON, VARIANT
from scriptorium.operators.collate import semi_global
from scriptorium.shipping import ship

SHORT, RUN, VOTES = 32, 8, 3
#: Signs of passages that go to all tasks at once.
BLOCK = 4_000_000
PLAIN = Form(lower=True)
#: Signs of texts whose windows are gathered, windows that are measured at once, and bits of a word of theirs.
GATHER, AT_ONCE, WORD = 1_000_000, 1024, 62
#: Signs of texts whose scores are kept at once; so few pairs for each word are faster one by one.
CELLS, FEW = 1 << 20, 14
_ODD = np.uint64(0x9E3779B97F4A7C15)


def most_edits(n: int) -> int:
    """Edits that a passage of n signs can have at a ratio of 0.8: d <= 0.2 * (n + d)."""
    return n // 4


def run_length(n: int) -> tuple[int, int]:
    """The runs to look up for n signs, and how many of them must be there."""
    k = most_edits(n)
    q = RUN if n > SHORT else max(1, n // (k + 1))
    return q, max(1, n + 1 - q * (k + 1)) if n <= SHORT else VOTES


def run_hashes(signs: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q signs."""
    out = np.zeros(max(0, len(signs) - q + 1), dtype=np.uint64)
    for j in range(q):
        out = (out ^ signs[j : j + len(out)].astype(np.uint64)) * _ODD
        out ^= out >> np.uint64(29)
    return out


class Pattern:
    """A passage for bit-parallel search by edit distance."""

    def __init__(self, signs: np.ndarray):
        self.signs, self.n = signs, len(signs)
        self._back: Pattern | None = None
        self._table: tuple[np.ndarray, np.ndarray] | None = None
        self.masks: dict[int, int] = {}
        for i, c in enumerate(signs.tolist()):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def _scores(self, text: list[int], anchored: bool) -> Iterator[int]:
        """The distance to what ends at each place, from any start or from the first sign on."""
        full, top = (1 << self.n) - 1, 1 << self.n - 1
        up, down, score, carry = full, 0, self.n, int(anchored)
        get = self.masks.get
        for c in text:
            eq = get(c, 0)
            x = eq | down
            h = (((eq & up) + up) ^ up) | eq
            plus = down | ~(h | up) & full
            minus = up & h
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            yield score
            plus, minus = (plus << 1 | carry) & full, minus << 1 & full
            up, down = minus | ~(x | plus) & full, plus & x

    def distance(self, text: np.ndarray) -> int:
        """The least distance to any span of the text."""
        return min(self._scores(text.tolist(), False), default=self.n)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct signs in order, and the words of each sign's mask; a last row is that of all other signs."""
        if self._table is None:
            distinct = np.array(sorted(self.masks), dtype=np.uint32)
            cut = [[self.masks[c] >> at & (1 << WORD) - 1 for at in range(0, self.n, WORD)] for c in distinct.tolist()]
            self._table = distinct, np.array([*cut, [0] * -(-self.n // WORD)], dtype=np.uint64)
        return self._table

    def span(self, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
        """distance, start, end of the nearest span that isn't empty, if its distance is ``most`` or less.

        Of equally near spans the one is taken whose length is closest to the passage's, then the earlier one, then the shorter."""
        scores = list(self._scores(text.tolist(), False))
        d = min(scores, default=self.n)
        if d > most or d >= self.n:
            return None
        best = None
        for e in (j + 1 for j, x in enumerate(scores) if x == d):
            low = max(0, e - self.n - d)
            for k, x in enumerate(self.backwards()._scores(text[low:e][::-1].tolist(), True), 1):
                if x == d and (best is None or (abs(k - self.n), e) < best[0]):
                    best = ((abs(k - self.n), e), e - k, e)
        return d, best[1], best[2]

    def backwards(self) -> Pattern:
        if self._back is None:
            self._back = Pattern(self.signs[::-1])
        return self._back


def distances(pairs: list[tuple[Pattern, np.ndarray]]) -> np.ndarray:
    """``distance`` of each pattern and text, in lockstep over the texts' signs."""
    out = np.array([p.n for p, _ in pairs], dtype=np.int64)
    size = np.array([len(t) for _, t in pairs], dtype=np.int64)
    even = size <= 8 * out + 64
    for k in np.flatnonzero(~even).tolist():
        out[k] = pairs[k][0].distance(pairs[k][1])
    # Alike in length, the longest first, so that those that are through are always the last.
    order = np.flatnonzero(even & (size > 0) & (out > 0))
    order = order[np.argsort(-size[order], kind="stable")]
    for first in range(0, len(order), AT_ONCE):
        some = order[first : first + AT_ONCE]
        out[some] = _lockstep([pairs[k] for k in some.tolist()], out[some], size[some])
    return out


def _lockstep(pairs: list[tuple[Pattern, np.ndarray]], sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    words, one, last, whole = -(-int(sizes.max()) // WORD), np.uint64(1), np.uint64(WORD - 1), np.uint64((1 << WORD) - 1)
    masks = np.zeros((int(lengths.max()), words, len(pairs)), dtype=np.uint64)
    full, top = np.zeros((2, words, len(pairs)), dtype=np.uint64)
    for k, (p, text) in enumerate(pairs):
        distinct, rows = p.table()
        at = np.minimum(np.searchsorted(distinct, text), len(distinct) - 1)
        masks[: len(text), : rows.shape[1], k] = rows[np.where(distinct[at] == text, at, len(distinct))]
        full[: rows.shape[1], k] = whole
        full[rows.shape[1] - 1, k] = (1 << (p.n - 1) % WORD + 1) - 1
        top[rows.shape[1] - 1, k] = 1 << (p.n - 1) % WORD
    up, down, score, best = full.copy(), np.zeros_like(full), sizes.copy(), sizes.copy()
    for j, m in enumerate(np.searchsorted(-lengths, -np.arange(len(masks))).tolist()):
        if m < up.shape[1]:
            up, down, full, top, score = up[:, :m], down[:, :m], full[:, :m], top[:, :m], score[:m]
        eq = masks[j, :, :m]
        x, h = eq | down, eq & up
        carry = np.zeros(m, dtype=np.uint64)
        for w in range(words):
            total = h[w] + up[w] + carry
            carry = total >> np.uint64(WORD)
            h[w] = ((total & whole) ^ up[w]) | eq[w]
        plus, minus = down | ~(h | up) & full, up & h
        score = score + ((plus & top) != 0).any(axis=0) - ((minus & top) != 0).any(axis=0)
        best[:m] = np.minimum(best[:m], score)
        for bits in (plus, minus):
            over = bits[:-1] >> last
            np.left_shift(bits, one, out=bits)
            bits[1:] |= over
            bits &= full
        up, down = minus | ~(x | plus) & full, plus & x
    return best


def spans(needles: list[np.ndarray], texts: list[np.ndarray], most: list[int], least: list[float]) -> list[tuple[int, int, int] | None]:
    """``Pattern.span`` of each needle in its text, if its ratio is ``least`` or more; in lockstep, to all ends of the least distance, and from these back to all starts."""
    sizes, longest = np.array([len(s) for s in needles], dtype=np.int64), np.array(most, dtype=np.int64)
    far = 1 - np.array(least, dtype=np.float64)
    nearest, ends, whose = sizes.copy(), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for some, scores in _all_scores(needles, texts, False):
        nearest[some] = d = scores.min(axis=0)
        row, column = np.nonzero(scores == np.where((d <= longest[some]) & (d < sizes[some]), d, -1))
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        ends.append(row + 1)
        whose.append(some[column])
    end, who = np.concatenate(ends), np.concatenate(whose)
    low = np.maximum(0, end - sizes[who] - nearest[who])
    off, length = np.zeros((2, len(end)), dtype=np.int64)

    def back(jobs: np.ndarray) -> None:
        turned = {i: needles[i][::-1] for i in np.unique(who[jobs]).tolist()}
        behind = [texts[i][a:e][::-1] for i, a, e in zip(who[jobs].tolist(), low[jobs].tolist(), end[jobs].tolist(), strict=True)]
        for some, scores in _all_scores([turned[i] for i in who[jobs].tolist()], behind, True):
            row, column = np.nonzero(scores == nearest[who[jobs[some]]].astype(scores.dtype))
            reach, job = row + 1, jobs[some[column]]
            apart = np.abs(reach - sizes[who[job]])
            # Closest to the passage's length, then the shorter.
            order = np.lexsort((reach, apart, job))
            order = order[np.diff(job[order], prepend=-1) != 0]
            length[job[order]], off[job[order]] = reach[order], apart[order]

    # With so many edits only a long span will do, and the one closest to the passage's length is taken: one end with a shorter one rules them all out.
    first = np.diff(who, prepend=-1) != 0
    long = np.ceil(nearest / np.maximum(far, 1e-9) - 1e-6).astype(np.int64)[who] - sizes[who]
    back(np.flatnonzero(first))
    out_of = np.zeros(len(needles), dtype=bool)
    out_of[who[first & (off < long)]] = True
    back(np.flatnonzero(~first & ~out_of[who]))
    out: list[tuple[int, int, int] | None] = [None] * len(needles)
    best = np.lexsort((end, off, who))
    for k in best[np.diff(who[best], prepend=-1) != 0].tolist():
        i, d, n = int(who[k]), int(nearest[who[k]]), int(length[k])
        if not out_of[i] and 1 - d / max(len(needles[i]), n) >= least[i]:
            out[i] = d, int(end[k]) - n, int(end[k])
    return out


def _all_scores(needles: list[np.ndarray], texts: list[np.ndarray], anchored: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of pairs, and what ``Pattern._scores`` gives at each sign of their texts as columns; pairs of like sizes go together."""
    words = np.array([-(-len(s) // 64) for s in needles], dtype=np.int64)
    length = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.lexsort((-length, words))
    order = order[(words[order] > 0) & (length[order] > 0)]
    first = 0
    while first < len(order):
        own, longest = words[order[first]], length[order[first]]
        past = min(first + max(1, min(4 * AT_ONCE, CELLS // int(longest))), int(np.searchsorted(words[order], own, side="right")))
        some = order[first:past]
        yield some, _scores_of([needles[k] for k in some.tolist()], [texts[k] for k in some.tolist()], int(own), anchored)
        first = past


def _scores_of(needles: list[np.ndarray], texts: list[np.ndarray], words: int, anchored: bool) -> np.ndarray:
    """Scores of pairs with equally many words of 64 bits, whose texts go from the longest to the shortest; past its end a text has none that is near.

    What stands above a passage's last bit is never read."""
    one, last = np.uint64(1), np.uint64(63)
    sizes, length = np.array([len(s) for s in needles], dtype=np.int64), np.array([len(t) for t in texts], dtype=np.int64)
    m = len(sizes)
    if m < FEW * words:
        out = np.full((int(length[0]), m), np.iinfo(np.int32).max, dtype=np.int32)
        for k, (s, t) in enumerate(zip(needles, texts, strict=True)):
            out[: len(t), k] = list(Pattern(s)._scores(t.tolist(), anchored))
        return out
    owner, row = np.repeat(np.arange(m), sizes), np.repeat(np.arange(m), length)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    own, other = np.concatenate(needles).astype(np.int64), np.concatenate(texts).astype(np.int64)
    kinds = np.full(int(max(own.max(), other.max())) + 1, -1, dtype=np.int64)
    kinds[own] = 0
    alphabet = np.flatnonzero(kinds == 0)
    kinds[alphabet] = np.arange(len(alphabet))
    wide = len(alphabet) + 1
    if wide * m * words <= 4 * CELLS:
        # Each passage has a mask for all signs of the batch, and an empty one for what kinds has as -1.
        which, found, size = owner * wide + kinds[own] + 1, row * wide + kinds[other] + 1, wide * m
    else:
        distinct, which = np.unique(owner << 32 | own, return_inverse=True)
        sought = row << 32 | other
        found = np.minimum(np.searchsorted(distinct, sought), len(distinct) - 1)
        found, size = np.where(distinct[found] == sought, found, len(distinct)), len(distinct) + 1
    masks = np.zeros((words, size), dtype=np.uint64)
    np.bitwise_or.at(masks.reshape(-1), place // 64 * size + which, one << (place % 64).astype(np.uint64))
    grid = np.zeros((int(length[0]), m), dtype=np.int64)
    grid[at, row] = found
    top = ((sizes - 1) % 64).astype(np.uint64)
    up = [np.full(m, ~np.uint64(0)) for _ in range(words)]
    down = [np.zeros(m, dtype=np.uint64) for _ in range(words)]
    # Rises less falls, counted from the passage's length.
    steps = np.zeros(grid.shape, dtype=np.int8)
    for j, k in enumerate(np.searchsorted(-length, -np.arange(len(grid))).tolist()):
        if k < m:
            m, top, up, down = k, top[:k], [u[:k] for u in up], [d[:k] for d in down]
        carry = rise = fall = None
        for w in range(words):
            eq, u, d = masks[w].take(grid[j, :m]), up[w], down[w]
            own = eq & u
            h = own + u
            if words > 1:
                over = h < own
                if carry is not None:
                    h += carry
                    over |= h < carry
                carry = over.astype(np.uint64)
            h ^= u
            h |= eq
            eq |= d
            plus = ~(h | u)
            plus |= d
            minus = u & h
            if w == words - 1:
                np.subtract((plus >> top) & one, (minus >> top) & one, out=steps[j, :m], casting="unsafe")
            else:
                above = plus >> last, minus >> last
            plus <<= one
            minus <<= one
            if rise is not None:
                plus |= rise
                minus |= fall
            elif anchored:
                plus |= one
            if w < words - 1:
                rise, fall = above
            up[w] = minus | ~(eq | plus)
            down[w] = plus & eq
    kind = np.int16 if int(sizes.max() + length[0]) < np.iinfo(np.int16).max else np.int32
    out = np.cumsum(steps, axis=0, dtype=kind)
    out += sizes.astype(kind)
    out[np.arange(len(grid))[:, None] >= length] = np.iinfo(kind).max
    return out


@dataclass
class _Table:
    """Runs of passages by length: hashes in order, and whose they are."""

    hashes: np.ndarray
    owners: np.ndarray
    places: np.ndarray


class Needles:
    """Passages that are looked for together."""

    def __init__(self, texts: list[str]):
        self.texts = [normal_form(t or "", PLAIN)[0] for t in texts]
        self.signs = [codes(t) for t in self.texts]
        self.patterns: dict[int, Pattern] = {}
        self.sizes = np.array([len(s) for s in self.signs], dtype=np.int64)
        self.edits = self.sizes // 4
        self.needed = np.array([run_length(n)[1] if n else 0 for n in self.sizes.tolist()], dtype=np.int64)
        by_length: dict[int, list[int]] = {}
        for i, n in enumerate(self.sizes.tolist()):
            if n:
                by_length.setdefault(run_length(n)[0], []).append(i)
        self.tables = {}
        for q, members in by_length.items():
            hashes = [run_hashes(self.signs[i], q) for i in members]
            owners = np.repeat(np.array(members), [len(h) for h in hashes])
            places = np.concatenate([np.arange(len(h)) for h in hashes])
            flat = np.concatenate(hashes)
            order = np.argsort(flat, kind="stable")
            self.tables[q] = _Table(flat[order], owners[order], places[order])

    def windows(self, text: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Passage, start and end of the windows that have votes enough."""
        for q, t in self.tables.items():
            own = run_hashes(text, q)
            low = np.searchsorted(t.hashes, own)
            there = np.flatnonzero(t.hashes[np.minimum(low, len(t.hashes) - 1)] == own)
            if not len(there):
                continue
            low = low[there]
            counts = np.searchsorted(t.hashes, own[there], side="right") - low
            at = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            who, diagonal = t.owners[at], np.repeat(there, counts) - t.places[at]
            order = np.lexsort((diagonal, who))
            who, diagonal, held = who[order], diagonal[order], t.places[at][order]
            reach = self.edits[who]
            opens = np.append(True, (who[1:] != who[:-1]) | (np.diff(diagonal) > 2 * reach[1:]))
            firsts = np.flatnonzero(opens)
            lasts = np.append(firsts[1:], len(who)) - 1
            for a, z in zip(firsts.tolist(), lasts.tolist(), strict=True):
                i = int(who[a])
                if z - a + 1 < self.needed[i] or len(np.unique(held[a : z + 1])) < self.needed[i]:
                    continue
                k = int(self.edits[i])
                yield i, max(0, int(diagonal[a]) - k), min(len(text), int(diagonal[z]) + int(self.sizes[i]) + k)

    def found(self, text: str, least: float) -> list[tuple[int, float, int, int]]:
        """Passage, ratio, start and end (in the normal form) of the best place of each that is there."""
        return self.found_in([text], least)[0]

    def found_in(self, texts: list[str], least: float) -> list[list[tuple[int, float, int, int]]]:
        """``found`` of each text."""
        out, held, pairs = [], [], []
        for text in texts:
            signs = codes(text)
            held.append(list(self.windows(signs)))
            for i, a, z in held[-1]:
                if i not in self.patterns:
                    self.patterns[i] = Pattern(self.signs[i])
                pairs.append((self.patterns[i], signs[a:z]))
        near = iter(distances(pairs).tolist())
        for text, windows in zip(texts, held, strict=True):
            best: dict[int, tuple] = {}
            for i, a, z in windows:
                n, k = int(self.sizes[i]), int(self.edits[i])
                if i in best and not best[i][0]:
                    k = 0
                if next(near) > k:
                    continue
                d, s, e = semi_global(self.texts[i], text[a:z])
                key = (d, abs(e - s - n), a + e)
                if 1 - d / max(n, e - s, 1) >= least - EPSILON and (i not in best or key < best[i][:3]):
                    best[i] = (*key, a + s)
            out.append([(i, 1 - d / max(int(self.sizes[i]), e - s, 1), s, e) for i, (d, _, e, s) in best.items()])
        return out


def locate(needles: DataFrame, hays: DataFrame, least: float = VARIANT) -> DataFrame:
    """needle, hay, ratio, start, end of the needles (id, text) found in hays (id, text), each at its best place.

    start and end are places in the hay's own text. Needles without letters or digits are found nowhere."""
    spark = hays.sparkSession
    ship(spark)
    if least < VARIANT - EPSILON:
        raise ValueError(f"places with a ratio under {VARIANT} can't be found for certain")
    kinds = {"needle": dict(needles.dtypes)["id"], "hay": dict(hays.dtypes)["id"]}
    ddl = f"needle {kinds['needle']}, hay {kinds['hay']}, ratio double, start long, `end` long"
    kind = to_arrow_type(needles.schema["id"].dataType)
    size = needles.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK) or 1
    dealt = needles.select("id", "text", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block"))
    out = None
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).collect()
        part = hays.select("id", "text").mapInArrow(_pass([r["id"] for r in rows], [r["text"] for r in rows], kind, least), ddl)
        out = part if out is None else out.union(part)
    return out


def _pass(ids: list, texts: list[str], kind: pa.DataType, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needles = Needles(texts)
        for b in batches:
            own: list[tuple] = []
            norms, sources, hays = [], [], []

            def look(norms=norms, sources=sources, hays=hays, own=own):
                for hay, places, found in zip(hays, sources, needles.found_in(norms, least), strict=True):
                    own += [(ids[i], hay, round(ratio, 4), int(places[s]), int(places[e - 1]) + 1) for i, ratio, s, e in found if e > s]
                for x in (norms, sources, hays):
                    x.clear()

            signs = 0
            for hay, text in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                norm, places = normal_form(text or "", PLAIN)
                norms.append(norm)
                sources.append(places)
                hays.append(hay)
                signs += len(norm)
                if signs >= GATHER:
                    look()
                    signs = 0
            look()
            columns = list(zip(*own, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], b["id"].type), *(pa.array(c, t) for c, t in zip(columns[2:], (pa.float64(), pa.int64(), pa.int64()), strict=True))], ["needle", "hay", "ratio", "start", "end"])

    return run
