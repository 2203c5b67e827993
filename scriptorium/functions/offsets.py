"""Normal forms that know where each of their signs stood.

A normal form keeps letters, digits and private-use signs, folded; beside it goes a
run-length map: runs (at, src, n) say that n signs of the form from ``at`` stood one
after another in the source from ``src``. Signs are code points on both sides. The map is
made in one vectorised pass over Arrow batches (a sign's form is looked up once for each
distinct sign of a text), and is read, both ways, by column functions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import resolve_variants
from scriptorium.shipping import ship, small_batches

#: Signs that stand for a lost glyph, and for one that may be lost.
STRICT, LOOSE = "\ue000", "\ue001"
# Blocks of compatibility signs, which are folded by NFKC before they are compared.
COMPATIBLE = ((0xF900, 0xFAFF), (0x2F800, 0x2FA1F), (0x2F00, 0x2FDF), (0xFF00, 0xFFEF))
KEPT = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Nl", "No", "Co"}


@dataclass(frozen=True)
class Form:
    """What a normal form does: ``compatible`` folds full-width and other compatibility signs, ``notes`` leaves out bracketed notes, ``drop``, ``strict`` and ``loose`` are patterns of what goes and of what becomes a wildcard."""

    lower: bool = False
    compatible: bool = True
    notes: bool = False
    drop: str | None = None
    strict: str | None = None
    loose: str | None = None
    variants: tuple[tuple[str, str], ...] = ()
    _signs: dict = field(default_factory=dict, compare=False, repr=False)

    def sign(self, code: int) -> str:
        """What becomes of one sign: nothing, one sign or several."""
        if code not in self._signs:
            if "variants" not in self._signs:
                self._signs["variants"] = resolve_variants(list(self.variants))
            c = chr(code)
            if self.compatible and any(a <= code <= b for a, b in COMPATIBLE):
                c = unicodedata.normalize("NFKC", c)
            if self.lower:
                c = "".join(x.lower() if len(x.lower()) == 1 else x for x in c)
            c = "".join(self._signs["variants"].get(x, x) for x in c)
            self._signs[code] = "".join(x for x in c if unicodedata.category(x) in KEPT)
        return self._signs[code]


def _note_spans(text: str) -> Iterator[tuple[int, int]]:
    """Bracketed notes; a bracket without a partner is a sign like others."""
    opened = []
    for m in re.finditer(r"[()（）]", text):
        if m[0] in "(（":
            opened.append(m.start())
        elif opened:
            yield opened.pop(), m.end()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def normal_form(text: str, form: Form) -> tuple[str, np.ndarray]:
    """The form of a text, and the source place of each of its signs."""
    source = codes(text)
    gone = np.zeros(len(source) + 1, dtype=np.int32)
    wild: dict[int, str] = {}
    for pattern, sign in ((form.strict, STRICT), (form.loose, LOOSE)):
        for m in re.finditer(pattern, text) if pattern else ():
            if m.end() > m.start():
                wild[m.start()] = sign
                gone[m.start()] += 1
                gone[m.end()] -= 1
    spans = [(m.start(), m.end()) for m in re.finditer(form.drop, text)] if form.drop else []
    for a, b in [*spans, *(_note_spans(text) if form.notes else ())]:
        gone[a] += 1
        gone[b] -= 1
    distinct, which = np.unique(source, return_inverse=True)
    forms = [form.sign(int(c)) for c in distinct]
    sizes = np.array([len(f) for f in forms], dtype=np.int64)[which] if len(forms) else np.zeros(0, dtype=np.int64)
    sizes[np.cumsum(gone)[:-1] > 0] = 0
    if len(sizes) and sizes.max(initial=0) <= 1:
        first = np.array([ord(f) if f else 0 for f in forms], dtype=np.uint32)
        kept = np.flatnonzero(sizes)
        out, places = first[which[kept]], kept
    else:
        places = np.repeat(np.arange(len(source)), sizes)
        out = codes("".join(forms[which[i]] for i in np.flatnonzero(sizes)))
    if wild:
        at = np.array(sorted(wild), dtype=np.int64)
        where = np.searchsorted(places, at)
        out = np.insert(out, where, [ord(wild[int(i)]) for i in at])
        places = np.insert(places, where, at)
    return out.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass"), places.astype(np.int64)


def runs_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """at, src and n of the runs."""
    starts = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    return starts, places[starts], np.diff(np.append(starts, len(places)))


def with_offsets(df: DataFrame, text: str, form: Form = Form()) -> DataFrame:  # noqa: B008
    """df with ``norm`` and ``runs`` of a text column; a null text has the form of an empty one."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    kind = pa.list_(pa.struct([("at", pa.int32()), ("src", pa.int32()), ("n", pa.int32())]))
    held = [f"_c{i}" for i in range(len(df.columns))]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norms, sizes, parts = [], [], []
            for t in b.column(at).to_pylist():
                norm, places = normal_form(t or "", form)
                found = runs_of(places)
                norms.append(norm)
                sizes.append(len(found[0]))
                parts.append(found)
            flat = [np.concatenate([p[i] for p in parts]).astype(np.int32) if parts else np.zeros(0, np.int32) for i in range(3)]
            offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
            runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(f) for f in flat], ["at", "src", "n"]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norms, pa.string()), runs.cast(kind)], [*held, "norm", "runs"])

    kinds = ", ".join(f"{h} {t}" for h, (_, t) in zip(held, df.dtypes, strict=True))
    out = df.toDF(*held).mapInArrow(run, f"{kinds}, norm string, runs array<struct<at: int, src: int, n: int>>")
    return out.toDF(*df.columns, "norm", "runs")


def worked_out(value: Column, f) -> Column:
    """f of a value that is worked out once; in a lambda it would be worked out for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def to_source(runs: Column, at: Column) -> Column:
    """The source place of the sign at a place of the normal form (from 0); null outside."""

    def place(p: Column) -> Column:
        r = F.try_element_at(F.filter(runs, lambda x: x["at"] <= p), F.lit(-1))
        last = F.try_element_at(runs, F.lit(-1))
        return F.when((F.size(runs) > 0) & (p >= 0) & (p < last["at"] + last["n"]), r["src"] + p - r["at"])

    return worked_out(at, place)


def span_to_source(runs: Column, start: Column, end: Column) -> Column:
    """start and end in the source of a span of the normal form that isn't empty."""
    return F.struct(to_source(runs, start).alias("start"), (to_source(runs, end - 1) + 1).alias("end"))


def to_normal(runs: Column, src: Column) -> Column:
    """The place in the normal form of the first sign that stood at a source place or after it; the form's length if there is none."""

    def place(p: Column) -> Column:
        r = F.get(F.filter(runs, lambda x: x["src"] + x["n"] > p), F.lit(0))
        last = F.try_element_at(runs, F.lit(-1))
        return F.when(F.size(runs) == 0, 0).when(last["src"] + last["n"] <= p, last["at"] + last["n"]).otherwise(r["at"] + F.greatest(F.lit(0), p - r["src"]))

    return worked_out(src, place)
