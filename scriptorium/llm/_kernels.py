"""Vectorised word kernels: numpy over the bytes of a batch of texts.

Words are runs without ASCII white space, with A-Z lower-cased. A word's hash
is a polynomial in its bytes over 64-bit integers, finished by a mixer.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)


def _hash_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of a block."""
    global _POWERS
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    longest = int((ends - starts).max())
    if longest > len(_POWERS):
        _POWERS = _powers(2 * longest)
    at = np.flatnonzero(inside)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    relative = np.arange(len(at)) - np.repeat(firsts, lengths)
    values = (_LOWER[raw[at]].astype(np.uint64) + np.uint64(1)) * _POWERS[relative]
    return mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64)), starts


def _pieces(text: bytes) -> list[bytes]:
    """A text in pieces of about BLOCK bytes, cut at white space."""
    if len(text) <= 2 * BLOCK:
        return [text]
    out, at = [], 0
    while at < len(text):
        cut = at + BLOCK
        while cut < len(text) and text[cut] not in b" \t\n\x0b\x0c\r":
            cut += 1
        out.append(text[at:cut])
        at = cut
    return out


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's begin (one more than texts)."""
    counts = np.zeros(len(texts), dtype=np.int64)
    found: list[np.ndarray] = []
    held: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, owners, size
        hashes, starts = _hash_block(b"\n".join(held))
        begins = np.cumsum([0, *(len(x) + 1 for x in held)])
        np.add.at(counts, owners, np.diff(np.searchsorted(starts, begins)))
        found.append(hashes)
        held, owners, size = [], [], 0

    for i, text in enumerate(texts):
        if not text:
            continue
        for piece in _pieces(text.encode("utf-8", "surrogatepass")):
            held.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= BLOCK:
                flush()
    if held:
        flush()
    return (np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word windows. A text of fewer words has its whole sequence as one; without words, none."""
    hashes, begins = word_hashes(texts)
    rolled = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
    for j in range(width):
        rolled = mix(rolled * np.uint64(3) + hashes[j : j + len(rolled)])
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    whole = mix(np.asarray(whole * np.uint64(5) + h))[()]
            out.append(np.array([whole], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
