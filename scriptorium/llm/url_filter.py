"""URL filters: a sorted array of 64-bit digests, memory-mapped by the executors.

The stored entries (host, path prefix, verdict) are hashed with xxHash64. The
index file holds the sorted digests, and beside each the place of the full
string. A batch of urls yields its candidate entries (each suffix of the host of
as many labels as some entry has, with each stored path length), whose digests are probed by vectorised binary
search; a hit counts only if the stored full string is equal, so collisions of
digests never decide.

Defined cases: a null url or one without ``://`` has an empty host and path and
fits no entry; repeated urls are judged alike; an empty table gives an empty
result; columns of the input other than ``page_id`` and ``url`` are ignored. An
entry fits its host and the subdomains, if the url's path starts with the
entry's path. The longest entry wins, then the one with the longer host. A url
without an entry gets ``default``.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm._common import arrow_batches, ship

#: (host, path, verdict).
DEFAULT_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


class DigestArray:
    """Sorted 64-bit digests of strings with the full strings beside them."""

    PARTS = ("keys", "ends", "verdicts", "blob", "lengths", "labels")

    def __init__(self, files: list[str]):
        """files: those that build() returned, wherever they are now."""
        self.keys, self.ends, self.verdicts, self.blob, self.lengths, self.labels = (np.load(f, mmap_mode="r") for f in files)

    @classmethod
    def build(cls, entries: list[tuple[str, str, str]], folder: str | Path, name: str) -> list[Path]:
        """Writes the array's files. A later entry replaces an earlier one with the same host and path."""
        held = {(host.lower() + path).encode(): (verdict == "allow", len(path)) for host, path, verdict in entries}
        rows = sorted((xxhash.xxh64_intdigest(s), s, allow) for s, (allow, _) in held.items())
        parts = [
            np.array([r[0] for r in rows], dtype=np.uint64),
            np.cumsum([0, *(len(r[1]) for r in rows)], dtype=np.int64),
            np.array([r[2] for r in rows], dtype=bool),
            np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint8),
            np.array(sorted({n for _, n in held.values()}), dtype=np.int64),
            np.array(sorted({host.count(".") + 1 for host, _, _ in entries}), dtype=np.int64),
        ]
        files = [Path(folder) / f"{name}-{p}.npy" for p in cls.PARTS]
        for file, part in zip(files, parts, strict=True):
            np.save(file, part)
        return files

    def stored(self, k: int) -> bytes:
        return self.blob[self.ends[k] : self.ends[k + 1]].tobytes()

    def find(self, strings: list[bytes]) -> np.ndarray:
        """The place of each string, or -1."""
        asked = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), dtype=np.uint64, count=len(strings))
        at = np.searchsorted(self.keys, asked)
        found = np.full(len(strings), -1, dtype=np.int64)
        for i in np.nonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == asked)[0] if len(self.keys) else ():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == asked[i]:
                if self.stored(k) == strings[i]:
                    found[i] = k
                    break
                k += 1
        return found


def _candidates(host: str, path: str, lengths: list[int], labels: list[int]) -> list[bytes]:
    """The entries that could fit; as many as pairs of stored lengths and label counts, however long the host is."""
    if not host or not labels:
        return []
    last = host.rsplit(".", labels[-1])
    held = len(last) if len(last) <= labels[-1] else labels[-1]
    suffixes = [".".join(last[-n:]) for n in labels if n <= held]
    return [(s + path[:n]).encode() for n in lengths if n <= len(path) for s in suffixes]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages."""
    spark: SparkSession = pages.sparkSession
    ship(spark)
    arrow_batches(spark, 10_000)
    name = f"urls-{uuid.uuid4().hex}"
    files = DigestArray.build(DEFAULT_RULES if rules is None else rules, tempfile.mkdtemp(prefix="scriptorium-urls-"), name)
    for f in files:
        spark.sparkContext.addFile(str(f))
    names = [f.name for f in files]

    def probe(batches):
        index = DigestArray([SparkFiles.get(n) for n in names])
        lengths, labels = index.lengths.tolist(), index.labels.tolist()
        for b in batches:
            flat: list[bytes] = []
            counts = []
            for host, path in zip(b["host"].to_pylist(), b["path"].to_pylist(), strict=True):
                own = _candidates(host, path, lengths, labels)
                flat += own
                counts.append(len(own))
            found = index.find(flat)
            rule: list[str | None] = []
            verdict: list[str] = []
            at = 0
            for n in counts:
                hits = [k for k in found[at : at + n].tolist() if k >= 0]
                at += n
                if hits:
                    best = max(hits, key=lambda k: (len(s := index.stored(k)), s.find(b"/") if b"/" in s else len(s)))
                    rule.append(index.stored(best).decode())
                    verdict.append("allow" if index.verdicts[best] else "block")
                else:
                    rule.append(None)
                    verdict.append(default)
            yield pa.RecordBatch.from_arrays([b["page_id"], b["host"], b["path"], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parsed = pages.select("page_id", host.alias("host"), F.regexp_extract(tail, r"^[^?#]*", 0).alias("path"))
    kind = dict(pages.dtypes)["page_id"]
    return parsed.mapInArrow(probe, f"page_id {kind}, host string, path string, rule string, verdict string")


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), j AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
