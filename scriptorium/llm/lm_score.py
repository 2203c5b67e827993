"""Stupid-backoff scores of documents under bigram counts of all documents.

The score of a word w after v is count(v w) / count(v) if the pair occurs
``least_count`` times or more in the corpus, else ALPHA * count(w) / N; a text's first
word has count(w) / N, where N is the number of words of the corpus. A
document's score is the sum of the logarithms.

Count tables are partitioned by hash and joined to the exploded n-grams, whose
contributions are summed per document:

* Unigram counts are a table by word hash. The ``KNOWN`` most frequent are also
  broadcast; what needs another word's count is joined with the table.
* Pairs of the ``FREQUENT`` most frequent words are counted by partial sums and
  scored where they stand, from a broadcast square table. Any other pair
  holds a word outside these, and so less than one in FREQUENT of all words,
  which bounds what a single pair can bring to a partition.
* All other pairs go, packed by unit (a run of documents of one task) with a
  dictionary of the unit's words, to the partition of their hash. There they are
  counted and, in the same place, joined to the counts and summed per document.

Words are lower-cased (A-Z) runs without ASCII white space and are identified by 64-bit
hashes.

Defined cases: null and blank texts have no words and a null score; repeated rows
are scored each and count each; an empty table gives an empty result; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scriptorium.llm._common import arrow_batches, extreme, materialise, ship
from scriptorium.llm._kernels import mix, word_hashes

ALPHA = 0.4
#: How often a pair occurs in the corpus to count as seen. The scored texts are in the corpus
#: themselves, so with 1 nothing would ever back off.
LEAST_COUNT = 2
KNOWN = 1 << 17
FREQUENT = 1 << 10
UNIT_WORDS = 2_000_000
PARTITION_PAIRS = 2_000_000

_OUT = "unit long, docs array<struct<doc_id:{id},n:long,score:double>>, doc array<int>, score array<double>, ask_doc array<int>, ask_word array<long>, ask_sign array<int>"


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a * np.uint64(3)) + b)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _units(batches):
    """Runs of documents with about UNIT_WORDS words: number, ids, hashes, begins."""
    part = TaskContext.get().partitionId()
    count, ids, held, begins, size = 0, [], [], [np.zeros(1, dtype=np.int64)], 0
    for b in batches:
        texts, own = b["text"].to_pylist(), b["doc_id"].to_pylist()
        first = 0
        while first < len(texts):
            last, chars = first, 0
            while last < len(texts) and (last == first or chars < 4_000_000):
                chars += len(texts[last] or "")
                last += 1
            h, at = word_hashes(texts[first:last])
            ids += own[first:last]
            held.append(h)
            begins.append(at[1:] + size)
            size += len(h)
            first = last
            if size >= UNIT_WORDS:
                yield (part << 24) + count, ids, np.concatenate(held), np.concatenate(begins)
                count, ids, held, begins, size = count + 1, [], [], [np.zeros(1, dtype=np.int64)], 0
    if ids:
        yield (part << 24) + count, ids, np.concatenate(held), np.concatenate(begins)


def unigrams(docs: DataFrame) -> DataFrame:
    """word (hash), n of every word."""

    def run(batches):
        for b in batches:
            w, n = np.unique(word_hashes(b["text"].to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent_pairs(docs: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """Counts of the pairs of frequent words, as a square table."""
    given = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        table = given.value
        counts = np.zeros(max(1, len(table)) ** 2, dtype=np.int64)
        for b in batches:
            h, begins = word_hashes(b["text"].to_pylist())
            if len(h) < 2 or not len(table):
                continue
            at = _find(table, h)
            both = (at[:-1] >= 0) & (at[1:] >= 0)
            cross = begins[1:-1]
            both[cross[(cross > 0) & (cross < len(h))] - 1] = False
            counts += np.bincount(at[:-1][both] * len(table) + at[1:][both], minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen])], ["pair", "n"])

    out = np.zeros((len(frequent), len(frequent)), dtype=np.int64)
    for r in docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[divmod(r["pair"], len(frequent))] = r["n"]
    return out


def _pack(a: np.ndarray, b: np.ndarray, doc: np.ndarray, unknown: np.ndarray) -> bytes:
    """Pairs of codes with their documents. A code is a word's place among the
    known words, which all tasks have, or KNOWN more than its place in ``unknown``."""
    codes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    kind = np.uint16 if len(codes) <= 1 << 16 else np.uint32
    split = int(np.searchsorted(codes, KNOWN))
    head = np.array([split, len(codes) - split, len(a), np.dtype(kind).itemsize], dtype=np.int64)
    small = np.diff(codes[:split], prepend=0).astype(np.uint32).tobytes() + at[: len(a)].astype(kind).tobytes() + at[len(a) :].astype(kind).tobytes() + np.diff(doc, prepend=0).astype(np.uint32).tobytes()
    return head.tobytes() + unknown[codes[split:] - KNOWN].tobytes() + zstandard.compress(small, 1)


def _unpack(blob: bytes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of first and second words, their places among the known words (or -1), documents."""
    n_known, n_rest, n, item = np.frombuffer(blob[:32], dtype=np.int64).tolist()
    rest = np.frombuffer(blob[32 : 32 + 8 * n_rest], dtype=np.uint64)
    small = zstandard.decompress(blob[32 + 8 * n_rest :])
    places = np.concatenate([np.cumsum(np.frombuffer(small[: 4 * n_known], dtype=np.uint32), dtype=np.int64), np.full(n_rest, -1)])
    hashes = np.concatenate([words[places[:n_known]], rest])
    at = np.frombuffer(small[4 * n_known : 4 * n_known + 2 * n * item], dtype=np.uint16 if item == 2 else np.uint32)
    doc = np.cumsum(np.frombuffer(small[4 * n_known + 2 * n * item :], dtype=np.uint32), dtype=np.int64)
    return hashes[at[:n]], hashes[at[n:]], places[at[:n]], places[at[n:]], doc


class _Counts:
    """Logarithms of the counts of known words, by place."""

    def __init__(self, words: np.ndarray, logs: np.ndarray, total: float):
        self.words, self.log_total = words, math.log(total)
        self.logs = np.append(logs, 0.0)  # the last for what isn't known


def score(docs: DataFrame, known_words: int = KNOWN, frequent_words: int = FREQUENT, least_count: int = LEAST_COUNT) -> DataFrame:
    """doc_id, n_words, log_score, mean_log of every row; the result doesn't depend on how many words are known or frequent."""
    spark = docs.sparkSession
    ship(spark)
    arrow_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text")
    table = materialise(unigrams(docs), "unigrams")
    total = table.agg(F.sum("n")).first()[0] or 0
    top = sorted((r["word"] & (1 << 64) - 1, r["n"]) for r in extreme(table, "n", known_words).collect())
    words = np.array([w for w, _ in top], dtype=np.uint64)
    counts = np.array([n for _, n in top], dtype=np.float64)
    most = np.sort(np.argsort(-counts, kind="stable")[:frequent_words])
    frequent = words[most]
    square = _frequent_pairs(docs, frequent)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_PAIRS))
    sc = spark.sparkContext
    known = sc.broadcast(_Counts(words, np.log(np.maximum(counts, 1)), max(total, 1)))
    logs = np.where(square >= least_count, np.log(np.maximum(square, 1)) - np.log(np.maximum(counts[most], 1))[:, None], (math.log(ALPHA) + np.log(np.maximum(counts[most], 1)) - math.log(max(total, 1)))[None, :])
    ranks = np.full(len(words) + 1, -1, dtype=np.int64)
    ranks[most] = np.arange(len(most))
    local = sc.broadcast((ranks, logs))

    def explode(batches):
        held, (ranks, logs) = known.value, local.value
        for unit, ids, h, begins in _units(batches):
            n_docs = len(ids)
            doc = np.repeat(np.arange(n_docs), np.diff(begins))
            scores = np.zeros(n_docs)
            full = np.flatnonzero(np.diff(begins))
            place = _find(held.words, h)
            at_first = begins[:-1][full]
            scores[full] += held.logs[place[at_first]] - held.log_total
            asked = place[at_first] < 0
            asks = (full[asked], h[at_first[asked]])
            unknown, code = np.unique(h[place < 0], return_inverse=True)
            codes = place.copy()
            codes[place < 0] = KNOWN + code
            d = doc[:-1]
            same = doc[:-1] == doc[1:]
            at = np.where(place >= 0, ranks[place], -1)
            near = same & (at[:-1] >= 0) & (at[1:] >= 0)
            if near.any():
                scores += np.bincount(d[near], weights=logs[at[:-1][near], at[1:][near]], minlength=n_docs)
            far = np.flatnonzero(same & ~near)
            a, b, d = codes[far], codes[far + 1], d[far]
            pid = ((_pair_keys(h[far], h[far + 1]) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(pid, kind="stable")
            cuts = np.searchsorted(pid[order], np.arange(parts + 1))
            base = {"pid": -1 - unit % parts, "unit": unit, "docs": [{"doc_id": i, "n": int(n), "score": float(s)} for i, n, s in zip(ids, np.diff(begins), scores, strict=True)], "blob": _pack_asks(*asks)}
            yield pa.RecordBatch.from_pylist([base], schema)
            for p in range(parts):
                if cuts[p + 1] > cuts[p]:
                    o = order[cuts[p] : cuts[p + 1]]
                    yield pa.RecordBatch.from_pylist([{"pid": p, "unit": unit, "docs": None, "blob": _pack(a[o], b[o], d[o], unknown)}], schema)

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    docs_type = pa.list_(pa.struct([("doc_id", id_type), ("n", pa.int64()), ("score", pa.float64())]))
    schema = pa.schema([("pid", pa.int32()), ("unit", pa.int64()), ("docs", docs_type), ("blob", pa.binary())])
    out_schema = pa.schema([("unit", pa.int64()), ("docs", docs_type), ("doc", pa.list_(pa.int32())), ("score", pa.list_(pa.float64())), ("ask_doc", pa.list_(pa.int32())), ("ask_word", pa.list_(pa.int64())), ("ask_sign", pa.list_(pa.int32()))])

    def count(group):
        held = known.value
        if group["pid"][0].as_py() < 0:
            rows = []
            for r in group.to_pylist():
                doc, word = _unpack_asks(r["blob"])
                rows.append({"unit": r["unit"], "docs": r["docs"], "doc": None, "score": None, "ask_doc": doc, "ask_word": word.view(np.int64), "ask_sign": np.ones(len(doc), dtype=np.int32)})
            return pa.Table.from_pylist(rows, out_schema)
        parts_of = [_unpack(x, held.words) for x in group["blob"].to_pylist()]
        a, b, at_a, at_b = (np.concatenate([x[k] for x in parts_of]) for k in range(4))
        _, at, n = np.unique(_pair_keys(a, b), return_inverse=True, return_counts=True)
        n = n[at]
        seen = n >= least_count
        words, place = np.where(seen, a, b), np.where(seen, at_a, at_b)
        log = held.logs[place]
        gain = np.where(seen, np.log(n) - log, math.log(ALPHA) + log - held.log_total)
        rows, first = [], 0
        for unit, x in zip(group["unit"].to_pylist(), parts_of, strict=True):
            d = x[4]
            own = slice(first, first + len(d))
            first += len(d)
            cut = np.flatnonzero(np.diff(d, prepend=-1))
            miss = place[own] < 0
            rows.append({"unit": unit, "docs": None, "doc": d[cut], "score": np.add.reduceat(gain[own], cut), "ask_doc": d[miss], "ask_word": words[own][miss].view(np.int64), "ask_sign": np.where(seen[own][miss], -1, 1)})
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], out_schema.field(c).type) for c in out_schema.names], schema=out_schema)

    def total_up(group):
        """The documents of a unit with all that was summed for them."""
        docs_of = next(x for x in group["docs"].to_pylist() if x is not None)
        sums = np.array([x["score"] for x in docs_of])
        doc, part = group["doc"].combine_chunks().flatten().to_numpy(), group["score"].combine_chunks().flatten().to_numpy()
        sums += np.bincount(doc, weights=part, minlength=len(sums))
        return pa.Table.from_arrays([pa.array([x["doc_id"] for x in docs_of], id_type), pa.array([x["n"] for x in docs_of], pa.int64()), pa.array(sums)], names=["doc_id", "n_words", "s"])

    packed = docs.mapInArrow(explode, f"pid int, unit long, docs array<struct<doc_id:{kind},n:long,score:double>>, blob binary")
    made = materialise(packed.repartition(parts, "pid").groupBy("pid").applyInArrow(count, _OUT.format(id=kind)), "scores")
    asks = made.select("unit", F.explode(F.arrays_zip("ask_doc", "ask_word", "ask_sign")).alias("x")).select("unit", F.col("x.ask_doc").alias("doc"), F.col("x.ask_word").alias("word"), F.col("x.ask_sign").alias("sign"))
    answers = asks.join(table, "word").groupBy("unit", "doc").agg(F.sum(F.col("sign") * F.log("n")).alias("score"))
    answers = answers.select("unit", F.lit(None).cast(dict(made.dtypes)["docs"]).alias("docs"), F.array("doc").alias("doc"), F.array("score").alias("score"))
    rows = made.select("unit", "docs", "doc", "score").unionByName(answers)
    out = rows.groupBy("unit").applyInArrow(total_up, f"doc_id {kind}, n_words long, s double")
    full = F.col("n_words") > 0
    return out.select("doc_id", "n_words", F.when(full, F.round("s", 4)).alias("log_score"), F.when(full, F.round(F.col("s") / F.col("n_words"), 6)).alias("mean_log"))


def _pack_asks(doc: np.ndarray, word: np.ndarray) -> bytes:
    return doc.astype(np.int64).tobytes() + word.astype(np.uint64).tobytes()


def _unpack_asks(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    doc, word = np.frombuffer(blob, dtype=np.uint64).reshape(2, -1)
    return doc.astype(np.int32), word


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), t AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d
), u AS (
  SELECT w, count(*) AS n FROM t GROUP BY 1
), total AS (
  SELECT count(*) AS n FROM t
), g AS (
  SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v FROM t
), b AS (
  SELECT v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY 1, 2
), s AS (
  SELECT g.r, CASE WHEN g.v IS NULL THEN ln(uw.n / total.n) WHEN b.n >= 2 THEN ln(b.n / uv.n) ELSE ln(0.4 * uw.n / total.n) END AS score
  FROM g CROSS JOIN total JOIN u AS uw ON uw.w = g.w LEFT JOIN u AS uv ON uv.w = g.v LEFT JOIN b ON b.v = g.v AND b.w = g.w
), p AS (
  SELECT r, sum(score) AS s FROM s GROUP BY 1
)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(p.s, 4) AS log_score, round(p.s / len(ws), 6) AS mean_log FROM d LEFT JOIN p USING (r)
"""
