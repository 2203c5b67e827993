"""Byte-level BPE encoding and decoding.

The rank file gives each token's bytes and rank. From it comes a literal rank
map over pairs of token ids: an array of small maps, indexed by a hash of the
pair, so that a look-up costs the same however large the vocabulary is. A word
starts as the ids of its bytes; a fold by higher-order functions merges the
leftmost pair of lowest rank until none is left, as the tokenizer's own merge
loop does.

The distinct words of all texts are counted, and the most frequent of those that
are no token themselves, ``hot_words`` at most, are folded once. They and the
tokens make up a table from word to ids of a proven bound (``hot_words`` words
of at most ``HOT_CHARS`` code points), which is broadcast. Encoding looks words
up in it. A fold costs about 0.1 ms a word in Spark's interpreter, so words
outside the table, most of which occur once, are merged by a heap of the same
rule where they stand (n log n for words of any length). No text is shuffled,
and the result doesn't depend on which words are in the table.

Decoding concatenates the binary pieces of the ids, again by higher-order
functions.

Defined cases: null and empty texts have no ids and decode to empty bytes;
repeated rows are each encoded; an empty table gives an empty result; special
tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import struct
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm._common import arrow_batches, extreme, materialise, ship

#: Unicode's white space.
_SPACE = r"\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

HOT_WORDS = 1 << 17
HOT_CHARS = 64
#: A word that occurs once gains nothing by being folded apart from its text.
HOT_LEAST = 2
PAIR_BUCKETS = 1 << 16
#: No rank.
NONE = (1 << 62)


def exact_pattern(pattern: str, space: str = _SPACE) -> str:
    """The pattern with the tokenizer's white space spelled out."""
    out = pattern.replace(r"[^\s", f"[^{space}")
    return out.replace(r"\s", f"[{space}]").replace(r"(?!\S)", f"(?![^{space}])")


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pairs(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left id, right id, merged id) of every pair whose bytes together are a token."""
    out = []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                out.append((left, right, rank))
    return out


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word of any length in n log n steps."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    end, alive = [*range(1, n + 1)], [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (s := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (s, i, end[after[i]]))
        if (p := before[i]) >= 0 and (s := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (s, p, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def literal(df: DataFrame) -> Column:
    """The one value of a one-row table as a literal of the plan."""
    rows = df._jdf.queryExecution().executedPlan().executeCollect()
    kind = df._jdf.schema().apply(0).dataType()
    jvm = df.sparkSession._jvm
    value = rows[0].get(0, kind)
    expr = jvm.org.apache.spark.sql.catalyst.expressions.Literal(value, kind)
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expr))


class Codec:
    """Literal tables of one rank file in a session."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.spark, self.path, self.ranks, self.pattern = spark, path, load_ranks(path), exact_pattern(pattern)
        if len(set(self.ranks.values())) != len(self.ranks) or any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the rank file needs distinct ranks and all single bytes")
        buckets: list[dict] = [{} for _ in range(PAIR_BUCKETS)]
        for a, b, c in pairs(self.ranks):
            buckets[(a * 31337 + b) % PAIR_BUCKETS][a << 32 | b] = c
        pieces: list[str | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            pieces[rank] = token.hex()
        tables = spark.createDataFrame([(buckets, [self.ranks[bytes([b])] for b in range(256)], pieces)], "pair array<map<bigint,bigint>>, byte array<bigint>, piece array<string>")
        self.pair, self.byte, self.piece = (literal(tables.select(c)) for c in tables.columns)

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def _rank(self, a: Column, b: Column) -> Column:
        """The rank of two neighbours, NONE if their bytes together are no token."""
        place = ((a * 31337 + b) % PAIR_BUCKETS).cast("int")
        return F.coalesce(F.get(self.pair, place)[a * 4294967296 + b], F.lit(NONE))

    def fold(self, word: Column) -> Column:
        """Ids of a word by merging the leftmost pair of lowest rank, again and again.

        The state holds ids and, beside each but the last, the rank of the pair
        it begins; a merge renews the two ranks around it.
        """
        chars = F.filter(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: c != "")
        start = F.transform(F.array(F.transform(chars, lambda c: F.get(self.byte, F.ascii(c)))), lambda ids: F.struct(ids.alias("ids"), F.zip_with(ids, F.slice(ids, F.lit(2), F.size(ids)), lambda a, b: F.when(b.isNull(), NONE).otherwise(self._rank(a, b))).alias("ranks")))

        def merge(held: Column, rank: Column, i: Column) -> Column:
            ids, ranks = held["ids"], held["ranks"]
            before = F.when(i > 1, F.concat(F.slice(ranks, F.lit(1), i - 2), F.array(self._rank(F.get(ids, i - 2), rank)))).otherwise(F.slice(ranks, F.lit(1), F.lit(0)))
            after = F.when(i + 2 > F.size(ids), F.lit(NONE)).otherwise(self._rank(rank, F.get(ids, i + 1)))
            return F.struct(
                F.concat(F.slice(ids, F.lit(1), i - 1), F.array(rank), F.slice(ids, i + 2, F.size(ids))).alias("ids"),
                F.concat(before, F.array(after), F.slice(ranks, i + 2, F.size(ids))).alias("ranks"),
            )

        def step(held: Column, _: Column) -> Column:
            best = F.array(F.array_min(held["ranks"]))
            return F.get(F.transform(best, lambda r: F.when(r == NONE, held).otherwise(merge(held, r.cast("bigint"), F.array_position(held["ranks"], r).cast("int")))), F.lit(0))

        rounds = F.sequence(F.lit(2), F.greatest(F.octet_length(word), F.lit(2)))
        return F.aggregate(rounds, F.get(start, F.lit(0)), step, lambda held: held["ids"])

    def hot(self, docs: DataFrame, hot_words: int = HOT_WORDS) -> dict[str, bytes]:
        """Packed ids of the most frequent words of docs that are no tokens."""
        counted = docs.select(F.explode(self.words(F.col("text"))).alias("w")).groupBy("w").count()
        tokens = [(t,) for t in {*map(_as_text, self.ranks)} - {None}]
        known = self.spark.createDataFrame(tokens, "w string")
        fit = counted.where((F.char_length("w") <= HOT_CHARS) & (F.col("count") >= HOT_LEAST)).join(F.broadcast(known), "w", "left_anti")
        best = extreme(materialise(fit, "word-counts"), "count", hot_words)
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return {r["w"]: pack(r["ids"]) for r in best.select("w").repartition(parts, "w").select("w", self.fold(F.col("w")).alias("ids")).collect()}

    def encode(self, docs: DataFrame, hot_words: int = HOT_WORDS) -> DataFrame:
        """docs with the columns n_tokens, ids (array of int) and packed (ids as little-endian unsigned 32-bit integers); own columns of these names are replaced."""
        docs = docs.drop("n_tokens", "ids", "packed")
        ship(self.spark)
        arrow_batches(self.spark, 1000)
        ranks = self.spark.sparkContext.broadcast(self.ranks)
        hot = self.spark.sparkContext.broadcast(self.hot(docs, hot_words))
        pattern = self.pattern
        names = [f"_c{i}" for i in range(len(docs.columns))]
        kinds = [f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True)]
        at = docs.columns.index("text")

        def run(batches):
            split, table, known = regex.compile(pattern).findall, ranks.value, hot.value
            first = {w: pack([r]) for t, r in table.items() if (w := _as_text(t)) is not None} | known
            rest: dict[str, bytes] = {}

            def ids(w: str) -> bytes:
                found = rest.get(w)
                if found is None:
                    found = pack(heap_merge(w.encode(), table))
                    if len(rest) > 200_000:
                        rest.clear()
                    if len(w) <= HOT_CHARS:
                        rest[w] = found
                return found

            for b in batches:
                packed = []
                for text in b[at].to_pylist():
                    ws = split(text or "")
                    found = [first.get(w) for w in ws]
                    packed.append(b"".join([f if f is not None else ids(w) for f, w in zip(found, ws, strict=True)]))
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(packed, pa.binary())], [*b.schema.names, "_n", "_ids", "_packed"])

        out = docs.toDF(*names).mapInArrow(run, ", ".join([*kinds, "_n long, _ids array<int>, _packed binary"]))
        return out.toDF(*docs.columns, "n_tokens", "ids", "packed")

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.piece, i)), ""))


def _as_text(token: bytes) -> str | None:
    try:
        return token.decode()
    except UnicodeDecodeError:
        return None


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    codec = Codec(docs.sparkSession, path, pattern)
    coded = codec.encode(docs.select("doc_id", "text"))
    return coded.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2(codec.decode(F.col("ids")), 256).alias("decoded_sha256"))
