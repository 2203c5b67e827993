"""Uniform shuffle into shards of exact sizes.

The rows of each input partition are counted. A matrix of how many rows each
partition sends to each shard is drawn from the multivariate hypergeometric
law, row by row, so that its sums are the partition counts and the shard sizes.
Each partition permutes its rows and cuts the permutation by its row of the
matrix; the rows, with all their columns, are exchanged; each shard permutes
what it has got. The result is distributed as one uniform permutation of all
rows, and shard sizes are at most one apart.

The second permutation is by a random 64-bit key, ranked in two steps: the
key's remainder chooses a slice, counts of slices give each slice's first slot,
and rows are ranked within their slice only, so no task ranks a whole shard.
The rows and their places in the input are kept in a table before anything
depends on them, and all draws are functions of the place and the seed, so
repeated tasks agree.

``write`` leaves the shards as Parquet in folders shard=S/slice=N, one file each:
slices follow one another in a shard, and a file's rows stand by slot. Whole rows
cross one exchange; the first permutation needs none, as it is drawn from a
row's place in its partition.

Defined cases: a null text has size 1 and the checksum of an empty text; null
ids, repeated ids and equal texts are rows like others; an empty table gives an
empty result; ``write`` and ``shuffle`` keep all columns, and give theirs other
names where the input has them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm._common import fresh, materialise, shared_dir, ship

BUCKET_ROWS = 100_000
#: Bytes of strings in a slice, about.
BUCKET_BYTES = 32 << 20
#: Spark's row ids have the partition above so many bits.
PLACE_BITS = 33


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard; sums are exact."""
    total = sum(counts)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for i, n in enumerate(counts):
        out[i] = _draw(rng, left, n)
        left -= out[i]
    return out


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """n rows taken without replacement from what the shards still lack."""
    got = np.zeros(len(left), dtype=np.int64)
    rest = int(left.sum())
    for s, most in enumerate(left.tolist()):
        rest -= most
        if n <= 0:
            break
        got[s] = min(n, most) if not rest else _hypergeometric(rng, most, rest, n)
        n -= int(got[s])
    return got


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn without replacement are good.

    numpy's generator takes up to 10 ** 9 of a kind. Beyond that each row is first
    taken on its own with probability n / all, by two binomial draws. Of those
    taken, any set of a size is as likely as any other, so drawing what is
    missing, or putting back what is too much, by the same law leaves a uniform
    set of n. Each such step leaves about the square root of n.
    """
    most = 10**9 - 1
    if not n or not good:
        return 0
    if good <= most and bad <= most:
        return int(rng.hypergeometric(good, bad, n))
    if 2 * n > good + bad:
        return good - _hypergeometric(rng, good, bad, good + bad - n)
    if n <= 16:
        taken = 0
        for _ in range(n):
            hit = int(rng.integers(good + bad)) < good
            good, bad, taken = good - hit, bad - (not hit), taken + hit
        return taken
    share = n / (good + bad)
    x, y = int(rng.binomial(good, share)), int(rng.binomial(bad, share))
    if x + y <= n:
        return x + _hypergeometric(rng, good - x, bad - y, n - x - y)
    return x - _hypergeometric(rng, x, y, x + y - n)


def _dealer(ends: dict[int, np.ndarray], seed: int) -> Callable[[Column], Column]:
    """The shard of a row by its place: its partition's permutation, cut by the partition's row of the matrix."""

    @F.pandas_udf("int")
    def deal(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, order = -1, np.zeros(0, dtype=np.int64)
        for batch in places:
            place = batch.to_numpy(dtype=np.int64)
            out = np.zeros(len(place), dtype=np.int32)
            parts = place >> PLACE_BITS
            for part in np.unique(parts).tolist():
                if part != held:
                    held, order = part, np.random.Generator(np.random.PCG64([seed, part])).permutation(ends[part][-1])
                at = parts == part
                out[at] = np.searchsorted(ends[part], order[place[at] & ((1 << PLACE_BITS) - 1)], side="right")
            yield pd.Series(out)

    return deal


def write(docs: DataFrame, path: str, shards: int = 8, seed: int = 7) -> DataFrame:
    """Writes the rows of docs to path by shard, and gives them as they are read from there: all columns, shard and slot."""
    spark = docs.sparkSession
    ship(spark)
    held = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*held)
    length = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, kind in rows.dtypes if kind in ("string", "binary")), F.lit(0).cast("long"))
    rows = materialise(rows.select(*held, F.monotonically_increasing_id().alias("place"), length.alias("bytes")), "shard-rows")
    part = F.shiftright("place", PLACE_BITS).cast("int").alias("part")
    counts = sorted((r["part"], r["rows"], r["bytes"]) for r in rows.groupBy(part).agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).collect())
    total, size = sum(n for _, n, _ in counts), sum(n for _, _, n in counts)
    matrix = communication_matrix([n for _, n, _ in counts], shards, seed)
    deal = _dealer({p: ends for (p, _, _), ends in zip(counts, matrix.cumsum(axis=1), strict=True)}, seed)
    slices = max(1, -(-total // (shards * BUCKET_ROWS)), -(-size // (shards * BUCKET_BYTES)))
    key = F.xxhash64("place", F.lit(seed), F.lit("slot"))
    placed = rows.drop("bytes").withColumns({"shard": deal(F.col("place")), "key": key, "slice": F.pmod(key, F.lit(slices)).cast("int")})
    sizes = placed.groupBy("shard", "slice").count()
    firsts = sizes.select(F.col("shard").alias("_s"), F.col("slice").alias("_b"), (F.sum("count").over(Window.partitionBy("shard").orderBy("slice")) - F.col("count")).alias("_first"))
    firsts = materialise(firsts, "shard-firsts")
    within = Window.partitionBy("shard", "slice").orderBy("key", "place")
    ranked = placed.withColumn("_rank", F.row_number().over(within) - 1).join(F.broadcast(firsts), (F.col("shard") == F.col("_s")) & (F.col("slice") == F.col("_b")))
    names = [fresh(n, docs.columns) for n in ("shard", "slice", "slot")]
    out = ranked.select(*held, "shard", "slice", (F.col("_first") + F.col("_rank")).cast("long").alias("slot")).toDF(*docs.columns, *names)
    out.write.partitionBy(*names[:2]).option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path).select(*docs.columns, names[0], names[2])


def shuffle(docs: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """The rows of docs as found in their shards, with shard and slot."""
    return write(docs, shared_dir(docs.sparkSession, "shards"), shards, seed)


def assign(docs: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; size and checksum are those of the text found in the shard."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    found = shuffle(docs.select("doc_id", *[docs[c] for c in docs.columns if c.lower() not in ("doc_id", "shard", "slot")]), shards, seed)
    return found.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), "shard", "slot")


def query(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
