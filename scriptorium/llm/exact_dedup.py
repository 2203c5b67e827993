"""Exact duplicates by deterministic block naming.

Each text, with A-Z lower-cased, is cut into blocks of ``BLOCK`` bytes. All blocks
are sorted, and a block's name is its rank among the distinct ones. Then names
of adjacent blocks are paired, the pairs are sorted and named alike, and so on
until each text has one name. Two texts have the same name, from the same number
of rounds, exactly if they are equal: names stand for contents, not for
digests, so nothing can collide.

Blocks are sorted together with the row that they come from, so the many equal
blocks of a hot text spread over as many partitions as they need. A partition
ranks what it has, in order; only a partition's number of distinct keys and its
first and last key are put together to shift its ranks, which is one row a
partition. So a text crosses one shuffle, as blocks, and all other rounds move a
few integers a block, half as many each time. Rounds grow as the logarithm of
the longest text, which nothing ever holds as a whole but the task that reads it.

Defined cases: a null text counts as empty; empty texts are equal to each other;
rows that repeat an id are rows like others, and of equal ids one stays; an id
that is null is smaller than all others; an empty table gives an empty result;
other columns are ignored by ``judge`` and kept by ``keep``. ``docs`` must give the
same rows whenever it is read, as a table does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm._common import arrow_batches, fresh, join_spread, materialise, setting, ship

#: Bytes of a block.
BLOCK = 512
#: Keys that Spark draws for each sorted partition; they go to the driver.
SAMPLED = 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size, sha256(norm) AS text_sha256 FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (norm)
"""


def cut(texts: pa.Array, size: int) -> tuple[pa.Array, np.ndarray]:
    """Blocks of all texts, one after another, and the number of each text's blocks (one at least). No byte is copied."""
    texts = texts.cast(pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    counts = np.maximum(1, -(-np.diff(offsets) // size))
    firsts = np.cumsum(counts) - counts
    within = np.arange(counts.sum()) - np.repeat(firsts, counts)
    starts = np.append(np.repeat(offsets[:-1], counts) + within * size, offsets[-1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), int(counts.sum()), [None, pa.py_buffer(starts), texts.buffers()[2]]), counts


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """key (of the row), pos, n (blocks of the text), block; id and sha stand at the first block."""
    ship(docs.sparkSession)
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts = pc.ascii_lower(pc.fill_null(b["text"], ""))
            blocks, counts = cut(texts, size)
            rows = np.repeat(np.arange(b.num_rows), counts)
            pos = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            at_first = pa.array(rows, mask=pos > 0)
            sha = pa.array([hashlib.sha256(t).digest() for t in texts.cast(pa.binary()).to_pylist()], pa.binary())
            made = [b["key"].take(pa.array(rows)), pa.array(pos), pa.array(np.repeat(counts, counts)), blocks, b["id"].take(at_first), sha.take(at_first)]
            for at in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([x.slice(at, 20_000) for x in made], ["key", "pos", "n", "block", "id", "sha"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").alias("id"), "text")
    return rows.mapInArrow(run, f"key long, pos long, n long, block binary, id {kind}, sha binary")


def rank_partition(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds ``rank``, the place among the distinct keys of a sorted partition from 1, and ``edge`` for its first and last row; the keys stay there only."""
    last, top, held = None, 0, None

    def out(b: pa.RecordBatch, ranks: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        mask = pa.array(edge)
        columns = [pc.if_else(mask, b[c], pa.scalar(None, b[c].type)) if c in by else b[c] for c in b.schema.names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(ranks), mask], [*b.schema.names, "rank", "edge"])

    for b in batches:
        if not b.num_rows:
            continue
        changed = np.zeros(b.num_rows, dtype=bool)
        for c in by:
            changed[1:] |= pc.not_equal(b[c].slice(1), b[c].slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        changed[0] = last is None or any(b[c][0] != v for c, v in zip(by, last, strict=True))
        ranks = top + np.cumsum(changed)
        edge = np.zeros(b.num_rows, dtype=bool)
        edge[0] = last is None
        if held:
            yield out(*held)
        held, last, top = (b, ranks, edge), [b[c][b.num_rows - 1] for c in by], int(ranks[-1])
    if held:
        held[2][-1] = True
        yield out(*held)


def named(rows: DataFrame, by: list[str], parts: int, tag: str) -> DataFrame:
    """rows with the columns ``by`` replaced by ``name``: the rank of their values among the distinct ones of all rows."""
    spark = rows.sparkSession
    with setting(spark, "spark.sql.execution.rangeExchange.sampleSizePerPartition", SAMPLED):
        placed = rows.repartitionByRange(parts, *by, "key", "pos").sortWithinPartitions(*by, "key", "pos").withColumn("pid", F.spark_partition_id())
        kinds = ", ".join(f"{c} {t}" for c, t in placed.dtypes)
        ranked = materialise(placed.mapInArrow(lambda batches: rank_partition(batches, by), f"{kinds}, rank long, edge boolean"), tag)
    ends = ranked.where("edge").groupBy("pid").agg(F.max("rank").alias("most"), *(F.min_by(c, "rank").alias(f"first_{c}") for c in by), *(F.max_by(c, "rank").alias(f"last_{c}") for c in by))
    order = Window.orderBy("pid")
    goes_on = F.lit(True)
    for c in by:
        goes_on &= F.col(f"first_{c}") == F.lag(f"last_{c}").over(order)
    step = F.coalesce(F.lag("most").over(order), F.lit(0)) - F.coalesce(goes_on, F.lit(False)).cast("long")
    shifts = ends.withColumn("step", step).select("pid", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("shift"))
    # One row a partition, so this is small whatever the input.
    return ranked.join(F.broadcast(shifts), "pid").withColumn("name", F.col("rank") + F.col("shift")).drop("pid", "rank", "edge", "shift", *by)


#: An identity is name * LEVELS + rounds.
LEVELS = 64


def identities(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """key, id, sha, ident of every row; equal texts, and no others, have the same ident."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = named(_blocks(docs, size), ["block"], parts, "block-names")
    heads = rows.where("pos = 0").select("key", "id", "sha")
    most = rows.agg(F.max("n")).first()[0] or 1
    done, level = [], 0
    while True:
        done.append(rows.where("n = 1").select("key", (F.col("name") * LEVELS + level).alias("ident")))
        if most <= 1:
            break
        even = F.col("pos") % 2 == 0
        pairs = rows.where("n > 1").groupBy("key", F.floor(F.col("pos") / 2).alias("pos"), F.ceil(F.col("n") / 2).alias("n"))
        pairs = pairs.agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("b"))
        most, level = -(-most // 2), level + 1
        rows = named(pairs, ["a", "b"], max(1, parts >> level), "pair-names")
    every = done[0]
    for d in done[1:]:
        every = every.union(d)
    return heads.join(every, "key")


def _judged(docs: DataFrame, size: int) -> DataFrame:
    rows = materialise(identities(docs, size), "identities")
    groups = rows.groupBy("ident").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "key")).alias("stays"))
    return join_spread(rows, materialise(groups, "groups"), "ident", "group_size", rows.count(), ["key"], keep_size=True)


def judge(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """doc_id, keep_id (doc_id of the equal row that stays), group_size, kept and text_sha256 of every row."""
    out = _judged(docs, size)
    return out.select(F.col("id").alias("doc_id"), F.col("stays.id").alias("keep_id"), "group_size", (F.col("key") == F.col("stays.key")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """The rows of docs that stay, one of each text, with all their columns."""
    row = fresh("row", docs.columns)
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    ids = F.struct(F.col("doc_id").alias("id"), F.col(row).alias("row"))
    out = _judged(rows.select(ids.alias("doc_id"), "text"), size).where("key = stays.key").select(F.col("id.row").alias(row))
    return rows.join(out, row, "left_semi").drop(row)
