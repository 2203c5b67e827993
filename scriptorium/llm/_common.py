"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.shipping import ship

#: Java pattern of the white space that separates words: space and tab to carriage return.
WS = r"[\x20\x09-\x0D]+"

__all__ = ["WS", "add_columns", "arrow_batches", "extreme", "fresh", "join_spread", "materialise", "setting", "shared_dir", "ship", "table", "words"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is the one named by ``spark.checkpoint.dir``, or the session's
    checkpoint folder. Where neither is set a temporary folder is taken if all
    runs on this machine; on a cluster that is an error, as each executor would
    write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            root = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    This cuts the lineage: a lost executor costs only the tasks it held, and
    nondeterministic columns are computed once.
    """
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is hot if it holds more than one in so many of all rows, and more than so many rows.
HOT_SHARE, HOT_ROWS = 1000, 2000


def join_spread(big: DataFrame, small: DataFrame, key: str, size: str, total: int, by: list[str], keep_size: bool = False) -> DataFrame:
    """big joined with small, which has one row of a key and, in ``size``, how many rows of big have it (or more).

    Rows of hot keys are dealt out by the columns ``by``, and small's row goes to
    each part. There are ``HOT_SHARE`` hot keys at most, as sizes add up to
    ``total``, so a table of them may be broadcast.
    """
    least = max(HOT_ROWS, -(-total // HOT_SHARE))
    parts = F.ceil(F.col(size) / least).cast("int")
    hot = small.where(F.col(size) > least).select(key, parts.alias("_parts"))
    salt = F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = big.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_parts")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(copies if keep_size else copies.drop(size), [key, "_salt"]).drop("_salt")


#: Classes of size in an octave, for thresholds.
CLASSES = 8


def extreme(df: DataFrame, column: str, most: int, largest: bool = True) -> DataFrame:
    """Rows of df with the largest (or smallest) numbers in column, ``most`` of them at most.

    Numbers fall into classes of an eighth of an octave, and a class is taken whole or
    not at all, so a few hundred counts give a threshold and no task ranks all
    rows. df is read twice and must be fixed.
    """
    size = F.floor(CLASSES * F.log2(F.greatest(F.col(column).cast("double"), F.lit(0.0)) + 1)).cast("int")
    counts = sorted(((r["size"], r["count"]) for r in df.groupBy(size.alias("size")).count().collect()), reverse=largest)
    taken, held = [], 0
    for k, n in counts:
        held += n
        if held > most:
            break
        taken.append(k)
    if not taken:
        return df.limit(0)
    return df.where(size >= taken[-1] if largest else size <= taken[-1])


def arrow_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds Arrow batches, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """Within it the session has this setting; afterwards it has its own again."""
    held = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, held)


def fresh(name: str, taken: list[str]) -> str:
    """A column name like name that isn't taken, in whatever case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def words(text: Column) -> Column:
    """Words of a text: runs without ASCII white space; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), WS)
    return F.filter(parts, lambda w: w != "")


def add_columns(docs: DataFrame, run, ddl: str, names: list[str]) -> DataFrame:
    """docs with further columns made by an Arrow function of its batches.

    ``run`` gets an iterator of batches and the place of the column ``text``,
    and yields (batch, new arrays). Columns go by place, so that no name of
    docs can clash; ddl has the new columns' types, in order.
    """
    import pyarrow as pa

    held = [f"_c{i}" for i in range(len(docs.columns))]
    made = [f"_n{i}" for i in range(len(names))]
    at = docs.columns.index("text")

    def go(batches):
        for b, arrays in run(batches, at):
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], [*held, *made])

    kinds = [f"{n} {t}" for n, (_, t) in zip(held, docs.dtypes, strict=True)] + [f"{n} {t}" for n, t in zip(made, ddl.split("; "), strict=True)]
    return docs.toDF(*held).mapInArrow(go, ", ".join(kinds)).toDF(*docs.columns, *names)
