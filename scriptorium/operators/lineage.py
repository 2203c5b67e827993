"""Cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder of checkpoints, that the session names in ``spark.checkpoint.dir``.

    A temporary folder is taken only where it names none and all runs on this machine."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith(("local[", "local ")) and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="scriptorium-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed to the session's folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """df marked so that a join shuffles it. Spark takes what Python made of a table, or exploded, for as small as the table's file, and would broadcast it at any size."""
    return df.hint("merge")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for tables, beside the checkpoints."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
