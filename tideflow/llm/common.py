"""Helpers that the training-data operators share: lineage cuts, checked broadcasts, lower-casing."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a two-or-three-column table may be broadcast (some tens of MB at most).
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a local session has none (tests), a temporary folder. A cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or tempfile.mkdtemp(prefix="checkpoints")).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the session's shared checkpoint folder and read it back, cutting its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more rows than limit; else as it is, for a shuffled join that AQE may split.

    df should be cheap to count: checkpointed, or a small table.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does the same where all characters are ASCII, and is faster there."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers import this package by name; where they run beside the driver, they find it here.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
