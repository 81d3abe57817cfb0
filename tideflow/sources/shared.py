"""The shared folder of a session, for tables that a query writes and reads again; lineage cuts and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few columns up to which a side may be broadcast.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a local session has none, a temporary folder. A cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or tempfile.mkdtemp(prefix="shared")).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df from the shared checkpoint folder, its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more rows than limit, else as it is. df should be cheap to count: saved, or small."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
