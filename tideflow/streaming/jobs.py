"""Streaming forms of the passes: sources with a cursor, idempotent writes, trailing and anchored windows, state by key.

A stream is a folder that grows; each run takes what is new since the last one (availableNow with a checkpoint) and ends.
Tables that runs write keep a log of commits in a shared folder: after a restart, a batch that is run again is written once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tideflow.sources.shared import shared_path


#: A log entry of a table.
LOG = "version long, batch long, schema string, parts array<struct<folder: int, version: long>>"


class Table:
    """A Parquet table with a log of commits, both in a shared folder; a new object on the same path goes on where the last ended.

    Rows lie in folders by a hash of the table's keys (one folder without keys). A commit writes the folders that a batch
    touches under a new version and then one log entry: the version, its batch, and for each folder the version to read. The
    entry is one small file, renamed into place, so a batch is there or not; what a killed run left without one isn't read and
    is written over. A batch that the log has is left out.
    """

    def __init__(self, spark: SparkSession, name: str = "table", keys: Sequence[str] = (), path: str | None = None, folders: int = 8) -> None:
        self.spark, self.keys, self.path = spark, list(keys), path or shared_path(spark, name)
        self.folders = folders if keys else 1

    def _last(self) -> Row | None:
        """The newest log entry: version, batch, schema, and parts (folder, version)."""
        try:
            log = self.spark.read.schema(LOG).json(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return log.orderBy(F.desc("version")).first()

    def _folder(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.folders)) if self.keys else F.lit(0)

    def _rows(self, last: Row | None, only: set[int] | None = None) -> DataFrame | None:
        if last is None:
            return None
        schema = StructType.fromJson(json.loads(last["schema"]))
        paths = [f"{self.path}/data/version={x['version']}/folder={x['folder']}" for x in last["parts"] if only is None or x["folder"] in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        return self._rows(self._last())

    def write(self, new: DataFrame, batch: int, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
        """Merges a batch: only folders of its rows' keys are read and written again."""
        last = self._last()
        if last is not None and last["batch"] >= batch:
            return
        touched = {r[0] for r in new.select(self._folder()).distinct().collect()} if self.keys else {0}  # at most `folders`
        merged = merge(self._rows(last, touched), new)
        version = 0 if last is None else last["version"] + 1
        data = f"{self.path}/data/version={version}"
        merged.withColumn("folder", self._folder()).write.mode("overwrite").partitionBy("folder").parquet(data)
        filled = self.spark.read.schema("folder int").parquet(data).distinct().collect()
        parts = [(x["folder"], x["version"]) for x in (last["parts"] if last else []) if x["folder"] not in touched]
        self._commit((version, batch, merged.schema.json(), parts + [(r["folder"], version) for r in filled]))

    def _commit(self, entry: tuple) -> None:
        self.spark.createDataFrame([entry], LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")


def drip(spark: SparkSession, parts: Iterable[DataFrame], run: Callable[[DataFrame, str], object], path: str | None = None) -> None:
    """Each part is added to a folder, and then a run takes what is new. run starts a stream with a checkpoint folder.

    path holds both folders; one that an earlier drip used goes on with what that left unread.
    """
    path = path or shared_path(spark, "stream")
    source, checkpoint = f"{path}/source", f"{path}/cursor"
    for part in parts:
        part.write.mode("append").parquet(source)
        run(spark.readStream.schema(part.schema).parquet(source), checkpoint).awaitTermination()


def into(table: Table, merge: Callable[[DataFrame | None, DataFrame], DataFrame], mode: str = "append", of: Callable[[DataFrame], DataFrame] = lambda s: s) -> Callable[[DataFrame, str], object]:
    """A run that merges each batch of a stream into a table, once: the table's log knows the batches that it has."""
    return lambda stream, checkpoint: of(stream).writeStream.outputMode(mode).foreachBatch(lambda df, n: table.write(df, n, merge)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def inserted(keys: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Rows by their natural key: what is there, or came twice, is left alone."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        new = new.dropDuplicates(keys)
        return new if old is None else old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))

    return merge


def added(keys: list[str], sums: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Partial sums by key: a mergeable state that is small beside the rows."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        every = new if old is None else old.unionByName(new)
        return every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])

    return merge


def replaced(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """For streams in complete mode: the batch is the whole result."""
    return new


def trailing(stream: DataFrame, ts: str, keys: list[str], minutes: int, step: int, late: str | None = None) -> DataFrame:
    """Counts by key in sliding windows. late: rows of windows that ended so long before the newest row are dropped."""
    rows = stream.withColumn("_t", F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark("_t", late)
    g = rows.groupBy(F.window("_t", f"{minutes} minutes", f"{step} minutes").alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.end").cast("timestamp_ntz").alias("until"), "n")


def gated(stream: DataFrame, keys: list[str], ts: str, minutes: int, rank: Column) -> DataFrame:
    """Rows that pass a gate by key: none passed within so many minutes before, or rank 1 comes after rank 0 within them.

    State is the last row's time and rank. With rank 0 alone, the last passed row counts (dedupe); a row that is turned
    away counts too if ranks are given (cooldown). Rows of a key should come in order of time; those behind the newest row
    of earlier batches by more than the gate's minutes are dropped. A key's state goes once time has passed its gate, when
    it couldn't turn anything away.
    """
    out = ", ".join(f"{c} {t}" for c, t in stream.select(*keys).dtypes) + ", id long, ts timestamp, rank int, passed boolean"
    span = pd.Timedelta(minutes=minutes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, was = state.get if state.exists else (None, None)
        last = None if last is None else pd.Timestamp(last, unit="us")
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        passed = []
        for t, rank in zip(rows["ts"], rows["rank"]):
            go = last is None or t - last >= span or (rank == 1 and was == 0)
            passed.append(go)
            if go or rank >= 0:
                last, was = t, max(rank, 0)
        if last is not None:
            state.update((int(last.value // 1000), int(was)))
            # The watermark trails by the gate's minutes, so a row that it lets through may still be so much older.
            state.setTimeoutTimestamp(max(int((last + span).value // 1_000_000), state.getCurrentWatermarkMs()) + 1)
        yield rows.assign(passed=passed, **dict(zip(keys, key)))[[*keys, "id", "ts", "rank", "passed"]]

    rows = stream.withColumn("rank", rank.cast("int")).withColumn("ts", F.col(ts).cast("timestamp")).select(*keys, "id", "ts", "rank")
    rows = rows.withWatermark("ts", f"{minutes} minutes")
    return rows.groupBy(*keys).applyInPandasWithState(step, out, "last long, was int", "append", GroupStateTimeout.EventTimeTimeout)
