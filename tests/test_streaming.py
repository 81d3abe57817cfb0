"""Tables with a log of commits: a process killed between write and commit, and state that goes."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tideflow.streaming import jobs

KILLED = """
import os, sys
from pyspark.sql import SparkSession
from tideflow.streaming import jobs

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()

class Dies(jobs.Table):
    def _commit(self, entry):
        if entry[1] == 1:
            os._exit(9)
        super()._commit(entry)

table = Dies(spark, keys=["id"], path=sys.argv[1] + "/table", folders=4)
parts = [spark.range(0, 50).selectExpr("id", "id % 3 AS v"), spark.range(40, 80).selectExpr("id", "id % 3 AS v")]
jobs.drip(spark, parts, jobs.into(table, jobs.inserted(["id"])), sys.argv[1] + "/stream")
"""


def test_a_killed_run_goes_on_after_a_restart(spark: SparkSession, tmp_path: Path) -> None:
    run = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path)], cwd=Path(__file__).resolve().parents[1], capture_output=True, timeout=300)
    assert run.returncode == 9, run.stderr.decode()[-2000:]
    table = jobs.Table(spark, keys=["id"], path=f"{tmp_path}/table", folders=4)
    # The second batch's files are there, but it wasn't committed.
    assert Path(tmp_path, "table/data/version=1").exists()
    assert sorted(r["id"] for r in table.read().collect()) == list(range(50))
    jobs.drip(spark, [spark.range(75, 90).selectExpr("id", "id % 3 AS v")], jobs.into(table, jobs.inserted(["id"])), f"{tmp_path}/stream")
    assert sorted((r["id"], r["v"]) for r in jobs.Table(spark, keys=["id"], path=f"{tmp_path}/table", folders=4).read().collect()) == [(i, i % 3) for i in range(90)]


def test_a_repeated_batch_is_left_out_and_others_folders_stay(spark: SparkSession, tmp_path: Path) -> None:
    new = lambda: jobs.Table(spark, keys=["k"], path=f"{tmp_path}/sums", folders=8)
    add = jobs.added(["k"], ["n"])
    first = spark.range(64).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n"))
    new().write(first, 0, add)
    new().write(first.where("k = 5"), 1, add)
    new().write(first.where("k = 5"), 1, add)
    assert {r["k"]: r["n"] for r in new().read().collect()} == {k: 2 if k == 5 else 1 for k in range(64)}
    # One folder was written again; the seven others are read from the first version.
    assert sorted(x["version"] for x in new()._last()["parts"]) == [0] * 7 + [1]
    new().write(first.where("k < 0"), 2, add)
    assert new().read().count() == 64


def test_an_empty_table_keeps_its_columns(spark: SparkSession, tmp_path: Path) -> None:
    table = jobs.Table(spark, keys=["k"], path=f"{tmp_path}/none")
    assert table.read() is None
    table.write(spark.createDataFrame([], "k long, n long"), 0, jobs.added(["k"], ["n"]))
    assert table.read().columns == ["k", "n"] and table.read().count() == 0


def test_state_goes_once_its_gate_has_passed(spark: SparkSession, tmp_path: Path) -> None:
    """Keys that don't come back leave no state; one that does within its gate is turned away."""
    at = lambda rows: spark.createDataFrame(rows, "k long, id long, t string").select("k", "id", F.col("t").cast("timestamp").alias("t"))
    parts = [
        at([(k, k, "2024-01-01 00:00:00") for k in range(20)]),
        at([(1, 100, "2024-01-01 00:30:00"), (2, 101, "2024-01-01 01:00:00")]),
        at([(99, 102, "2024-01-02 00:00:00")]),
        at([(1, 103, "2024-01-02 00:10:00")]),
    ]
    table, seen = jobs.Table(spark, path=f"{tmp_path}/fires"), []
    run = jobs.into(table, jobs.inserted(["id"]), of=lambda s: jobs.gated(s, ["k"], "t", 60, F.lit(-1)))

    def watched(stream, checkpoint):
        query = run(stream, checkpoint)
        query.awaitTermination()
        seen.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        return query

    jobs.drip(spark, parts, watched, f"{tmp_path}/stream")
    passed = {r["id"] for r in table.read().where("passed").collect()}
    assert passed == {*range(20), 101, 102, 103}
    assert seen[0] == 20 and seen[-1] <= 2
