"""Transactions given twice: legs are read once a part and combined before they are shuffled."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tideflow import plans


def test_legs_given_twice_are_hashed_not_sorted(spark: SparkSession) -> None:
    plan = plans.QUERIES["src_tx_ingest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "SortAggregate" not in plan
    assert plan.count("FileScan") == 2
