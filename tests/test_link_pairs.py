"""Pairs of wallets, which may be many more than wallets, are looked up in tables of wallets without being shuffled."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tideflow.operators import flows as fl
from tideflow.plans import domain
from tideflow.plans import flows as fq

D = "/root/testdata/sf0.001"


def test_evidence_and_clusters_shuffle_no_pairs(spark: SparkSession) -> None:
    for df in (fq._links(spark, D), domain.set_intersect_members(spark, D)):
        assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_services_and_routers_that_both_ends_touch(spark: SparkSession) -> None:
    rows = [(1, 1, 2, "transfer"), (2, 1, 90, "transfer"), (3, 2, 90, "transfer"), (4, 3, 4, "transfer"), (5, 3, 91, "transfer"), (6, 92, 4, "transfer"), (7, 1, None, "transfer")]
    edges = spark.createDataFrame(rows, "edge_id long, src long, dst long, action string").selectExpr("*", "cast(5 as decimal(20,4)) as usd", "timestamp_ntz '2024-01-01 00:00:00' as ts")
    registry = spark.createDataFrame([(90, "CEX"), (91, "MIXER"), (92, "MIXER")], "address long, category string")
    trades = spark.createDataFrame([], "wallet_id long, ts timestamp_ntz")
    got = {(r["a"], r["b"]): r["cex_or_mixer"] for r in fl.link_evidence(edges, registry, trades).collect()}
    assert got == {(1, 2): True, (1, 90): False, (2, 90): False, (3, 4): False, (3, 91): False, (4, 92): False}
