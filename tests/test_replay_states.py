"""Wallets' states as intervals of steps, and the largest holders found behind floors."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import SparkSession

from tideflow.operators import replay as rp

START = datetime(2024, 3, 1)


def test_states_hold_over_intervals_and_trades_in_no_window_make_one_row(spark: SparkSession) -> None:
    grid, last = rp.Grid("2024-03-01 00:00:00", "2024-03-01 03:00:00", 60), 3
    rows = [(1, 5, "BUY", 10, 10), (2, 5, "SELL", 4, 20), (3, 9, "BUY", 1, 59), (4, 5, "BUY", 3, 100), (5, 5, "BUY", 2, 110), (6, 9, "SELL", 1, 170)]
    trades = spark.createDataFrame([(i, w, 0, a, u, START + timedelta(minutes=m), None, i) for i, w, a, u, m in rows], "trade_id long, wallet_id long, token_id int, action string, usd int, ts timestamp_ntz, mcap int, block long")
    placed = rp.placed(trades, rp.anchors(trades, grid, last), grid, last, (30,))
    got = rp.states(rp.panes(placed, 50.0), last).where("wallet_id = 5").orderBy("k").collect()
    assert [(r["k"], r["until"], int(r["held"]), r["n_buy"], int(r["buy"])) for r in got] == [(1, 2, 6, 0, 0), (2, 3, 6, 2, 5), (3, 4, 11, 0, 0)]
    assert got[1]["first"].asDict() == {"block": 4, "half": 3, "new": False}


def test_largest_holders_against_a_walk(spark: SparkSession) -> None:
    rng, last = random.Random(4), 9
    rows = []
    for w in range(300):
        k = rng.randrange(last + 1)
        while k <= last:
            until = rng.randrange(k + 1, last + 2)
            # Many small holders, equal sizes among the large ones, and a second token with fewer holders than places.
            rows.append((0, 30, w, k, until, Decimal(rng.choice([1, 2, 3, 3, 50, 60])), rng.random() < 0.5))
            k = until + rng.randrange(3)
    rows += [(1, 30, w, w, w + 4, Decimal(5), True) for w in range(4)]
    holders = spark.createDataFrame(rows, "token_id int, minutes int, wallet_id long, k int, until int, held decimal(38,4), out boolean")
    steps = spark.createDataFrame([(t, 30, k) for t in (0, 1) for k in range(last + 1)], "token_id int, minutes int, k int")
    want = {}
    for t in (0, 1):
        for k in range(last + 1):
            met = sorted((r for r in rows if r[0] == t and r[3] <= k < r[4]), key=lambda r: (-r[5], r[2]))[:5]
            if met:
                want[t, k] = sum(r[6] for r in met)
    assert {(r["token_id"], r["k"]): r["top_exits"] for r in rp._top_exits(holders, steps, last).collect()} == want


def test_fires_are_told_from_one_reading_of_the_rules(spark: SparkSession, tmp_path) -> None:
    rows = [(0, "A", START + timedelta(hours=h), h != 30, "HIGH") for h in (0, 2, 24, 30, 50)]
    spark.createDataFrame(rows, "token_id int, rule string, t timestamp_ntz, fired boolean, severity string").write.parquet(f"{tmp_path}/rules")
    fires = rp.replayed_fires(spark.read.parquet(f"{tmp_path}/rules"))
    assert not fires.inputFiles()
    assert sorted(r["t"] for r in fires.collect()) == [START + timedelta(hours=h) for h in (0, 24, 50)]
