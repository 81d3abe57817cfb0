"""Amounts of a token's windows, which are summed over trades and not over wallets' states."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import SparkSession

from tideflow.operators import replay as rp

START = datetime(2024, 3, 1)


def test_amounts_by_step_without_wallet_states(spark: SparkSession) -> None:
    grid = rp.Grid("2024-03-01 00:00:00", "2024-03-01 03:00:00", 60)
    rows = [(1, 5, 0, "BUY", 10, 0, 2), (2, 5, 0, "SELL", 4, 0, None), (3, 9, 0, "BUY", 100, 0, 2), (4, 5, 0, "BUY", 1, 90, 3), (5, 5, 0, "BUY", None, 150, 3)]
    trades = spark.createDataFrame([(i, w, k, a, u, START + timedelta(minutes=m), c, i) for i, w, k, a, u, m, c in rows], "trade_id long, wallet_id long, token_id int, action string, usd int, ts timestamp_ntz, mcap int, block long")
    wallets = spark.createDataFrame([(5, True)], "wallet_id long, is_watched boolean")
    ends, last = rp.anchors(trades, grid, 3), 3
    placed = rp.placed(trades, ends, grid, last, (60,))
    got = {r["k"]: tuple(float(r[c]) for c in rp.AMOUNTS) for r in rp.amounts(placed, wallets, last).collect()}
    # Wallet 9 is unknown. The window ends at the last trade up to a step: 00:00, 00:00, 01:30, 02:30.
    assert got == {0: (10, 4, 20, 10, 0), 2: (1, 0, 3, 1, 10), 3: (1, 0, 3, 1, 0)}
    assert not {"mcap_weight", "mcap_usd", "trailing"} & set(rp.states(rp.panes(placed, 50.0), last).columns)
