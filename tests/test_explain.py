"""Explanations of fires: each family's sentences, numbers, deltas and the rotation that was known."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Row, SparkSession

from tideflow.operators import explain as ex

T0 = datetime(2024, 1, 5)


def _explain(spark: SparkSession, fires: list[tuple], windows: list[tuple], chains: list[tuple] = ()) -> dict[str, Row]:
    f = spark.createDataFrame(fires, "token_id long, rule string, t timestamp_ntz, severity string, symbol string")
    w = spark.createDataFrame(windows, "token_id long, minutes int, k long, t timestamp_ntz, smart long, entities long, net_usd double, sold_pct double, expansion double, liquidity double")
    c = spark.createDataFrame(list(chains), "to_token long, from_token long, buy_ts timestamp_ntz, buy_id long, sent double, got double, bridged boolean, protocol string, gap_min double, confidence int")
    return {r["rule"]: r for r in ex.explained(ex.with_chains(f, c), ex.figures(w)).collect()}


def _both(k: int, t: datetime, *figures: float | None) -> list[tuple]:
    return [(1, m, k, t, *figures) for m in (30, 1440)]


def test_accumulation_and_exit(spark: SparkSession) -> None:
    t = T0 + timedelta(hours=2)
    windows = _both(0, T0, 3, 2, -1000.0, 0.0, None, None) + _both(1, t, 4, 3, 12_345.0, 19.6, 0.8, 5000.0)
    got = _explain(spark, [(1, "A", t, "HIGH", "AB"), (1, "G", t, "CRITICAL", "AB"), (1, "B", T0, "WATCH", "AB")], windows)
    a, g, b = got["A"], got["G"], got["B"]
    assert a["headline"] == "$AB: high signal (rule A)"
    assert a["why"] == ["4 tracked smart wallets bought $AB, but entity clustering estimates 3 unique entities.", "Net smart flow is +$12.3k, sell pressure is low (20% of buyers have sold), and market cap expanded only 1.8x from average smart entry."]
    assert a["invalidates"] == ["Sell pressure rising above 30% of buyers", "Market cap expanding beyond 2× average smart entry", "Net smart flow turning negative"]
    assert a["changed"] == "+1 smart wallet and +$13.3k net flow since the last check."
    assert a["conclusion"].startswith("This sits between")
    assert g["headline"] == "$AB: exit warning (critical)" and g["why"][1] == "Net smart flow has turned to +$12.3k, and liquidity stands at $5k." and len(g["invalidates"]) == 3
    # The first step has nothing before it; a growth that isn't known counts as none.
    assert b["changed"] is None and b["conclusion"] == "This looks like accumulation, not late chase." and "-$1k" in b["why"][1]


def test_rotation_takes_the_last_known_chain(spark: SparkSession) -> None:
    windows = _both(0, T0, 1, 1, 0.0, 50.0, 3.0, 10.0)
    at = lambda h: T0 + timedelta(hours=h)
    chains = [(1, 7, at(-3), 10, 100.0, 96.0, True, "portal", 44.6, 80), (1, 8, at(-5), 11, 100.0, 100.0, False, None, 10.0, 50), (1, 9, at(1), 12, 100.0, 100.0, False, None, 5.0, 50)]
    f = _explain(spark, [(1, "F", T0, "HIGH", "AB"), (1, "E", T0, "HIGH", "AB")], windows, chains)
    assert f["F"]["headline"] == "$T7 → $AB: probable profit rotation"
    assert f["F"]["why"] == ["Wallet group realized profit on $T7, bridged funds through portal, and a linked wallet bought $AB 45 minutes later.", "Amount match: 96%. Confidence: probable."]
    assert f["F"]["conclusion"] == "This looks like a probable profit rotation from $T7 into $AB, not a coincidental buy."
    assert f["E"]["headline"] == "$AB: high signal (rule E)" and f["E"]["conclusion"].startswith("This looks like expansion")
    # Without a chain the figures tell it, and the reading stays open.
    none = _explain(spark, [(1, "F", T0, "HIGH", "AB")], windows)["F"]
    assert none["headline"] == "$AB: high signal (rule F)" and none["conclusion"].startswith("No clear read") and "$0.00" in none["why"][1]
    assert _explain(spark, [], windows, chains) == {}
