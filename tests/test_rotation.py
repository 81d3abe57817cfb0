"""Rotation chains and what passes keep, on planted rows and against a walk over random ones."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from tideflow.operators import flows as fl
from tideflow.operators import rotation as ro

T0 = datetime(2024, 1, 5)
EDGES = "edge_id long, src long, dst long, usd double, ts timestamp_ntz, asset string, protocol string, action string"
EXITS = "trade_id long, wallet_id long, token_id long, ts timestamp_ntz, profit double"
BUYS = "trade_id long, wallet_id long, token_id long, ts timestamp_ntz, mcap double"


def _at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def _tables(spark: SparkSession, edges: list, exits: list, buys: list, wallets: int = 30) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return spark.createDataFrame(edges, EDGES), spark.createDataFrame(exits, EXITS), spark.createDataFrame(buys, BUYS), spark.range(wallets).withColumnRenamed("id", "wallet_id")


def _chains(spark: SparkSession, edges: list, exits: list, buys: list) -> DataFrame:
    e, x, b, w = _tables(spark, edges, exits, buys)
    return ro.chains(x, ro.received(ro.moves(e, w, fl.greedy_match(fl.bridge_candidates(e)))), b)


def test_planted_chains(spark: SparkSession) -> None:
    edges = [
        (1, 1, 2, 900.0, _at(60), "USDC", None, "transfer"),
        (2, 3, 99, 1000.0, _at(60), "USDC", "wormhole", "bridge_deposit"),  # 99 is the bridge, not a known wallet
        (3, 98, 4, 960.0, _at(75), "USDC", "wormhole", "bridge_withdrawal"),
        (4, 5, 97, 500.0, _at(60), "USDC", None, "transfer"),  # to nobody known
        (5, 6, 7, 500.0, _at(60 * 25), "USDC", None, "transfer"),  # later than a day after the exit
        (6, 8, 9, 500.0, _at(60), "USDC", None, "transfer"),  # its buy comes too late
        (7, 10, 11, 0.0, _at(60), "USDC", None, "transfer"),  # without value
    ]
    exits = [(100 + w, w, 0, _at(0), 600.0) for w in (1, 3, 5, 6, 8, 10)] + [(120, 1, 5, _at(0), 499.0)]
    buys = [(200 + w, w, 1, _at(100), 1000.0) for w in (2, 4, 11, 97)] + [(207, 7, 1, _at(60 * 25 + 5), 1000.0), (209, 9, 1, _at(121), 1000.0), (210, 2, 6, _at(90), None), (211, 2, 6, _at(91), 6e6)]
    got = {(r["exit_id"], r["move_id"], r["receipt_id"], r["buy_id"], r["bridged"], r["gap_min"], r["confidence"]) for r in _chains(spark, edges, exits, buys).collect()}
    assert got == {(101, 1, 1, 202, False, 100.0, 50), (103, 2, 3, 204, True, 100.0, 80)}


def test_chains_against_a_walk(spark: SparkSession) -> None:
    r = random.Random(11)
    n = 400
    edges = [(i, r.randrange(4), r.randrange(4), r.choice([0.0, 100.0, 95.0, 90.0, 80.0, 120.0]), _at(r.randrange(0, 4000, 10)), "USDC", r.choice([None, "portal"]), r.choice(["transfer", "bridge_deposit", "bridge_withdrawal"])) for i in range(n)]
    exits = [(1000 + i, r.randrange(4), r.randrange(3), _at(r.randrange(0, 4000, 10)), r.choice([100.0, 500.0, 900.0])) for i in range(40)]
    buys = [(2000 + i, r.randrange(4), r.randrange(3), _at(r.randrange(0, 4000, 10)), r.choice([None, 5e6, 5e6 + 1])) for i in range(120)]
    e, x, b, w = _tables(spark, edges, exits, buys)
    pairs = [(p["dep_id"], p["wd_id"]) for p in fl.greedy_match(fl.bridge_candidates(e)).collect()]
    assert pairs
    moves = [(i, i, s, d, u, t, u, t, False) for i, s, d, u, t, _, _, a in edges if a == "transfer"]
    moves += [(p, q, edges[p][1], edges[q][2], edges[p][3], edges[p][4], edges[q][3], edges[q][4], True) for p, q in pairs]
    want = set()
    for xi, xw, _, xt, profit in exits:
        for mi, own, s, d, sent, mt, _, _, bridged in moves:
            if profit < 500 or s != xw or not xt <= mt <= xt + timedelta(hours=24) or sent <= 0:
                continue
            got = [(gt, ri != own, ri) for _, ri, s2, d2, _, _, g, gt, _ in moves if (s2, d2) == (s, d) and mt <= gt <= mt + timedelta(hours=48) and 80 <= g / sent * 100 <= 105]
            spent = [(bt, bi) for bi, bw, _, bt, cap in buys if got and bw == d and cap is not None and cap <= 5e6 and min(got)[0] <= bt <= min(got)[0] + timedelta(minutes=60)]
            if spent:
                want.add((xi, mi, min(got)[2], min(spent)[1], bridged))
    moved = ro.received(ro.moves(e, w, spark.createDataFrame(pairs, "dep_id long, wd_id long")))
    found = {(c["exit_id"], c["move_id"], c["receipt_id"], c["buy_id"], c["bridged"]) for c in ro.chains(x, moved, b).collect()}
    assert found == want and any(c[4] for c in want) and any(not c[4] for c in want)


def test_passes_keep_one_a_route(spark: SparkSession) -> None:
    """Seen by passes at 12, 24, 36 and 48 hours: kept at 12, not at 24 nor at exactly a day later, again at 48."""
    edges = [(1, 1, 2, 900.0, _at(60), "USDC", None, "transfer"), (2, 1, 2, 900.0, _at(50), "USDC", None, "transfer"), (3, 1, 2, 900.0, _at(50 * 60), "USDC", None, "transfer")]
    exits = [(101, 1, 0, _at(30), 600.0), (102, 1, 0, _at(50 * 60 - 5), 600.0)]
    buys = [(201, 2, 1, _at(70), 1000.0), (202, 2, 1, _at(50 * 60 + 5), 1000.0)]
    market = spark.createDataFrame([(1, 1, _at(0), 500.0), (2, 1, _at(13 * 60), 2000.0), (3, 1, _at(47 * 60), None)], "point_id long, token_id long, ts timestamp_ntz, mcap double")
    kept = ro.kept(_chains(spark, edges, exits, buys), market, "2024-01-05 00:00:00", "2024-01-08 00:00:00")
    rows = sorted((k["detected_at"], k["exit_id"], k["move_id"], k["perf_pct"]) for k in kept.collect())
    assert rows == [(_at(12 * 60), 101, 2, -50.0), (_at(48 * 60), 101, 2, 100.0)]
    assert ro.kept(_chains(spark, edges, exits[:0], buys), market, "2024-01-05 00:00:00", "2024-01-08 00:00:00").collect() == []
