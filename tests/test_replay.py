"""Stepped windows and the outcome index against plain walks, on times that fall on the windows' edges."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import DataFrame, SparkSession

from tideflow.operators import outcome_index as ix
from tideflow.operators import replay as rp

T0 = datetime(2024, 3, 1)
TRADES = "trade_id long, wallet_id long, token_id int, action string, usd decimal(20,4), ts timestamp_ntz, block long, mcap decimal(24,4)"
WALLETS = "wallet_id long, is_watched boolean, meets_profitable boolean, score double, labels array<string>, cluster_id long"
MARKET = "point_id long, token_id int, ts timestamp_ntz, price double, mcap double, liquidity double"
GRID = rp.Grid("2024-03-01 02:00:00", "2024-03-03 01:10:00", 45)


def world(seed: int) -> tuple[list, list, list]:
    """Trades at quarters of an hour, many by one wallet; a wallet without a dimension row; points and null values."""
    rng = random.Random(seed)
    trades = [(i, rng.choice([1, 1, 1, 2, 3, 4, 5, 99]), rng.choice([0, 0, 0, 1]), rng.choice(["BUY", "BUY", "SELL"]), rng.choice([None, 5, 10, 20, 400]), T0 + timedelta(minutes=15 * rng.randrange(230)), rng.randrange(4), rng.choice([None, 1000, 2000])) for i in range(260)]
    trades += [(900, 1, 2, "BUY", 7, T0 + timedelta(hours=60), 1, None), (901, 2, None, "BUY", 7, T0, 1, None), (902, None, 0, "BUY", 7, T0, 1, None), (903, 1, 0, "BUY", 7, None, 1, None)]
    wallets = [(w, w % 2 == 1, w == 4, float(w), [["human_like"], ["smart_money"], ["possible_bot"], []][w % 4], (w % 2) if w != 3 else None) for w in range(1, 6)]
    market = [(i, rng.choice([0, 0, 1]), T0 + timedelta(minutes=15 * rng.randrange(230)), float(rng.randrange(1, 30)), rng.choice([None, 900.0, 3000.0]), rng.choice([None, 0.0, 50.0, 900.0])) for i in range(60)]
    return trades, wallets, market


def steps() -> list[datetime]:
    start, end = datetime(2024, 3, 1, 2), datetime(2024, 3, 3, 1, 10)
    out = [start]
    while out[-1] + timedelta(minutes=45) <= end:
        out.append(out[-1] + timedelta(minutes=45))
    return out if out[-1] == end else [*out, end]


def walked(trades: list, wallets: list, market: list, minutes: int) -> dict:
    """By token and step what a plain walk finds in the window."""
    dim = {w[0]: w for w in wallets}
    out = {}
    for k, t in enumerate(steps()):
        for token in {x[2] for x in trades if x[2] is not None}:
            own = sorted((x for x in trades if x[2] == token and x[5] is not None and x[5] <= t), key=lambda x: (x[5], x[0]))
            if not own:
                continue
            to = own[-1][5]
            own = [x for x in own if x[1] is not None]
            frm = to - timedelta(minutes=minutes)
            acc = defaultdict(lambda: {"buy": 0, "sell": 0, "first": None, "most": 0, "held": 0, "trailing": 0, "ever": None})
            weight = total = 0
            for _, w, _, action, usd, ts, block, mcap in own:
                usd, a = usd or 0, acc[w]
                a["ever"] = a["ever"] or ts
                if ts < frm:
                    a["held"] += usd if action == "BUY" else -usd
                    a["trailing"] += usd if action == "BUY" and ts >= frm - timedelta(minutes=minutes) else 0
                elif action == "BUY":
                    a["buy"] += usd
                    a["most"] = max(a["most"], usd)
                    a["first"] = a["first"] or (ts, block)
                    if mcap is not None and w in dim:
                        weight, total = weight + usd * mcap, total + usd
                else:
                    a["sell"] += usd
            buyers = {w: a for w, a in acc.items() if a["first"]}
            smart = {w for w in acc if w in dim and (dim[w][1] or dim[w][2])}
            label = lambda w, *names: w in dim and any(x in dim[w][4] for x in names)
            blocks, clusters = defaultdict(int), defaultdict(int)
            for w, a in buyers.items():
                blocks[a["first"][1]] += 1
                if w in smart and dim[w][5] is not None:
                    clusters[dim[w][5]] += 1
            held = {w: a for w, a in acc.items() if a["held"] > 0}
            out_of = lambda a, of: a[of] > 0 and a["sell"] / a[of] * 100 >= 80
            top = sorted(held, key=lambda w: (-held[w]["held"], w))[:5]
            tracked = [a for w, a in acc.items() if w in dim]
            new = [w for w in smart if w in buyers and w not in held]
            exits = len([w for w in smart if w in held]) + len(new)
            points = sorted((m for m in market if m[1] == token), key=lambda m: (m[2], m[0]))
            last = [m for m in points if m[2] <= to]
            first = [m for m in points if m[2] <= frm]
            liquidity = last[-1][5] if last else None
            start = first[-1][5] if first else None
            out[token, k] = {
                "buyers": len(buyers), "buy_usd": sum(a["buy"] for a in tracked), "sell_usd": sum(a["sell"] for a in tracked), "smart": len([w for w in buyers if w in smart]),
                "human_or_smart": len([w for w in buyers if label(w, "human_like", "smart_money")]), "bots": len([w for w in buyers if label(w, "possible_bot")]), "whales": len([a for a in acc.values() if a["most"] >= 300]),
                "entities": len(clusters) + len([w for w in buyers if w in smart and dim[w][5] is None]), "largest_cluster": max(clusters.values(), default=0),
                "avg_entry_mcap": round(weight / total, 4) if total else None, "current_mcap": last[-1][4] if last else None, "liquidity": liquidity,
                "liquidity_change_pct": round((liquidity - start) / start * 100, 6) if start and liquidity is not None else None,
                "trailing_usd": sum(a["trailing"] for a in tracked),
                "exited_smart_pct": round((len([w for w in smart if w in held and out_of(acc[w], "held")]) + len([w for w in new if out_of(acc[w], "buy")])) * 100 / exits, 6) if exits else 0,
                "top_exits": len([w for w in top if out_of(acc[w], "held")]), "new_smart": len([w for w in buyers if w in smart and acc[w]["ever"] == acc[w]["first"][0]]),
                "early_buyers": len([a for a in buyers.values() if a["first"][0] < frm + timedelta(minutes=minutes / 2)]), "sold_pct": round(len([a for a in buyers.values() if a["sell"] > 0]) * 100 / len(buyers), 6) if buyers else 0,
                "block_pct": round(max(blocks.values()) * 100 / len(buyers), 6) if buyers else 0,
            }
    return out


def frames(spark: SparkSession, seed: int) -> tuple[tuple, tuple[DataFrame, DataFrame, DataFrame]]:
    from decimal import Decimal

    trades, wallets, market = world(seed)
    exact = [tuple(Decimal(x) if i in (4, 7) and x is not None else x for i, x in enumerate(r)) for r in trades]
    return (trades, wallets, market), (spark.createDataFrame(exact, TRADES), spark.createDataFrame(wallets, WALLETS), spark.createDataFrame(market, MARKET))


@pytest.mark.parametrize("seed", [1, 2])
def test_stepped_windows_against_a_walk(spark: SparkSession, seed: int) -> None:
    rows, (trades, wallets, market) = frames(spark, seed)
    got = rp.stepped_windows(trades, wallets, market, GRID, (30, 240), whale_usd=300.0).collect()
    for minutes in (30, 240):
        want = walked(*rows, minutes)
        mine = {(r["token_id"], r["k"]): r.asDict() for r in got if r["minutes"] == minutes}
        assert mine.keys() == want.keys()
        wrong = [(k, c, mine[k][c], v) for k, w in want.items() for c, v in w.items() if (mine[k][c] is None) != (v is None) or (v is not None and abs(float(mine[k][c]) - v) > 1e-6)]
        assert not wrong, wrong[:5]
    assert [s for s in sorted({r["t"] for r in got})] == steps()


def test_no_step_sees_what_comes_later(spark: SparkSession) -> None:
    _, (trades, wallets, market) = frames(spark, 3)
    cut = rp.Grid(GRID.start, "2024-03-02 02:00:00", 45)
    early = "ts is null or ts <= TIMESTAMP_NTZ '2024-03-02 02:00:00'"
    told = lambda t, m: sorted(map(str, rp.stepped_windows(t, wallets, m, cut, (30, 240)).collect()))
    assert told(trades, market) == told(trades.where(early), market.where(early))


def test_rules_wait_for_the_last_event_of_a_chain_and_a_day_passes_between_fires(spark: SparkSession) -> None:
    _, (trades, wallets, market) = frames(spark, 1)
    windows = rp.stepped_windows(trades, wallets, market, GRID)
    seen = spark.createDataFrame([(0, datetime(2024, 3, 1, 3, 30)), (0, datetime(2024, 3, 2, 3, 30))], "token_id int, seen_ts timestamp_ntz")
    rules = rp.stepped_rules(windows, seen, seen.where("false")).cache()
    e = {r["t"]: r["fired"] for r in rules.where("rule = 'E' and token_id = 0").collect()}
    assert e and all(fired == (t >= datetime(2024, 3, 1, 3, 30)) for t, fired in e.items())
    assert not rules.where("rule = 'F' and fired").count()
    assert {r["rule"] for r in rules.select("rule").distinct().collect()} == set("ABCDEFG")
    fires = rp.replayed_fires(rules)
    times = [r["t"] for r in fires.where("rule = 'E'").orderBy("t").collect()]
    assert times == [datetime(2024, 3, 1, 3, 30), datetime(2024, 3, 2, 3, 30)]
    assert {r["severity"] for r in fires.where("rule = 'E'").collect()} == {"HIGH"}


def test_replay_of_an_empty_table(spark: SparkSession) -> None:
    _, (trades, wallets, market) = frames(spark, 1)
    assert rp.stepped_windows(trades.where("false"), wallets, market, GRID).collect() == []


def judged(signal: tuple, market: list) -> dict | None:
    _, token, fired, entry = signal
    points = sorted((m for m in market if m[1] == token and fired <= m[2] <= fired + timedelta(days=7)), key=lambda m: (m[2], m[0]))
    if not points:
        return None
    start, label = points[0][5], None
    top = low = None
    said = {"hard_failure": False, "major_win": False, "good_win": False, "small_win": False, "failure": False}
    multiples = []
    for m in points:
        x = m[3] / entry if entry and m[3] is not None else None
        gone = m[5] is not None and ((start is not None and start > 0 and m[5] <= start * 0.1) or m[5] < 1000)
        said["hard_failure"] |= gone and (top is None or top < 2)
        if x is not None:
            said["major_win"] |= x >= 5 and (low is None or low > 0.4)
            said["good_win"] |= x >= 2 and (low is None or low > 0.5)
            said["small_win"] |= x >= 1.5 and (low is None or low > 0.5)
            said["failure"] |= x <= 0.4 and (top is None or top < 2)
            top, low = max(x, top or x), min(x, low or x)
            multiples.append(((m[2] - fired).total_seconds() / 60, x))
    label = next((k for k, v in said.items() if v), "neutral_pending")
    at = lambda mark: next((round(t, 6) for t, x in multiples if x >= mark), None)
    pct = lambda x: None if x is None else round((x - 1) * 100, 6)
    return {"label": label, "max_upside_pct": pct(top), "max_drawdown_pct": pct(low), "roi_pct": pct(multiples[-1][1]) if multiples else None, "to_2x": at(2), "to_5x": at(5), "to_10x": at(10), "to_peak": next((round(t, 6) for t, x in multiples if x == top), None)}


def test_outcome_index_against_a_walk(spark: SparkSession) -> None:
    """One hot token, points at equal times, without prices or liquidity; signals on points, between them and after all."""
    rng = random.Random(9)
    when = lambda: T0 + timedelta(minutes=rng.randrange(60 * 24 * 12))
    market = [(i, 0 if i % 9 else 1, when(), rng.choice([None, *[float(rng.randrange(1, 400)) / 10 for _ in range(6)]]), None, rng.choice([None, 900.0, 5000.0, 90000.0, 90000.0])) for i in range(1500)]
    signals = [(i, rng.choice([0, 0, 1]), rng.choice([when(), market[rng.randrange(1500)][2]]), rng.choice([None, 0.0, 2.0, 10.0, 30.0])) for i in range(150)] + [(200, 0, T0 + timedelta(days=40), 2.0), (201, 7, T0, 2.0), (202, 0, T0 - timedelta(days=30), 2.0)]
    s = spark.createDataFrame(signals, "signal_id long, token_id int, fired_at timestamp_ntz, entry_price double")
    m = spark.createDataFrame(market, MARKET)
    got = {r["signal_id"]: r.asDict() for r in ix.judged(s, m).collect()}
    want = {x[0]: w for x in signals if (w := judged(x, market))}
    assert got.keys() == want.keys()
    wrong = [(i, k, got[i][k], v) for i, w in want.items() for k, v in w.items() if (got[i][k] is None) != (v is None) or (v is not None and (got[i][k] != v if isinstance(v, str) else abs(got[i][k] - v) > 1e-5))]
    assert not wrong, wrong[:5]
    slices = {(r["signal_id"], r["horizon"]): r for r in ix.horizon_slices(s, m).collect()}
    for i, token, fired, entry in signals:
        for name, minutes in ix.oc.HORIZONS.items():
            xs = [p[3] / entry for p in sorted(market, key=lambda p: (p[2], p[0])) if entry and p[1] == token and p[3] is not None and fired <= p[2] <= fired + timedelta(minutes=minutes)]
            assert ((i, name) in slices) == bool(xs)
            if xs:
                r = slices[i, name]
                assert all(abs(a - (b - 1) * 100) < 1e-5 for a, b in ((r["max_upside_pct"], max(xs)), (r["max_drawdown_pct"], min(xs)), (r["roi_pct"], xs[-1])))


def test_a_signal_reads_blocks_by_the_logarithm_of_its_points(spark: SparkSession) -> None:
    m = spark.range(20_000).selectExpr("id AS point_id", "0 AS token_id", "timestampadd(SECOND, cast(id AS int), TIMESTAMP_NTZ '2024-03-01 00:00:00') AS ts", "cast(id % 977 + 1 AS double) AS price", "cast(null AS double) AS mcap", "9000.0D AS liquidity")
    s = spark.createDataFrame([(1, 0, T0 + timedelta(seconds=37), 5.0)], "signal_id long, token_id int, fired_at timestamp_ntz, entry_price double")
    ranges, _, top = ix._segments(s, m)
    blocks = ranges.where("begin < end").select(ix.F.size(ix._blocks(ix.F.col("begin"), ix.F.col("end"), top)).alias("n")).groupBy().sum("n").first()[0]
    assert blocks <= len(ix.oc.HORIZONS) * 30 * (top + 1) < 20_000 / 20
    r = ix.judged(s, m).first()
    assert r["max_upside_pct"] == round((977 / 5 - 1) * 100, 6)
