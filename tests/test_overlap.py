"""Pairs that trade together, against all pairs: in one block, in many, with and without a table of marks."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

from tideflow import plans
from tideflow.operators import overlap as ov

START = datetime(2024, 1, 1)


def _trades() -> list[tuple]:
    r = random.Random(5)
    rows = [(i, r.randrange(2), r.randrange(12), START + timedelta(seconds=r.randrange(40) * 900)) for i in range(150)]
    return [*rows, (900, None, 1, START), (901, 1, None, START), (902, 1, 1, None), (903, 1, 2**40, START), (904, 1, -7, START + timedelta(hours=1)), (905, 1, -8, START + timedelta(hours=1, microseconds=1))]


def _expected(least: int) -> list[tuple]:
    met: dict[tuple, set] = {}
    rows = [x for x in _trades() if None not in x]
    for _, k, w, t in rows:
        for _, k2, w2, t2 in rows:
            if k == k2 and w < w2 and abs(t - t2) <= timedelta(hours=1):
                met.setdefault((w, w2), set()).add(k)
    return sorted((a, b, len(v)) for (a, b), v in met.items() if len(v) >= least)


@pytest.mark.parametrize(("block", "dense", "chunk"), [(1 << 23, 1 << 25, 1 << 20), (300, 1 << 25, 7), (300, 0, 7)])
def test_cotraders_against_all_pairs(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, block: int, dense: int, chunk: int) -> None:
    for k, v in (("BLOCK_PAIRS", block), ("DENSE", dense), ("CHUNK", chunk)):
        monkeypatch.setattr(ov, k, v, raising=False)
    trades = spark.createDataFrame(_trades(), "trade_id long, token_id int, wallet_id long, ts timestamp_ntz")
    for least in (1, 2):
        got = ov.cotraders(trades, least=least)
        assert sorted(map(tuple, got.collect())) == _expected(least)
        # Pairs are counted where they are formed: the only exchange is that of trades.
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
    assert ov.cotraders(trades.limit(0)).collect() == []


def _shuffled(spark: SparkSession) -> dict[int, int]:
    """Rows that each stage so far has written to shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


@pytest.mark.parametrize("least", [1, 2])
def test_trades_are_not_written_once_for_each_group(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, least: int) -> None:
    monkeypatch.setattr(ov, "BLOCK_PAIRS", 100)
    trades = spark.createDataFrame(_trades(), "trade_id long, token_id int, wallet_id long, ts timestamp_ntz")
    before = _shuffled(spark)
    got = ov.cotraders(trades, least=least)
    assert sorted(map(tuple, got.collect())) == _expected(least)
    # Two rows of each trade at most (its stretch, its group), beside a row a task and an hour and one a group.
    assert sum(n for i, n in _shuffled(spark).items() if i not in before) < 5 * len(_trades())


@pytest.mark.parametrize("dense", [1 << 25, 0])
def test_a_busy_wallet_keeps_two_trades_a_stretch(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, dense: int) -> None:
    """Trades before 1970, too, at the edges of stretches, in more tokens than a byte counts; tokens may be texts."""
    kept = []
    monkeypatch.setattr(ov, "DENSE", dense)
    monkeypatch.setattr(ov, "saved", lambda df, real=ov.saved: kept.append(real(df)) or kept[-1], raising=False)
    start, hour, tick = datetime(1969, 12, 31, 23), timedelta(hours=1), timedelta(microseconds=1)
    rows = [("k", 1, start + i * timedelta(seconds=7)) for i in range(1500)]
    end = rows[-1][2]
    rows += [("k", 2, start - hour), ("k", 3, start - hour - tick), ("k", 4, end + hour), ("k", 5, end + hour + tick), ("k", 6, start + hour), ("other", 3, start), ("K", 1, end + 9 * hour), ("K", 5, end + 9 * hour)]
    rows += [(f"t{i}", w, start + i * hour) for i in range(300) for w in (7, 8)]
    got = ov.cotraders(spark.createDataFrame(rows, "token_id string, wallet_id long, ts timestamp_ntz"), least=1)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1), (1, 4, 1), (1, 5, 1), (1, 6, 1), (2, 3, 1), (4, 5, 1), (7, 8, 300)]
    assert sum(len(r["us"]) // 8 for p in kept for r in p.collect()) == 2 * 3 + 8 + 600


def test_recurring_pairs_write_as_many_rows_as_trades(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """The query in one block and in many groups: the same pairs, and trades aren't written once for each group."""
    data = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, plans.QUERIES["agg_recurring_pairs"](spark, data).collect()))
    monkeypatch.setattr(ov, "BLOCK_PAIRS", 30)
    before = _shuffled(spark)
    assert sorted(map(tuple, plans.QUERIES["agg_recurring_pairs"](spark, data).collect())) == whole
    assert sum(n for i, n in _shuffled(spark).items() if i not in before) < 5 * spark.read.parquet(f"{data}/events.parquet").count()
