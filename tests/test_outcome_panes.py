"""Outcomes from panes against a walk over each signal's points, in panes of several widths, and what is shuffled for them."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from typing import Any

import pytest
from pyspark.sql import DataFrame, SparkSession

from tideflow.operators import outcome_panes as ix
from tideflow.plans import outcomes as plans
from test_replay import MARKET, T0, judged


def _tables(spark: SparkSession, tokens: int = 2) -> tuple[list, list, DataFrame, DataFrame]:
    rng = random.Random(tokens)
    when = lambda: T0 + timedelta(minutes=rng.randrange(60 * 24 * 12))
    market = [(i, 0 if i % 9 else 1, when(), rng.choice([None, *[float(rng.randrange(1, 400)) / 10 for _ in range(6)]]), None, rng.choice([None, 900.0, 5000.0, 90000.0, 90000.0])) for i in range(1500)]
    market += [(2000 + i, 2, T0 + timedelta(days=i), [None, 3.0, 3.0, 40.0, 1.0, None][i], None, [None, 9000.0, 9000.0, 9000.0, 500.0, None][i]) for i in range(6)]
    signals = [(i, rng.choice([0, 0, 1]), rng.choice([when(), market[rng.randrange(1500)][2]]), rng.choice([None, 0.0, 2.0, 10.0, 30.0])) for i in range(100)]
    signals += [(200, 0, T0 + timedelta(days=40), 2.0), (201, 7, T0, 2.0), (202, 0, T0 - timedelta(days=30), 2.0), (203, 2, T0 - timedelta(days=6), 2.0), (204, 2, T0 + timedelta(hours=1), 3.0), (205, 2, T0 - timedelta(days=7), 2.0), (206, 1, datetime(1969, 12, 30), 2.0)]
    s = spark.createDataFrame([*signals, (300, None, T0, 2.0), (301, 0, None, 2.0)], "signal_id long, token_id int, fired_at timestamp_ntz, entry_price double")
    return signals, market, s, spark.createDataFrame([*market, (3000, None, T0, 1.0, None, 1.0), (3001, 0, None, 1.0, None, 1.0)], MARKET)


def _same(got: Any, want: Any) -> bool:
    return got == want if isinstance(want, str | None) or got is None else abs(got - want) < 1e-5


@pytest.mark.parametrize("points", [2048, 8, 1])
def test_panes_against_a_walk(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, points: int) -> None:
    monkeypatch.setattr(ix, "PANE_POINTS", points)
    signals, market, s, m = _tables(spark)
    got = {r["signal_id"]: r.asDict() for r in ix.judged(s, m).collect()}
    want = {x[0]: w for x in signals if (w := judged(x, market))}
    assert got.keys() == want.keys()
    assert not [(i, k, got[i][k], v) for i, w in want.items() for k, v in w.items() if not _same(got[i][k], v)]
    slices = {(r["signal_id"], r["horizon"]): r for r in ix.horizon_slices(s, m).collect()}
    ordered = sorted(market, key=lambda p: (p[2], p[0]))
    for i, token, fired, entry in signals:
        for name, minutes in ix.oc.HORIZONS.items():
            xs = [p[3] / entry for p in ordered if entry and p[1] == token and p[3] is not None and fired <= p[2] <= fired + timedelta(minutes=minutes)]
            assert ((i, name) in slices) == bool(xs)
            if xs:
                r = slices[i, name]
                assert all(_same(a, (b - 1) * 100) for a, b in ((r["max_upside_pct"], max(xs)), (r["max_drawdown_pct"], min(xs)), (r["roi_pct"], xs[-1])))


def test_empty_tables(spark: SparkSession) -> None:
    _, _, s, m = _tables(spark)
    for a, b in ((s.where("false"), m), (s, m.where("false")), (s.where("false"), m.where("false"))):
        assert ix.judged(a, b).collect() == [] and ix.horizon_slices(a, b).collect() == []


def test_points_are_joined_by_pane_alone(spark: SparkSession) -> None:
    """No rows of blocks over points: each plan only brings signals and points together by pane, and joins nothing."""
    for df in (plans.judged(spark, "/root/testdata/sf0.001"), plans.slices(spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FlatMapCoGroupsInArrow") == 3 and "Join" not in plan and "Window" not in plan
