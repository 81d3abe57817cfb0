"""As-of and running sums by prefix scan, spam counts by visits, ingested mentions and pruned paths, each against a plain walk."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

from tideflow.operators import flows as fl
from tideflow.operators import social as so
from tideflow.operators import temporal as tm

T0 = datetime(2024, 1, 1)


def _at(minutes: float | None) -> datetime | None:
    return None if minutes is None else T0 + timedelta(minutes=minutes)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("pane", [60, 3600, 10**7])
def test_asof_over_panes(spark: SparkSession, forward: bool, pane: int) -> None:
    """A hot key over many panes, ties of time, null keys, null times on either side, and a key without rows to find."""
    r = random.Random(pane)
    keys = [0, 0, 0, 0, 1, 2, None]
    right = [(r.choice(keys[:5] + [None]), _at(r.choice([None, r.randrange(900), r.randrange(90) * 10])), i, r.random()) for i in range(300)]
    left = [(r.choice(keys), _at(r.choice([None, r.randrange(1000), r.randrange(90) * 10])), i) for i in range(200)]
    a = spark.createDataFrame(left, "k long, t timestamp_ntz, id long")
    b = spark.createDataFrame(right, "k long, ts timestamp_ntz, point long, v double")
    got = {x["id"]: x["v"] for x in tm.asof(a, b, ["k"], "t", "ts", "point", ["v"], forward=forward, pane=pane).collect()}
    want = {}
    for k, t, i in left:
        near = [(ts, p, v) for kk, ts, p, v in right if kk == k and t is not None and ts is not None and (ts >= t if forward else ts <= t)]
        want[i] = ((min if forward else max)(near)[2]) if near else None
    assert got == want


def test_asof_of_empty_tables(spark: SparkSession) -> None:
    a = spark.createDataFrame([(1, T0, 5)], "k long, t timestamp_ntz, id long")
    b = spark.createDataFrame([(1, T0, 9, 2.0)], "k long, ts timestamp_ntz, point long, v double")
    assert [x["v"] for x in tm.asof(a, b.limit(0), ["k"], "t", "ts", "point", ["v"]).collect()] == [None]
    assert tm.asof(a.limit(0), b, ["k"], "t", "ts", "point", ["v"]).collect() == []


def test_running_sum_over_panes(spark: SparkSession) -> None:
    r = random.Random(7)
    changes = [(r.choice([0, 0, 0, 1, None]), r.choice([None, r.randrange(5000)]), r.choice([-2, 1, 3])) for _ in range(300)]
    asks = [(r.choice([0, 1, 2, None]), r.choice([None, r.randrange(6000)]), i) for i in range(200)]
    scale = 1_000_000  # seconds
    c = spark.createDataFrame([(k, None if t is None else t * scale, v) for k, t, v in changes], "k long, t long, v long")
    a = spark.createDataFrame([(k, None if t is None else t * scale, i) for k, t, i in asks], "k long, t long, id long")
    got = {x["id"]: x["v"] for x in tm.running(c, a, ["k"], "t", "v", pane=60).collect()}
    assert got == {i: sum(v for kk, u, v in changes if kk == k and u is not None and t is not None and u <= t) for k, t, i in asks}


POSTS = "post_id long, author long, content string, posted_at timestamp_ntz"


def _posts() -> list[tuple]:
    """One text for a third of the posts, edges of the window to the minute, no authors, no times, no text."""
    r = random.Random(3)
    texts = ["same words for everybody here"] * 3 + ["gm", "another text of some length", None, ""]
    return [(i, r.choice([None, *range(8)]), r.choice(texts), _at(r.choice([None, *[r.randrange(0, 3000, 60)] * 9]))) for i in range(400)]


def test_spam_against_a_walk(spark: SparkSession) -> None:
    rows = _posts()
    got = {x["post_id"]: (x["spam_score"], x["spam_reason"]) for x in so.spam(spark.createDataFrame(rows, POSTS)).collect()}
    for i, author, text, at in rows:
        seen = [x for x in rows if at and x[3] and at - timedelta(minutes=360) <= x[3] <= at]
        authors = {x[1] for x in seen if x[2] == text and x[1] is not None}
        own = sum(author is not None and x[1] == author for x in seen)
        short = text is not None and len(text.replace(" ", "")) < 12
        assert got[i] == ((80, "copypasta") if len(authors) >= 3 else (60, "repeat_author") if own >= 5 else (50, "low_content") if short else (0, None)), i


def test_ingest_keeps_each_mention_once(spark: SparkSession) -> None:
    known, other = "So1anaToken" + "2" * 24, "So1anaToken" + "9" * 24
    rows = [(i, 1, i, f"buy $abc at {known}", _at(i)) for i in range(3)] + [(3, 2, 3, f"see https://pump.fun/coin/{other} and {other}", _at(900)), (4, 2, 4, "no token in here, only words", _at(0)), (5, None, None, None, None)]
    posts = spark.createDataFrame(rows, "post_id long, source long, author long, content string, posted_at timestamp_ntz")
    tokens = spark.createDataFrame([(known, 1)], "address string, token_id long")
    got = {x["dedupe_key"]: x for x in so.ingest(posts.unionByName(posts), tokens).collect()}
    assert sorted(got) == sorted([k for i in range(3) for k in (f"{i}::{known}", f"{i}::$ABC")] + [f"3::{other}"])
    assert {k: v["token_id"] for k, v in got.items() if "$" not in k} == {f"{i}::{known}": 1 for i in range(3)} | {f"3::{other}": None}
    assert got[f"3::{other}"]["kind"] == "url" and got[f"3::{other}"]["spam_score"] == 0
    assert [got[f"{i}::$ABC"]["spam_score"] for i in range(3)] == [0, 0, 80]
    assert so.ingest(posts.limit(0), tokens).count() == 0


@pytest.mark.parametrize("top", [1, 5, 20, 10_000])
def test_pruned_paths_against_a_walk(spark: SparkSession, top: int) -> None:
    r = random.Random(5)
    edges = [(r.randrange(12), r.randrange(12), _at(r.randrange(50)), float(r.randrange(1, 9))) for _ in range(90)]
    want = set()

    def walk(nodes: list[int], t: datetime, values: list[float]) -> None:
        if values:
            want.add((">".join(map(str, nodes)), len(values), min(values), round(min(max(values[-1] / values[0] * 100, 0.0), 999.0), 4)))
        if len(values) < 4:
            for s, d, u, v in edges:
                if s == nodes[-1] and d not in nodes and u >= t:
                    walk([*nodes, d], u, [*values, v])

    walk([3], datetime.min, [])
    best = sorted(want, key=lambda x: (-x[2], x[0], x[3]))[:top]
    found = fl.paths(spark.createDataFrame(edges, "src long, dst long, first_ts timestamp_ntz, usd double"), 3, top=top)
    assert sorted((x["path"], x["hops"], x["least"], x["retention"]) for x in found.collect()) == sorted(best)
