"""The search by value, against a walk over all edges at once, and small planted graphs."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import DataFrame, SparkSession

from tideflow.operators import graph_search as gs

AT = datetime(2024, 1, 1)
Edge = tuple[int, int, str, str, int, int]


def table(spark: SparkSession, edges: list[Edge]) -> DataFrame:
    schema = "src long, dst long, relationship string, asset string, usd long, txs long, first_ts timestamp_ntz, last_ts timestamp_ntz"
    return spark.createDataFrame([(*e, AT, AT) for e in edges], schema).withColumn("usd", gs.F.col("usd").cast("decimal(20,4)"))


def walked(edges: list[Edge], depth: int, least: int, max_nodes: int, max_edges: int, mode: str, closed: set[int]) -> tuple[dict, dict, bool]:
    """Depths by node and values by edge: all candidates are sorted anew at each step."""
    depths, values, seen, opened, queue, order = {0: 0}, {}, set(), set(), [], 0
    opening = [(0, 0, None)]
    while True:
        for node, level, value in opening:
            opened.add(node)
            if level < depth:
                for e in sorted((e for e in edges if node in e[:2] and e[0] != e[1] and e[4] >= least), key=lambda e: (-e[4], -e[5], e)):
                    queue.append((-e[4], -e[5], order, e, e[1] if e[0] == node else e[0], level + 1, value))
                    order += 1
        if not queue:
            return depths, values, False
        queue.sort(key=lambda q: q[:3])
        _, _, _, e, node, level, value = queue.pop(0)
        if len(set(depths) | {node}) > max_nodes or len(set(values) | {e[:3]}) > max_edges:
            return depths, values, True
        depths.setdefault(node, level)
        if e not in seen:
            values[e[:3]] = values.get(e[:3], 0) + e[4]
            seen.add(e)
        good = value is None or e[4] * 2 >= value if mode == "CAPITAL_FLOW" else True
        opening = [(node, level, e[4])] if good and node not in opened and node not in closed else []


@pytest.mark.parametrize(("mode", "max_nodes", "max_edges"), [("FULL_RAW", 10**6, 10**6), ("FULL_RAW", 25, 10**6), ("CAPITAL_FLOW", 10**6, 30)])
def test_against_a_walk(spark: SparkSession, mode: str, max_nodes: int, max_edges: int) -> None:
    rng = random.Random(11)
    # Values repeat, so ties are decided by transactions and by what was seen first.
    edges = list({(a, b, r, s): (a, b, r, s, rng.randrange(1, 12) * 50, rng.randrange(1, 4)) for a, b, r, s in ((rng.randrange(60), rng.randrange(60), rng.choice(("NATIVE", "BRIDGE_OUT")), rng.choice("xy")) for _ in range(160))}.values())
    closed = {7, 8, 9}
    got = gs.best_first(table(spark, edges), 0, 3, 100, max_nodes, max_edges, mode=mode, closed=spark.createDataFrame([(c,) for c in closed], "address long"))
    depths, values, truncated = walked(edges, 3, 100, max_nodes, max_edges, mode, closed)
    assert len(depths) > 10
    assert {r["node"]: r["depth"] for r in got.nodes.collect()} == depths
    assert {(r["src"], r["dst"], r["relationship"]): int(r["usd"]) for r in got.edges.collect()} == values
    assert got.truncated == truncated


def test_value_goes_before_the_order_of_parents(spark: SparkSession) -> None:
    """A 5000 grandchild of the lesser child goes before a 100 grandchild of the greater; no edge is left without its end."""
    edges = [(0, 1, "TOKEN", "x", 900, 1), (0, 2, "TOKEN", "x", 800, 1), (1, 3, "TOKEN", "x", 100, 1), (2, 4, "TOKEN", "x", 5000, 1)]
    got = gs.best_first(table(spark, edges), 0, 2, 50, max_nodes=4)
    nodes = {r["node"]: r for r in got.nodes.collect()}
    assert set(nodes) == {0, 1, 2, 4} and got.truncated
    assert {(r["src"], r["dst"]) for r in got.edges.collect()} == {(0, 1), (0, 2), (2, 4)}
    assert (nodes[0]["confidence"], nodes[1]["confidence"], nodes[4]["confidence"]) == (100, 80, 70)
    assert nodes[2]["sent_usd"] == 5000 and nodes[2]["received_usd"] == 800


def test_assets_merge_and_an_edge_counts_once(spark: SparkSession) -> None:
    edges = [(0, 1, "TOKEN", "x", 300, 2), (0, 1, "TOKEN", "y", 200, 1), (1, 0, "TOKEN", "x", 150, 1), (5, 5, "TOKEN", "x", 900, 1)]
    got = gs.best_first(table(spark, edges), 0, 3, 100)
    assert {(r["src"], r["dst"]): (int(r["usd"]), r["txs"]) for r in got.edges.collect()} == {(0, 1): (500, 3), (1, 0): (150, 1)}
    assert not got.truncated
    alone = gs.best_first(table(spark, edges), 77)
    assert [r["node"] for r in alone.nodes.collect()] == [77] and alone.edges.count() == 0 and not alone.truncated
