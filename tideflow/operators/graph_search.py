"""Search from one wallet, the most valuable edge first, within budgets of nodes and edges.

The order is global: of all edges that touch an expanded node the one of most value goes next (then more transactions, then
the one seen first), whichever branch it is on. One edge may bring a more valuable one, so the order is told edge by edge;
what that needs is bounded by the budgets, and the tables stay in Spark. Each round is one Spark job that looks up the edges
of the node that is due and of those which the waiting edges lead to, so that rounds are few. At most max_nodes + LOOK_AHEAD
nodes a round with per_node edges each come to the driver.
"""

from __future__ import annotations

import heapq
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tideflow.operators.flows import HOP_BASE, HOP_LEAST, HOP_LOSS, HOP_OTHER
from tideflow.sources.shared import saved

#: Nodes whose edges are looked up beside the one that is due.
LOOK_AHEAD = 64
NODES = "node long, depth int, confidence int, sent_usd decimal(38,4), received_usd decimal(38,4), txs long"
EDGES = "src long, dst long, relationship string, asset string, usd decimal(38,4), txs long, first_ts timestamp_ntz, last_ts timestamp_ntz"


class Found(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    truncated: bool


def _looked_up(edges: DataFrame, nodes: list[int], per_node: int) -> dict[int, list[Row]]:
    """The per_node most valuable edges at each of a few nodes, whichever end it is."""
    ends = F.array(*[F.when(F.col(c).isin(nodes), F.col(c)) for c in ("src", "dst")])
    at = edges.withColumn("at", F.explode(F.array_compact(ends)))
    by = Window.partitionBy("at").orderBy(F.desc("usd"), F.desc("txs"), "src", "dst", "relationship", "asset")
    out: dict[int, list[Row]] = {n: [] for n in nodes}
    for r in at.withColumn("n", F.row_number().over(by)).where(F.col("n") <= per_node).orderBy("at", "n").collect():
        out[r["at"]].append(r)
    return out


def best_first(edges: DataFrame, source: int, depth: int = 3, min_usd: int = 100, max_nodes: int = 250, max_edges: int = 1000, per_node: int = 500, mode: str = "FULL_RAW", closed: DataFrame | None = None) -> Found:
    """Nodes and merged edges in the order of value, and whether a budget ended the search.

    edges: one row a (src, dst, relationship, asset) with usd, txs, first_ts, last_ts. An edge and the node that it leads to
    are taken together or not at all. Assets of one src, dst and relationship are merged; an edge met from both its ends counts
    once. closed: addresses that are reached but not expanded. mode DIRECT stops after one hop; CAPITAL_FLOW expands a node
    reached with at least half of the value that its source was reached with; ENTITY_DISCOVERY one with two transactions or ten
    times min_usd, over transfers only; FULL_RAW every node. A source without edges is found alone.
    """
    spark = edges.sparkSession
    deepest = 1 if mode == "DIRECT" else depth
    kept = edges.where((F.col("usd") >= min_usd) & (F.col("src") != F.col("dst")))
    if mode == "ENTITY_DISCOVERY":
        kept = kept.where("relationship not like 'BRIDGE%'")
    if closed is None:
        kept = kept.withColumns({"src_closed": F.lit(False), "dst_closed": F.lit(False)})
    else:
        for end in ("src", "dst"):
            marked = closed.select(F.col("address").alias(end), F.lit(True).alias(f"{end}_closed")).distinct()
            kept = kept.join(marked, end, "left").withColumn(f"{end}_closed", F.coalesce(f"{end}_closed", F.lit(False)))
    kept = saved(kept)

    near: dict[int, list[Row]] = {}
    waiting: list[tuple] = []
    nodes: dict[int, dict] = {source: {"depth": 0, "confidence": 100, "sent": Decimal(0), "received": Decimal(0), "txs": 0}}
    merged: dict[tuple, dict] = {}
    met: set[tuple] = set()
    expanded: set[int] = set()
    pushed = 0

    def expand(node: int, level: int, reached_with: Decimal | None) -> None:
        nonlocal pushed
        expanded.add(node)
        if level >= deepest:
            return
        if node not in near:
            ahead = [x[3] for x in heapq.nsmallest(4 * LOOK_AHEAD, waiting) if x[4] < deepest and x[3] not in expanded and x[3] not in near]
            near.update(_looked_up(kept, [node, *dict.fromkeys(ahead)][: LOOK_AHEAD + 1], per_node))
        for r in near[node]:
            other = r["dst"] if r["src"] == node else r["src"]
            heapq.heappush(waiting, (-r["usd"], -r["txs"], pushed, other, level + 1, reached_with, r))
            pushed += 1

    expand(source, 0, None)
    truncated = False
    while waiting:
        _, _, _, node, level, reached_with, r = heapq.heappop(waiting)
        key = (r["src"], r["dst"], r["relationship"])
        if len(nodes) + (node not in nodes) > max_nodes or len(merged) + (key not in merged) > max_edges:
            truncated = True
            break
        new = nodes.setdefault(node, {"depth": level, "confidence": HOP_LEAST, "sent": Decimal(0), "received": Decimal(0), "txs": 0})
        if (*key, r["asset"]) not in met:
            met.add((*key, r["asset"]))
            e = merged.setdefault(key, {"asset": r["asset"], "usd": Decimal(0), "txs": 0, "first": r["first_ts"], "last": r["last_ts"]})
            e |= {"usd": e["usd"] + r["usd"], "txs": e["txs"] + r["txs"], "first": min(e["first"], r["first_ts"]), "last": max(e["last"], r["last_ts"])}
            nodes[r["src"]]["sent"] += r["usd"]
            nodes[r["dst"]]["received"] += r["usd"]
            for end in ("src", "dst"):
                nodes[r[end]]["txs"] += r["txs"]
        new["confidence"] = max(new["confidence"], HOP_BASE.get(r["relationship"], HOP_OTHER) - HOP_LOSS * (level - 1))
        enough = {"CAPITAL_FLOW": reached_with is None or 2 * r["usd"] >= reached_with, "ENTITY_DISCOVERY": r["txs"] >= 2 or r["usd"] >= 10 * min_usd}.get(mode, True)
        is_closed = r["dst_closed"] if node == r["dst"] else r["src_closed"]
        if enough and not is_closed and node not in expanded:
            expand(node, level, r["usd"])
    found = spark.createDataFrame([(n, x["depth"], x["confidence"], x["sent"], x["received"], x["txs"]) for n, x in nodes.items()], NODES)
    links = spark.createDataFrame([(s, d, rel, e["asset"], e["usd"], e["txs"], e["first"], e["last"]) for (s, d, rel), e in merged.items()], EDGES)
    return Found(found, links, truncated)
