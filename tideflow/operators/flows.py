"""Transfers: edges, bridges, rotations, funding, wallet links, components, paths and frontier expansion."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideflow.operators.temporal import within
from tideflow.sources.shared import saved, small_or_shuffled

# The weight of each kind of evidence for a link between two wallets.
LINK_WEIGHTS = {
    "direct_transfer": 35, "repeated_transfers": 20, "same_funding": 25, "same_gas_funder": 10, "bridge_match": 30, "amount_similar": 15, "dest_buys_60m": 15,
    "fresh_wallet": 15, "same_rotation": 10, "cross_launch": 25, "cex_or_mixer": -30, "router_only": -20, "weak_amount": -15, "dust_only": -25,
}


def relationship(action: Column, asset: Column) -> Column:
    return F.when(action == "bridge_deposit", "BRIDGE_OUT").when(action == "bridge_withdrawal", "BRIDGE_IN").when(asset.isin("SOL", "BNB"), "NATIVE").when(asset.isin("USDC", "USDT"), "STABLE").otherwise("TOKEN")


def aggregate_edges(edges: DataFrame, per_node: int = 500) -> DataFrame:
    """One row a (src, dst, relationship, asset), the per_node largest of each source: samples, its five first ids."""
    e = edges.withColumn("relationship", relationship(F.col("action"), F.col("asset")))
    keys = ["src", "dst", "relationship", "asset"]
    g = e.groupBy(*keys).agg(F.sum("usd").alias("usd"), F.count("*").alias("txs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    by = Window.partitionBy("src").orderBy(F.desc("usd"), "dst", "relationship", "asset")
    g = g.withColumn("n", F.row_number().over(by)).where(F.col("n") <= per_node).drop("n")
    # Ranked before they are listed, so that a list never holds more than five.
    ranked = e.select(*keys, "edge_id").withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("edge_id"))).where("n <= 5")
    samples = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list("edge_id")).alias("samples"))
    return g.join(samples, keys)


def bridge_candidates(edges: DataFrame, minutes: int = 60, ratio: float = 0.95) -> DataFrame:
    """Deposit and withdrawal pairs of one asset and protocol (null protocols match), near in time either way and alike in value.

    Legs meet in buckets of the logarithm of their value, too, so that all legs of a hot asset don't.
    """
    cols = lambda side: [F.col("asset"), F.coalesce("protocol", F.lit("")).alias("protocol"), F.col("edge_id").alias(f"{side}_id"), F.col("usd").alias(f"{side}_usd"), F.col("ts").alias(f"{side}_ts"), F.col("src").alias(f"{side}_src"), F.col("dst").alias(f"{side}_dst")]
    # A little wider than the ratio, so that rounding at a bucket's edge loses no pair.
    size = F.floor(F.log(F.col("usd").cast("double")) / (-math.log(ratio) * (1 + 1e-9))).cast("long")
    paid = edges.where("usd > 0")
    dep = paid.where("action = 'bridge_deposit'").select(*cols("dep"), F.explode(F.array(size - 1, size, size + 1)).alias("size"))
    wd = paid.where("action = 'bridge_withdrawal'").select(*cols("wd"), size.alias("size"))
    keys = ["asset", "protocol", "size"]
    both = within(dep, wd, keys, "dep_ts", "wd_ts", minutes * 60).unionByName(within(wd, dep, keys, "wd_ts", "dep_ts", minutes * 60)).drop("size").dropDuplicates(["dep_id", "wd_id"])
    r = F.least("dep_usd", "wd_usd").cast("double") / F.when(F.greatest("dep_usd", "wd_usd") > 0, F.greatest("dep_usd", "wd_usd")).cast("double")
    return both.withColumn("ratio", r).where(F.col("ratio") >= ratio)


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's best by ratio (then by ids): a relational form of one-to-one matching."""
    a = Window.partitionBy("dep_id").orderBy(F.desc("ratio"), "wd_id")
    b = Window.partitionBy("wd_id").orderBy(F.desc("ratio"), "dep_id")
    return pairs.withColumn("x", F.row_number().over(a)).withColumn("y", F.row_number().over(b)).where("x = 1 and y = 1").drop("x", "y")


def greedy_match(pairs: DataFrame) -> DataFrame:
    """dep_id, wd_id, ratio: one-to-one by ratio, then ids.

    Each round keeps the pairs that are the best of both ends and takes both ends out. A best pair of both ends is what the
    greedy walk would take whatever it took before, so the rounds end in the same matching, without a walk over a group.
    While pairs are left the best of all is one of them, so the rounds end by themselves. Rounds are merged like the digits
    of a binary number, so that the plan grows with the logarithm of their number.
    """
    left, kept = saved(pairs.select("dep_id", "wd_id", "ratio")), []
    while True:
        best = saved(mutual_best(left))
        if not best.limit(1).count():
            return reduce(DataFrame.unionByName, [df for _, df in kept], left.limit(0))
        left = saved(left.join(best.select("dep_id"), "dep_id", "left_anti").join(best.select("wd_id"), "wd_id", "left_anti").select("dep_id", "wd_id", "ratio"))
        rounds = 1
        while kept and kept[-1][0] == rounds:
            best = saved(kept.pop()[1].unionByName(best))
            rounds *= 2
        kept.append((rounds, best))


def rotations(exits: DataFrame, transfers: DataFrame, buys: DataFrame, min_profit: float = 500.0, hours: int = 24, low: float = 80.0, high: float = 105.0, buy_minutes: int = 60, mcap_max: float = 5000000.0) -> DataFrame:
    """Exits whose proceeds move on and buy another token: exit, transfer in time and size, first fitting buy by the receiver.

    exits: wallet_id, token_id, trade_id, ts, profit, usd. transfers: edge_id, src, dst, ts, usd. buys: wallet_id, token_id, trade_id, ts, usd, mcap.
    """
    x = exits.where(F.col("profit") >= min_profit).select("wallet_id", F.col("token_id").alias("from_token"), F.col("trade_id").alias("exit_id"), F.col("ts").alias("exit_ts"), "profit", F.col("usd").alias("exit_usd"))
    t = transfers.select(F.col("src").alias("wallet_id"), "dst", "edge_id", F.col("ts").alias("move_ts"), F.col("usd").alias("move_usd"))
    moved = within(x, t, ["wallet_id"], "exit_ts", "move_ts", hours * 3600)
    pct = F.col("move_usd").cast("double") / F.col("exit_usd").cast("double") * 100
    moved = moved.where((F.col("exit_usd") > 0) & pct.between(low, high)).withColumn("match_pct", pct)
    b = buys.where(F.col("mcap").isNotNull() & (F.col("mcap") <= mcap_max)).select(F.col("wallet_id").alias("dst"), F.col("token_id").alias("to_token"), F.col("trade_id").alias("buy_id"), F.col("ts").alias("buy_ts"))
    bought = within(moved, b, ["dst"], "move_ts", "buy_ts", buy_minutes * 60)
    first = Window.partitionBy("exit_id", "edge_id").orderBy("buy_ts", "buy_id")
    return bought.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def funding_events(edges: DataFrame, trades: DataFrame, wallets: DataFrame) -> DataFrame:
    """Transfers from a smart wallet to a known one: whether that was fresh, and its first buy after."""
    smart = wallets.where("is_watched or meets_profitable").select(F.col("wallet_id").alias("src"))
    first = trades.groupBy("wallet_id").agg(F.min("ts").alias("first_ts")).withColumnRenamed("wallet_id", "dst")
    e = edges.where("action = 'transfer' and src <> dst").join(smart, "src").join(wallets.select(F.col("wallet_id").alias("dst")), "dst").join(first, "dst", "left")
    return e.withColumn("fresh", F.col("first_ts").isNull() | (F.col("first_ts") > F.col("ts")))


def link_confidence(evidence: dict[str, Column]) -> Column:
    total = sum((F.when(F.coalesce(evidence[k], F.lit(False)), w).otherwise(0) for k, w in LINK_WEIGHTS.items() if k in evidence), F.lit(0))
    return F.least(F.greatest(total, F.lit(0)), F.lit(100))


def band(confidence: Column) -> Column:
    return F.when(confidence <= 30, "weak").when(confidence <= 60, "possible").when(confidence <= 80, "probable").otherwise("strong")


# The limits that evidence is judged by.
BRIDGE_HOURS, BRIDGE_RATIO, SIMILAR, DUST_USD, BUY_MINUTES = 2, 0.9, 0.9, 10, 60
EVIDENCE = ("direct_transfer", "repeated_transfers", "same_funding", "bridge_match", "amount_similar", "dest_buys_60m", "fresh_wallet", "cex_or_mixer", "router_only", "weak_amount", "dust_only")


def bridge_pairs(edges: DataFrame, hours: int = BRIDGE_HOURS, ratio: float = BRIDGE_RATIO) -> DataFrame:
    """a, b, ratio: depositors and receivers (a < b) whose legs are near in time and alike in value, with their first legs' ratio.

    An equi-join on buckets of time and of the logarithm of the value, so that legs far apart in either never meet.
    """
    step = -math.log(ratio)
    size = F.floor(F.log(F.col("usd").cast("double")) / step).cast("long")
    paid = edges.where("usd > 0")
    dep = paid.where("action = 'bridge_deposit'").select(F.col("edge_id").alias("d_id"), F.col("src").alias("d_w"), F.col("usd").cast("double").alias("d_usd"), F.col("ts").alias("d_ts"), F.explode(F.array(size - 1, size, size + 1)).alias("size"))
    wd = paid.where("action = 'bridge_withdrawal'").select(F.col("edge_id").alias("w_id"), F.col("dst").alias("w_w"), F.col("usd").cast("double").alias("w_usd"), F.col("ts").alias("w_ts"), size.alias("size"))
    both = within(dep, wd, ["size"], "d_ts", "w_ts", hours * 3600).unionByName(within(wd, dep, ["size"], "w_ts", "d_ts", hours * 3600)).where("d_w <> w_w")
    r = F.least("d_usd", "w_usd") / F.greatest("d_usd", "w_usd")
    both = both.withColumn("ratio", r).where(F.col("ratio") >= ratio).select(F.least("d_w", "w_w").alias("a"), F.greatest("d_w", "w_w").alias("b"), F.struct("d_ts", "d_id", "w_ts", "w_id", "ratio").alias("leg"))
    return both.groupBy("a", "b").agg(F.min("leg").alias("m")).select("a", "b", F.col("m.ratio").alias("ratio"))


def link_evidence(edges: DataFrame, registry: DataFrame, trades: DataFrame) -> DataFrame:
    """a, b, and the eleven kinds of evidence, for pairs of wallets with transfers or bridge legs between them.

    What holds for a wallet (fresh, buys soon) or a class of wallets (one funder, one service) is looked up for these pairs
    instead of being expanded into pairs: all of it together stays below the threshold, so no link is lost.
    """
    t = edges.where("action = 'transfer' and src <> dst")
    direct = t.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"), F.min("usd").cast("double").alias("least"), F.max("usd").cast("double").alias("most"))
    pairs = saved(direct.join(bridge_pairs(edges), ["a", "b"], "full"))

    first = edges.groupBy("dst").agg(F.min(F.struct("ts", "edge_id", "src")).alias("m"))
    began = trades.groupBy("wallet_id").agg(F.min("ts").alias("began"))
    own = first.join(began, F.col("dst") == F.col("wallet_id"), "left").select(F.col("dst").alias("w"), F.col("m.src").alias("funder"), F.col("m.ts").alias("t"), "began")
    soon = F.coalesce((F.col("began") >= F.col("t")) & (F.col("began") <= F.col("t") + F.expr(f"INTERVAL {BUY_MINUTES} MINUTES")), F.lit(False))
    own = own.select("w", "funder", (F.col("began").isNull() | (F.col("began") > F.col("t"))).alias("fresh"), soon.alias("soon"))

    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("address"), F.col("src").alias("w")), F.struct(F.col("src").alias("address"), F.col("dst").alias("w")))).alias("x")).select("x.*").distinct()
    touch = ends.join(registry.where("category in ('CEX', 'MIXER', 'ROUTER')").select("address", (F.col("category") == "ROUTER").alias("router")).distinct(), "address")
    some = lambda c, name: F.collect_set(F.when(c, F.col("address"))).alias(name)
    touch = touch.groupBy("w").agg(some(~F.col("router"), "services"), some(F.col("router"), "routers"), F.collect_set("address").alias("touched"))

    # One row a wallet; pairs, which may be many more, are shuffled only if that is too much to broadcast.
    own = small_or_shuffled(saved(own.join(touch, "w", "full")))
    out = pairs
    for end in ("a", "b"):
        out = out.join(own.select(F.col("w").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("funder", "fresh", "soon", "services", "routers", "touched")]), end, "left")
    met = lambda c: F.coalesce(F.arrays_overlap(f"{c}_a", "touched_b"), F.lit(False))
    n, no = F.coalesce("n", F.lit(0)), F.lit(False)
    alike = F.when(n >= 2, F.when(F.col("most") > 0, F.col("least") / F.col("most"))).otherwise(F.col("ratio"))
    either = lambda c: F.coalesce(f"{c}_a", no) | F.coalesce(f"{c}_b", no)
    return out.select(
        "a",
        "b",
        (n >= 1).alias("direct_transfer"),
        (n >= 2).alias("repeated_transfers"),
        F.coalesce(F.col("funder_a") == F.col("funder_b"), no).alias("same_funding"),
        F.col("ratio").isNotNull().alias("bridge_match"),
        F.coalesce(alike >= SIMILAR, no).alias("amount_similar"),
        either("soon").alias("dest_buys_60m"),
        either("fresh").alias("fresh_wallet"),
        met("services").alias("cex_or_mixer"),
        (met("routers") & (n == 0)).alias("router_only"),
        F.coalesce(alike < SIMILAR, no).alias("weak_amount"),
        F.coalesce(F.col("most") < DUST_USD, no).alias("dust_only"),
    )


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """member, cluster (the least member) for each end of links (a, b): labels spread and jump until none changes."""
    links = saved(links.select("a", "b"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = saved(both.groupBy(F.col("a").alias("member")).agg(F.least(F.min("b"), F.first("a")).alias("cluster")))
    for _ in range(rounds):
        # A label a wallet: links stay where they are while labels fit a broadcast.
        near = both.join(small_or_shuffled(label), F.col("b") == F.col("member")).groupBy("a").agg(F.min("cluster").alias("m"))
        step = label.join(near, F.col("member") == F.col("a")).select("member", F.least("cluster", "m").alias("c"), F.col("cluster").alias("was"))
        jump = step.alias("x").join(step.select(F.col("member").alias("of"), F.col("c").alias("cc")), F.col("x.c") == F.col("of")).select("member", F.least("c", "cc").alias("cluster"), "was")
        jump = saved(jump)
        label = jump.select("member", "cluster")
        if not jump.where("cluster <> was").limit(1).count():
            return label
    raise RuntimeError("labels did not settle")


def paths(edges: DataFrame, source: int, hops: int = 4, top: int = 20) -> DataFrame:
    """Simple paths from a wallet with times that don't decrease: hops, least and last value, retention in percent; the top ones.

    Branch and bound: a path's least value only falls as it grows, so once there are `top` paths the last one's least value
    bounds what is worth growing, and edges below it are never met. Paths equal to the bound stay, so the result is exact.
    """
    e = saved(edges.where("src <> dst").select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("first_ts").alias("t"), F.col("usd").cast("double").alias("v")))
    v = F.col("v")
    step = e.where(F.col("s") == source).select(F.array("s", "d").alias("nodes"), "t", v.alias("least"), v.alias("first"), v.alias("last"))
    best = None
    for hop in range(1, hops + 1):
        step = saved(step)
        retention = F.round(F.least(F.greatest(F.col("last") / F.col("first") * 100, F.lit(0.0)), F.lit(999.0)), 4)
        found = step.select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"), F.lit(hop).alias("hops"), "least", retention.alias("retention")).distinct()
        both = found if best is None else best.unionByName(found)
        best = saved(both.orderBy(F.desc("least"), "path", "retention").limit(top))
        held = best.agg(F.count("*").alias("n"), F.min("least").alias("least")).first()
        bound = F.lit(held["least"] if held["n"] == top else None).cast("double")
        worth = lambda c: bound.isNull() | (F.col(c) >= bound)  # noqa: B023, E731
        near = (F.element_at("nodes", -1) == F.col("s")) & (F.col("t2") >= F.col("t"))
        grown = step.where(worth("least")).join(e.where(worth("v")).withColumnRenamed("t", "t2"), near).where(~F.array_contains("nodes", F.col("d")))
        step = grown.select(F.concat("nodes", F.array("d")).alias("nodes"), F.col("t2").alias("t"), F.least("least", "v").alias("least"), "first", F.col("v").alias("last"))
    return best


# Confidence of an edge by relationship, of any other, its loss by hop, and the least.
HOP_BASE, HOP_OTHER, HOP_LOSS, HOP_LEAST = {"NATIVE": 80, "STABLE": 80, "TOKEN": 80, "BRIDGE_OUT": 60, "BRIDGE_IN": 60}, 50, 10, 10


def hop_confidence(nodes: DataFrame, edges: DataFrame, source: int, depth: int) -> DataFrame:
    """node, depth, confidence: the best of a node's edges from expanded nodes, less for each hop; the source has 100.

    nodes is a frontier's result (expanded ones marked by `expanded`); edges has src, dst and relationship.
    """
    base = F.lit(HOP_OTHER)
    for k, v in HOP_BASE.items():
        base = F.when(F.col("relationship") == k, v).otherwise(base)
    from_ = nodes.where(F.col("expanded") & (F.col("depth") < depth)).select(F.col("node").alias("src"), F.col("depth").alias("d"))
    best = edges.join(from_, "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.greatest(F.lit(HOP_LEAST), base - HOP_LOSS * F.col("d"))).alias("best"))
    return nodes.join(best, "node", "left").select("node", "depth", F.when(F.col("node") == source, 100).otherwise(F.coalesce("best", F.lit(HOP_LEAST))).alias("confidence"))


def frontier(edges: DataFrame, source: int, depth: int = 3, min_usd: float = 100.0, stop: DataFrame | None = None, max_nodes: int | None = None) -> DataFrame:
    """node, depth: nodes reached level by level over edges of enough value; stop nodes are reached but not expanded.

    max_nodes keeps each level's nodes of largest inflow as long as the budget lasts.
    """
    e = saved(edges.where(F.col("usd") >= min_usd).groupBy("src", "dst").agg(F.sum("usd").alias("usd")))
    seen = edges.sparkSession.createDataFrame([(source, 0)], "node long, depth int")
    front = seen.select("node")
    left = None if max_nodes is None else max_nodes - 1
    for level in range(1, depth + 1):
        grow = front if stop is None else front.join(stop.select(F.col("address").alias("node")), "node", "left_anti")
        new = e.join(grow, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum("usd").alias("in_usd"))
        new = new.join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        if left is not None:
            new = new.orderBy(F.desc("in_usd"), "dst").limit(max(left, 0))
        new = saved(new.select(F.col("dst").alias("node"), F.lit(level).alias("depth")))
        if left is not None:
            left -= new.count()
        seen = saved(seen.unionByName(new))
        front = new.select("node")
    return seen
