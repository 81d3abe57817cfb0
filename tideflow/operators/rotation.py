"""Profit that moves on: transfers and bridged transfers with their receipts, the buys after them, and which rotations to keep."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.operators.temporal import asof, kept_fires, within
from tideflow.operators.writes import once
from tideflow.sources.shared import saved

ROUTE = ["source", "dest", "to_token"]
#: What a known destination, a bridged transfer and a receipt of like value add to the confidence.
CONFIDENCE = {"destination": 35, "bridged": 30, "alike": 15}
ALIKE = 0.9


def moves(edges: DataFrame, wallets: DataFrame, pairs: DataFrame) -> DataFrame:
    """move_id, receipt_id, source, dest, sent, move_ts, got, got_ts, bridged, protocol: transfers between known wallets.

    A direct transfer is its own receipt. pairs (dep_id, wd_id) match each bridge deposit with one withdrawal at most: both
    are one transfer, from who paid in to who was paid out, and its receipt. Transfers from or to others are left out.
    """
    e = edges.select("edge_id", "src", "dst", F.col("usd").cast("double").alias("usd"), "ts", "protocol", "action")
    direct = e.where("action = 'transfer'").select(F.col("edge_id").alias("move_id"), F.col("edge_id").alias("receipt_id"), F.col("src").alias("source"), F.col("dst").alias("dest"), F.col("usd").alias("sent"), F.col("ts").alias("move_ts"), F.col("usd").alias("got"), F.col("ts").alias("got_ts"), F.lit(False).alias("bridged"), F.lit(None).cast("string").alias("protocol"))
    paid = e.where("action = 'bridge_deposit'").select(F.col("edge_id").alias("dep_id"), F.col("src").alias("source"), F.col("usd").alias("sent"), F.col("ts").alias("move_ts"), "protocol")
    out = e.where("action = 'bridge_withdrawal'").select(F.col("edge_id").alias("wd_id"), F.col("dst").alias("dest"), F.col("usd").alias("got"), F.col("ts").alias("got_ts"))
    bridged = pairs.select("dep_id", "wd_id").join(paid, "dep_id").join(out, "wd_id").withColumnsRenamed({"dep_id": "move_id", "wd_id": "receipt_id"}).withColumn("bridged", F.lit(True))
    known = wallets.select("wallet_id").distinct()
    both = direct.unionByName(bridged)
    for end in ("source", "dest"):
        both = both.join(known.withColumnRenamed("wallet_id", end), end, "left_semi")
    return both


def received(found: DataFrame, low: float = 80.0, high: float = 105.0, hours: int = 48) -> DataFrame:
    """moves with the earliest receipt between the same wallets, not before them and of low to high percent of their value.

    A direct transfer's own receipt is the earliest there can be, so only bridged ones are joined: by both wallets, time
    and the logarithm of the value. The hours are those that a pass looks back. Transfers without value have no receipt.
    """
    own = F.lit(low <= 100 <= high) & ~F.col("bridged")
    paid = found.where("sent > 0")
    step = math.log(high / low) + 1e-6
    # From a little below the least value on, so that rounding loses no receipt; the range touches two buckets at most.
    least = F.floor((F.log(F.col("sent") * (low / 100)) - 1e-7) / step)
    ask = paid.where(~own).select("source", "dest", "move_id", F.col("receipt_id").alias("own_id"), "sent", "move_ts", "bridged", "protocol", F.explode(F.array(least, least + 1)).alias("size"))
    have = found.where("got > 0").select("source", "dest", "receipt_id", "got", "got_ts", F.floor(F.log("got") / step).alias("size"))
    met = within(ask, have, ["source", "dest", "size"], "move_ts", "got_ts", hours * 3600).where((F.col("got") / F.col("sent") * 100).between(low, high))
    first = F.min(F.struct("got_ts", (F.col("receipt_id") != F.col("own_id")).alias("other"), "receipt_id", "got")).alias("r")
    met = met.groupBy("move_id", "source", "dest", "sent", "move_ts", "bridged", "protocol").agg(first)
    late = met.select("move_id", "r.receipt_id", "source", "dest", "sent", "move_ts", "r.got", "r.got_ts", "bridged", "protocol")
    return paid.where(own).unionByName(late)


def chains(exits: DataFrame, moved: DataFrame, buys: DataFrame, min_profit: float = 500.0, hours: int = 24, buy_minutes: int = 60, mcap_max: float = 5000000.0) -> DataFrame:
    """Exits of enough realized profit, transfers in the hours after, and the receiver's first fitting buy after the receipt.

    exits: wallet_id, token_id, trade_id, ts, profit. moved: what received gives. buys: wallet_id, token_id, trade_id, ts,
    mcap; a buy without a market value doesn't fit. A transfer's buy doesn't depend on the exit, so it is looked up once.
    """
    b = buys.where(F.col("mcap") <= mcap_max).select(F.col("wallet_id").alias("dest"), F.col("token_id").alias("to_token"), F.col("trade_id").alias("buy_id"), F.col("ts").alias("buy_ts"), F.col("mcap").cast("double").alias("mcap"))
    first = within(moved.select("move_id", "dest", "got_ts"), b, ["dest"], "got_ts", "buy_ts", buy_minutes * 60).groupBy("move_id").agg(F.min(F.struct("buy_ts", "buy_id", "to_token", "mcap")).alias("b"))
    spent = moved.join(first, "move_id").select(*moved.columns, "b.*")
    x = exits.where(F.col("profit") >= min_profit).select(F.col("wallet_id").alias("source"), F.col("token_id").alias("from_token"), F.col("trade_id").alias("exit_id"), F.col("ts").alias("exit_ts"), "profit")
    out = within(x, spent, ["source"], "exit_ts", "move_ts", hours * 3600)
    gap = (F.unix_micros(F.col("buy_ts").cast("timestamp")) - F.unix_micros(F.col("exit_ts").cast("timestamp"))) / 60_000_000
    return out.withColumn("gap_min", gap).withColumn("confidence", confidence())


def confidence() -> Column:
    alike = F.least("sent", "got") / F.greatest("sent", "got") >= ALIKE
    return F.lit(CONFIDENCE["destination"]) + F.when(F.col("bridged"), CONFIDENCE["bridged"]).otherwise(0) + F.when((F.col("got") > 0) & alike, CONFIDENCE["alike"]).otherwise(0)


def kept(found: DataFrame, market: DataFrame, start: str, end: str, every_hours: int = 12, look_back_hours: int = 48, dedupe_hours: int = 24) -> DataFrame:
    """What passes at every so many hours from start to end keep of chains: one a route, unless one was kept in the hours before.

    A pass sees the chains that lie between its look-back and its time, and keeps a route's first by transfer, then exit.
    perf_pct is the bought token's change of value up to the pass, 0 where either value is missing. A route's history is one
    time a pass, whatever the number of its chains.
    """
    t0, t1, step = F.unix_micros(F.lit(start).cast("timestamp")), F.unix_micros(F.lit(end).cast("timestamp")), every_hours * 3_600_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    since = F.greatest(micros("buy_ts") - t0, F.lit(0).cast("long"))
    first = t0 + since + F.pmod(-since, F.lit(step).cast("long"))
    last = F.least(micros("exit_ts") + look_back_hours * 3_600_000_000, t1)
    seen = found.withColumn("at", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long")))))
    seen = saved(once(seen.withColumn("detected_at", F.timestamp_micros("at").cast("timestamp_ntz")).drop("at"), [*ROUTE, "detected_at"], "move_ts", "exit_ts", "exit_id", "move_id"))
    fires = kept_fires(seen.select(*ROUTE, "detected_at"), ROUTE, "detected_at", dedupe_hours, closed=True)
    new = saved(seen.join(fires, [*ROUTE, "detected_at"]))
    points = market.where("mcap is not null").select(F.col("token_id").alias("to_token"), "ts", "point_id", F.col("mcap").cast("double").alias("now"))
    perf = F.when((F.col("mcap") > 0) & F.col("now").isNotNull(), (F.col("now") / F.col("mcap") - 1) * 100).otherwise(0.0)
    return asof(new, points, ["to_token"], "detected_at", "ts", "point_id", ["now"]).withColumn("perf_pct", perf).drop("now")
