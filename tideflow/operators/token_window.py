"""Per-token window aggregates over trades, and the scores and rules that read them.

A token's window ends at its latest trade (or now, if that is earlier) and both ends are inclusive. All tokens are
aggregated in one pass: trades are reduced to one row a wallet and token first, so later steps see small groups.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideflow.settings import DEFAULTS

EXITED = 80.0
TOP_HOLDERS = 5


def _sum_if(cond: Column, x: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, x)), F.lit(0)).cast("decimal(24,4)")


def anchored(trades: DataFrame, minutes: int, now: str | None = None) -> DataFrame:
    """trades with to_ts, from_ts and before_ts (the start of the equally long window before)."""
    ends = trades.groupBy("token_id").agg(F.max("ts").alias("last"))
    to = F.least("last", F.lit(now).cast("timestamp_ntz")) if now else F.col("last")
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    ends = ends.select("token_id", to.alias("to_ts")).withColumn("from_ts", F.col("to_ts") - step).withColumn("before_ts", F.col("to_ts") - step - step)
    return trades.join(ends, "token_id")


def wallet_window(trades: DataFrame, minutes: int, now: str | None = None) -> DataFrame:
    """One row a (token, wallet): what it bought and sold in the window, before it and in the trailing windows."""
    t = anchored(trades, minutes, now)
    inside, buy = F.col("ts").between(F.col("from_ts"), F.col("to_ts")), F.col("action") == "BUY"
    before = F.col("ts") < F.col("from_ts")
    first = F.min(F.when(inside & buy, F.struct("ts", "trade_id", "block")))
    known = inside & buy & F.col("mcap").isNotNull()

    def recent(m: int) -> Column:
        return F.coalesce(F.bool_or(buy & F.col("ts").between(F.col("to_ts") - F.expr(f"INTERVAL {m} MINUTES"), F.col("to_ts"))), F.lit(False))

    return t.groupBy("token_id", "wallet_id", "to_ts", "from_ts").agg(
        _sum_if(inside & buy, F.col("usd")).alias("buy_usd"),
        _sum_if(inside & ~buy, F.col("usd")).alias("sell_usd"),
        first.alias("first_buy"),
        F.max(F.when(inside & buy, F.col("usd"))).alias("max_buy"),
        _sum_if((F.col("ts") >= F.col("before_ts")) & before & buy, F.col("usd")).alias("trailing_usd"),
        (_sum_if(before & buy, F.col("usd")) - _sum_if(before & ~buy, F.col("usd"))).alias("held_usd"),
        F.min("ts").alias("first_ts"),
        F.sum(F.when(known, F.col("usd").cast("decimal(14,4)") * F.col("mcap").cast("decimal(18,4)"))).alias("mcap_weight"),
        _sum_if(known, F.col("usd")).alias("mcap_usd"),
        recent(30).alias("in_30m"),
        recent(60).alias("in_60m"),
        recent(360).alias("in_360m"),
        F.bool_or(inside).alias("in_window"),
    )


def market_window(trades: DataFrame, market: DataFrame, minutes: int, now: str | None = None) -> DataFrame:
    """Per token: the latest point at the window's end, liquidity at its start, and the token's age in days."""
    ends = anchored(trades, minutes, now).select("token_id", "to_ts", "from_ts").distinct()
    m = market.join(ends, "token_id")
    point = F.struct("ts", "point_id", "mcap", "liquidity")
    out = m.groupBy("token_id").agg(
        F.max(F.when(F.col("ts") <= F.col("to_ts"), point)).alias("end"),
        F.max(F.when(F.col("ts") <= F.col("from_ts"), point)).alias("start"),
        ((F.unix_micros(F.max("to_ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 86_400_000_000.0).alias("age_days"),
    )
    liquidity, start = F.col("end.liquidity"), F.col("start.liquidity")
    return out.select("token_id", F.col("end.mcap").alias("current_mcap"), liquidity.alias("liquidity"), F.when(start > 0, (liquidity - start) / start * 100).alias("liquidity_change_pct"), "age_days")


def token_window(trades: DataFrame, wallets: DataFrame, market: DataFrame, minutes: int = 1440, whale_usd: float = 10000.0, spike_mult: float = 3.0, now: str | None = None) -> DataFrame:
    """One row a token: all aggregates that scores and rules read."""
    w = wallet_window(trades, minutes, now).join(wallets, "wallet_id", "left")
    tracked = F.col("is_watched").isNotNull()
    buyer = F.col("first_buy").isNotNull()
    smart = F.coalesce(F.col("is_watched") | F.col("meets_profitable"), F.lit(False))
    holder = F.col("held_usd") > 0
    sold_held = F.col("sell_usd").cast("double") / F.when(holder, F.col("held_usd").cast("double")) * 100 >= EXITED
    sold_own = F.col("sell_usd").cast("double") / F.when(F.col("buy_usd") > 0, F.col("buy_usd").cast("double")) * 100 >= EXITED
    label = lambda *names: F.coalesce(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in names])), F.lit(False))
    half = F.col("from_ts") + F.expr(f"INTERVAL {minutes * 30} SECONDS")
    rank = F.row_number().over(Window.partitionBy("token_id").orderBy(F.when(holder, F.col("held_usd")).desc_nulls_last(), "wallet_id"))
    w = w.withColumn("rank", rank)
    # A window's block with most buyers, and the largest cluster among smart buyers, from small per-token groups.
    blocks = w.where(buyer).groupBy("token_id", "first_buy.block").count().groupBy("token_id").agg(F.max("count").alias("block_buyers"))
    clusters = w.where(buyer & smart & F.col("cluster_id").isNotNull()).groupBy("token_id", "cluster_id").count().groupBy("token_id").agg(F.max("count").alias("largest_cluster"), F.count("*").alias("clusters"))
    buy = F.coalesce(F.sum(F.when(tracked, F.col("buy_usd"))), F.lit(0)).cast("decimal(24,4)")
    sell = F.coalesce(F.sum(F.when(tracked, F.col("sell_usd"))), F.lit(0)).cast("decimal(24,4)")
    out = w.groupBy("token_id").agg(
        F.count_if(buyer).alias("buyers"),
        F.count_if(buyer & (F.col("sell_usd") > 0)).alias("sold_buyers"),
        buy.alias("buy_usd"),
        sell.alias("sell_usd"),
        F.count_if(buyer & smart).alias("smart"),
        F.count_if(buyer & label("human_like")).alias("human"),
        F.count_if(buyer & label("human_like", "smart_money")).alias("human_or_smart"),
        F.count_if(buyer & label("possible_bot")).alias("bots"),
        F.count_if(F.col("max_buy") >= F.lit(whale_usd).cast("decimal(20,4)")).alias("whales"),
        F.count_if(buyer & smart & F.col("cluster_id").isNull()).alias("unclustered"),
        F.sum(F.when(tracked, F.col("mcap_weight"))).alias("mcap_weight"),
        F.sum(F.when(tracked, F.col("mcap_usd"))).alias("mcap_usd"),
        F.coalesce(F.sum(F.when(tracked, F.col("trailing_usd"))), F.lit(0)).cast("decimal(24,4)").alias("trailing_usd"),
        F.count_if(smart & holder).alias("smart_holders"),
        F.count_if(smart & holder & sold_held).alias("smart_holders_out"),
        F.count_if(smart & buyer & ~holder).alias("smart_new"),
        F.count_if(smart & buyer & ~holder & F.coalesce(sold_own, F.lit(False))).alias("smart_new_out"),
        F.count_if((F.col("rank") <= TOP_HOLDERS) & holder & sold_held).alias("top_exits"),
        F.count_if(buyer & smart & (F.col("first_ts") == F.col("first_buy.ts"))).alias("new_smart"),
        F.count_if(buyer & (F.col("first_buy.ts") < half)).alias("early_buyers"),
        F.count_if(tracked & F.col("in_30m")).alias("buyers_30m"),
        F.count_if(tracked & F.col("in_60m")).alias("buyers_60m"),
        F.count_if(tracked & F.col("in_360m")).alias("buyers_360m"),
        F.avg(F.when(buyer, F.coalesce("score", F.lit(0.0)))).alias("avg_score"),
    )
    out = out.join(blocks, "token_id", "left").join(clusters, "token_id", "left").join(market_window(trades, market, minutes, now), "token_id", "left")
    b, s = F.col("buy_usd").cast("double"), F.col("sell_usd").cast("double")
    entry = F.when(F.col("mcap_usd") > 0, F.round(F.col("mcap_weight").cast("double") / F.col("mcap_usd").cast("double"), 4))
    exited = F.col("smart_holders") + F.col("smart_new")
    return out.select(
        "token_id", "buyers", b.alias("buy_usd"), s.alias("sell_usd"), (F.col("buy_usd") - F.col("sell_usd")).cast("double").alias("net_usd"),
        F.round(F.when(s > 0, b / s).when(b > 0, 999.0).otherwise(0.0), 6).alias("buy_sell_ratio"),
        "smart", "human", "human_or_smart", "bots", "whales",
        (F.coalesce("clusters", F.lit(0)) + F.col("unclustered")).alias("entities"), F.coalesce("largest_cluster", F.lit(0)).alias("largest_cluster"),
        entry.alias("avg_entry_mcap"), "current_mcap", F.round(F.when(entry > 0, F.col("current_mcap") / entry - 1), 6).alias("expansion"),
        "liquidity", F.round("liquidity_change_pct", 6).alias("liquidity_change_pct"), F.round("age_days", 6).alias("age_days"),
        F.col("trailing_usd").cast("double").alias("trailing_usd"), ((F.col("trailing_usd") > 0) & (b >= spike_mult * F.col("trailing_usd").cast("double"))).alias("spike"),
        F.round(F.when(exited > 0, (F.col("smart_holders_out") + F.col("smart_new_out")) * 100.0 / exited).otherwise(0.0), 6).alias("exited_smart_pct"),
        "top_exits", "new_smart", "early_buyers", "buyers_30m", "buyers_60m", "buyers_360m",
        F.round(F.when(F.col("buyers") > 0, F.col("sold_buyers") * 100.0 / F.col("buyers")).otherwise(0.0), 6).alias("sold_pct"),
        F.round(F.when(F.col("buyers") > 0, F.coalesce("block_buyers", F.lit(0)) * 100.0 / F.col("buyers")).otherwise(0.0), 6).alias("block_pct"),
        F.round(F.coalesce("avg_score", F.lit(0.0)), 6).alias("avg_score"),
    )


def _clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def flow_score(agg: DataFrame, penalty: float = 0.0, mcap_min: float = 100000.0, mcap_max: float = 5000000.0) -> Column:
    """The token's 0 to 100 score with one decimal; the human part and the expansion part aren't clamped by themselves."""
    c = F.col
    parts = [
        F.least(c("smart") / 40, F.lit(1.0)) * 20,
        F.least(c("entities") / 25, F.lit(1.0)) * 15,
        _clamp(c("net_usd") / 50000) * 15,
        c("avg_score") / 100 * 15,
        c("human") / F.greatest(c("smart"), F.lit(1)) * 10,
        F.coalesce((1 - _clamp((c("avg_entry_mcap") - mcap_min) / (mcap_max - mcap_min))) * 10, F.lit(0.0)),
        F.when(c("expansion").isNull(), 0.0).otherwise((1 - F.least(c("expansion") / 2, F.lit(1.0))) * 10),
        F.lit((1 - penalty) * 5),
    ]
    return F.round(_clamp(F.round(reduce(lambda a, b: a + b, parts), 9), 0.0, 100.0), 1)


def wallet_score(pnl: Column, win_rate: Column, trades: Column, human: Column, entry: Column, hold: Column, recent: Column, bot: Column, confidence: Column) -> Column:
    total = _clamp(pnl / 10000) * 25 + _clamp(win_rate / 0.7) * 15 + _clamp(trades / 30) * 10 + human * 15 + entry * 10 + hold * 10 + recent * 15
    return _clamp((total - 30 * bot) * (0.5 + 0.5 * confidence / 100), 0.0, 100.0)


def rules(cfg: dict[str, Any] | None = None) -> dict[str, Column]:
    """The rules that read the aggregate alone: whether each fires."""
    r = (cfg or DEFAULTS)["rules"]
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    multiple = F.when(c("buy_usd") > 0, c("sell_usd") / c("buy_usd") * 100).otherwise(0.0)
    return {
        "A": c("smart") >= r["A"]["watch_min_wallets"],
        "B": (c("early_buyers") >= r["B"]["base_wallets"]) & (c("smart") >= r["B"]["target_wallets"]) & yes(c("expansion") + 1 <= r["B"]["max_expansion"]) & (multiple <= r["B"]["max_sell_to_buy_pct"]),
        "C": (c("buyers") > 0) & (c("human_or_smart") >= r["C"]["min_human_ratio"] * c("buyers")) & (c("bots") <= r["C"]["max_bot_ratio"] * c("buyers")) & (c("block_pct") <= r["C"]["max_block_pct"]),
        "D": (c("whales") > 0) & (c("smart") >= r["D"]["min_wallets"]) & (c("buy_sell_ratio") > r["D"]["min_ratio"]),
        "G": (c("exited_smart_pct") >= r["G"]["min_exited_pct"])
        | ((c("net_usd") < 0) & (c("top_exits") >= r["G"]["min_top_exits"]))
        | yes(c("liquidity_change_pct") <= -r["G"]["liquidity_drop_pct"])
        | (yes(c("expansion") >= r["G"]["pump_pct"] / 100) & (c("new_smart") < r["G"]["max_new_smart"])),
    }


def severity_a(cfg: dict[str, Any] | None = None) -> Column:
    a = (cfg or DEFAULTS)["rules"]["A"]
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    high = (c("smart") >= a["min_wallets"]) & (c("buy_usd") >= a["min_buy_volume"]) & (c("net_usd") > 0) & (c("sold_pct") < a["max_sold_pct"]) & yes(c("current_mcap").between(a["mcap_min"], a["mcap_max"])) & yes(c("liquidity") >= a["min_liquidity"]) & (yes(c("age_days") < a["max_age_days"]) | c("spike"))
    return F.when(c("smart") < a["watch_min_wallets"], "INFO").when(high, "HIGH").otherwise("WATCH")


def signal_status(fired: dict[str, Column], score: Column, volume_30m: Column) -> Column:
    """Exit signs come before rotation, rotation before accumulation; then dead or watching."""
    any_ = reduce(lambda a, b: a | b, [fired[k] for k in "ABCDE" if k in fired])
    return F.when(fired["G"], "distribution").when(fired.get("F", F.lit(False)), "rotation").when(any_, "accumulating").when((score < 10) & (volume_30m == 0), "dead").otherwise("watching")
