"""FIFO profit and loss without a loop: sells consume intervals of the cumulative bought quantity.

For each (wallet, token) in time order, B and S are the running bought and sold quantities. What is oversold drops out:
D is the running maximum of S - B (0 at least), and E = S - D is what has been consumed by then. The cost of the first x
units, C(x), is linear inside each lot, so a sell's cost is C(E after) - C(E before). C is looked up by one sort of lots
and sells on the bought-quantity axis, so the work is linear in a group's trades (up to the sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("wallet_id", "token_id")


def fifo_sells(trades: DataFrame) -> DataFrame:
    """One row a sell: wallet_id, token_id, trade_id, ts, usd, qty, sold (units that had lots), proceeds, cost, realized."""
    by = Window.partitionBy(*KEY).orderBy("ts", "trade_id")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    buy = F.col("action") == "BUY"
    t = trades.where((F.col("qty") > 0) | ~buy)
    t = t.withColumn("b", F.sum(F.when(buy, F.col("qty")).otherwise(0)).over(so_far)).withColumn("s", F.sum(F.when(~buy, F.col("qty")).otherwise(0)).over(so_far))
    t = t.withColumn("paid", F.sum(F.when(buy, F.col("usd")).otherwise(0)).over(so_far).cast("double"))
    t = t.withColumn("e", F.col("s") - F.greatest(F.max(F.col("s") - F.col("b")).over(so_far), F.lit(0)))
    lot = F.struct((F.col("b") - F.col("qty")).alias("lo"), (F.col("paid") - F.col("usd").cast("double")).alias("base"), (F.col("usd").cast("double") / F.col("qty")).alias("unit"))
    rows = t.select(*KEY, "ts", "trade_id", "usd", "qty", "action", F.when(buy, F.col("b") - F.col("qty")).otherwise(F.col("e")).alias("at"), F.when(buy, lot).alias("lot"), "e", F.when(buy, 0).otherwise(1).alias("kind"))
    along = Window.partitionBy(*KEY).orderBy("at", "kind", "ts", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("lot", ignorenulls=True).over(along)
    sells = rows.withColumn("in_lot", found).where("action = 'SELL'").withColumn("c", F.coalesce(F.col("in_lot.base") + (F.col("e") - F.col("in_lot.lo")) * F.col("in_lot.unit"), F.lit(0.0)))
    before = Window.partitionBy(*KEY).orderBy("ts", "trade_id")
    sells = sells.withColumn("sold", F.col("e") - F.coalesce(F.lag("e").over(before), F.lit(0))).withColumn("cost", F.col("c") - F.coalesce(F.lag("c").over(before), F.lit(0.0)))
    sells = sells.withColumn("proceeds", F.when(F.col("qty") > 0, F.col("sold") / F.col("qty") * F.col("usd").cast("double")).otherwise(0.0))
    return sells.select(*KEY, "trade_id", "ts", "usd", "qty", "sold", "proceeds", "cost", (F.col("proceeds") - F.col("cost")).alias("realized"), F.col("c").alias("cost_to_date"))


def fifo_pnl(trades: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """One row a (wallet, token): realized, unrealized (null without a price), win_rate, trade_count, confidence."""
    sells = fifo_sells(trades).groupBy(*KEY).agg(
        F.sum(F.round("realized", 7).cast("decimal(28,7)")).cast("double").alias("realized"),
        F.count_if((F.col("sold") > 0) & (F.col("proceeds") > F.col("cost") + 1e-9)).alias("wins"),
        F.count("*").alias("sells"),
        F.bool_or(F.col("sold") < F.col("qty")).alias("oversold"),
        F.sum("sold").alias("sold"),
        F.max("cost_to_date").alias("consumed_cost"),
    )
    buy = F.col("action") == "BUY"
    every = trades.groupBy(*KEY).agg(F.count("*").alias("trade_count"), F.sum("usd").cast("double").alias("volume"), F.coalesce(F.sum(F.when(buy, F.col("qty"))), F.lit(0)).alias("bought"), F.coalesce(F.sum(F.when(buy, F.col("usd"))), F.lit(0)).cast("double").alias("paid"))
    out = every.join(sells, list(KEY), "left")
    out = out.join(prices, "token_id", "left") if prices is not None else out.withColumn("price", F.lit(None).cast("double"))
    sells_n = F.coalesce("sells", F.lit(0))
    confidence = 90 - F.when(F.coalesce("oversold", F.lit(False)), 20).otherwise(0) - F.when(F.col("price").isNull(), 15).otherwise(0) - F.when(F.col("trade_count") < 4, 10).otherwise(0)
    return out.select(
        *KEY,
        F.coalesce("realized", F.lit(0.0)).alias("realized"),
        (F.round((F.col("bought") - F.coalesce("sold", F.lit(0))) * F.col("price") - (F.col("paid") - F.coalesce("consumed_cost", F.lit(0.0))), 7) + 0.0).alias("unrealized"),
        F.round(F.when(sells_n > 0, F.col("wins") / sells_n).otherwise(0.0), 6).alias("win_rate"),
        sells_n.alias("sells"),
        "trade_count",
        "volume",
        F.greatest(confidence, F.lit(10)).cast("int").alias("confidence"),
    )


def wallet_stats(per_token: DataFrame) -> DataFrame:
    """One row a wallet: sums over tokens, win rate weighted by sells, least confidence."""
    total = F.sum("sells")
    return per_token.groupBy("wallet_id").agg(
        F.round(F.sum(F.round("realized", 7).cast("decimal(28,7)")).cast("double"), 7).alias("realized"),
        F.round(F.sum(F.round("unrealized", 7).cast("decimal(28,7)")).cast("double"), 7).alias("unrealized"),
        F.round(F.when(total > 0, F.sum(F.round(F.col("win_rate") * F.col("sells"), 3).cast("decimal(20,3)")).cast("double") / total).otherwise(0.0), 4).alias("win_rate"),
        F.sum("trade_count").alias("trade_count"),
        F.round(F.sum(F.col("volume").cast("decimal(20,4)")).cast("double") / F.sum("trade_count"), 4).alias("avg_trade_size"),
        F.min("confidence").alias("confidence"),
    )


def profit_at_exit(sells: DataFrame) -> DataFrame:
    """Each sell with the profit realized on its (wallet, token) up to its time, equal times included."""
    by = Window.partitionBy(*KEY).orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    return sells.withColumn("profit", F.sum(F.round("realized", 7).cast("decimal(28,7)")).over(by).cast("double")).select(*KEY, "trade_id", "ts", "profit")


def profitable(realized: str = "realized", cfg: dict | None = None) -> F.Column:
    """The five thresholds of a profitable wallet, all of them."""
    from tideflow.settings import DEFAULTS

    c = (cfg or DEFAULTS)["profitable_wallet"]
    pnl = F.col("realized") + F.coalesce("unrealized", F.lit(0.0))
    return (pnl >= c["pnl_30d"]) & (F.col("trade_count") >= c["min_trades"]) & (F.col("win_rate") >= c["min_win_rate"]) & (F.col(realized) >= c["min_realized"]) & (F.col("avg_trade_size") >= c["min_avg_trade_size"])
