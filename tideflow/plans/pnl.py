"""Queries over profit and loss, and latest-per-key, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideflow.operators import pnl
from tideflow.operators import temporal as tm
from tideflow.plans.registry import query
from tideflow.settings import validated
from tideflow.sources import projection as p

#: Limits scaled to the driver's tables.
SCALED = validated({"profitable_wallet": {"pnl_30d": 40.0, "min_win_rate": 0.3, "min_realized": 20.0}})

# The oracle forms lots and sells as overlapping intervals, another formulation than the operator's.
_FIFO = """,
r AS (SELECT *, sum(CASE WHEN action = 'BUY' THEN qty ELSE 0 END) OVER w AS b, sum(CASE WHEN action = 'SELL' THEN qty ELSE 0 END) OVER w AS s FROM trades WINDOW w AS (PARTITION BY wallet_id, token_id ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, s - greatest(max(s - b) OVER (PARTITION BY wallet_id, token_id ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING), 0) AS e FROM r),
sl AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY wallet_id, token_id ORDER BY ts, trade_id), 0) AS e0 FROM d WHERE action = 'SELL'),
ov AS (SELECT sl.trade_id, sum(greatest(least(sl.e, l.b) - greatest(sl.e0, l.b - l.qty), 0) * CAST(l.usd AS DOUBLE) / l.qty) AS cost FROM sl JOIN d l ON l.action = 'BUY' AND l.wallet_id = sl.wallet_id AND l.token_id = sl.token_id AND l.b > sl.e0 AND l.b - l.qty < sl.e GROUP BY 1),
sells AS (SELECT sl.*, e - e0 AS sold, (e - e0) / qty * CAST(usd AS DOUBLE) AS proceeds, coalesce(cost, 0) AS cost, (e - e0) / qty * CAST(usd AS DOUBLE) - coalesce(cost, 0) AS realized FROM sl LEFT JOIN ov USING (trade_id)),
px AS (SELECT token_id, arg_max(price, (ts, point_id)) AS price FROM market GROUP BY 1),
ag AS (SELECT wallet_id, token_id, count(*) AS trade_count, sum(usd) AS volume, coalesce(sum(qty) FILTER (action = 'BUY'), 0) AS bought, coalesce(sum(usd) FILTER (action = 'BUY'), 0) AS paid FROM trades GROUP BY ALL),
sa AS (SELECT wallet_id, token_id, CAST(sum(CAST(round(realized, 7) AS DECIMAL(28,7))) AS DOUBLE) AS realized, count(*) FILTER (sold > 0 AND proceeds > cost + 1e-9) AS wins, count(*) AS sells, bool_or(sold < qty) AS oversold, sum(sold) AS sold, sum(cost) AS used FROM sells GROUP BY ALL),
pt AS (SELECT wallet_id, token_id, coalesce(realized, 0.0::DOUBLE) AS realized, round((bought - coalesce(sold, 0)) * price - (CAST(paid AS DOUBLE) - coalesce(used, 0)), 7) + 0.0::DOUBLE AS unrealized, round(CASE WHEN sells > 0 THEN wins / sells ELSE 0.0 END, 6) AS win_rate,
  coalesce(sells, 0) AS sells, trade_count, CAST(volume AS DOUBLE) AS volume, greatest(90 - CASE WHEN oversold THEN 20 ELSE 0 END - CASE WHEN price IS NULL THEN 15 ELSE 0 END - CASE WHEN trade_count < 4 THEN 10 ELSE 0 END, 10) AS confidence
  FROM ag LEFT JOIN sa USING (wallet_id, token_id) LEFT JOIN px USING (token_id)),
st AS (SELECT wallet_id, round(CAST(sum(CAST(round(realized, 7) AS DECIMAL(28,7))) AS DOUBLE), 7) AS realized, round(CAST(sum(CAST(round(unrealized, 7) AS DECIMAL(28,7))) AS DOUBLE), 7) AS unrealized,
  round(CASE WHEN sum(sells) > 0 THEN CAST(sum(CAST(round(win_rate * sells, 3) AS DECIMAL(20,3))) AS DOUBLE) / sum(sells) ELSE 0.0 END, 4) AS win_rate, CAST(sum(trade_count) AS BIGINT) AS trade_count,
  round(CAST(sum(CAST(volume AS DECIMAL(20,4))) AS DOUBLE) / sum(trade_count), 4) AS avg_trade_size, min(confidence) AS confidence FROM pt GROUP BY 1)
"""


def _prices(spark: SparkSession, d: str) -> DataFrame:
    return tm.latest(p.market(spark, d), ["token_id"], "ts", "point_id").select("token_id", "price")


def _pnl(spark: SparkSession, d: str) -> DataFrame:
    return pnl.fifo_pnl(p.trades(spark, d), _prices(spark, d))


@query(_FIFO + "SELECT trade_id, CAST(sold AS BIGINT) AS sold, round(realized, 7) + 0.0::DOUBLE AS realized FROM sells")
def win_cumulative_fifo(spark: SparkSession, d: str) -> DataFrame:
    return pnl.fifo_sells(p.trades(spark, d)).select("trade_id", "sold", (F.round("realized", 7) + 0.0).alias("realized"))


@query(_FIFO + "SELECT wallet_id, token_id, round(realized, 7) + 0.0::DOUBLE AS realized, unrealized, win_rate, sells, trade_count, confidence FROM pt")
def agg_fifo_pnl(spark: SparkSession, d: str) -> DataFrame:
    return _pnl(spark, d).select("wallet_id", "token_id", (F.round("realized", 7) + 0.0).alias("realized"), "unrealized", "win_rate", "sells", "trade_count", "confidence")


@query(_FIFO + "SELECT wallet_id, realized, unrealized, win_rate, trade_count, avg_trade_size, confidence FROM st")
def agg_wallet_stats(spark: SparkSession, d: str) -> DataFrame:
    return pnl.wallet_stats(_pnl(spark, d))


@query(_FIFO + "SELECT wallet_id FROM st WHERE realized + coalesce(unrealized, 0) >= 40 AND trade_count >= 8 AND win_rate >= 0.3 AND realized >= 20 AND avg_trade_size >= 50")
def flt_profitable_wallet(spark: SparkSession, d: str) -> DataFrame:
    return pnl.wallet_stats(_pnl(spark, d)).where(pnl.profitable(cfg=SCALED)).select("wallet_id")


@query(_FIFO + "SELECT wallet_id, realized, trade_count, win_rate FROM st ORDER BY realized DESC, wallet_id LIMIT 200")
def srt_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return pnl.wallet_stats(_pnl(spark, d)).select("wallet_id", "realized", "trade_count", "win_rate").orderBy(F.desc("realized"), "wallet_id").limit(200)


@query(_FIFO + "SELECT trade_id, round(CAST(sum(CAST(round(realized, 7) AS DECIMAL(28,7))) OVER (PARTITION BY wallet_id, token_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS DOUBLE), 7) + 0.0::DOUBLE AS profit FROM sells")
def rotation_exit_profit(spark: SparkSession, d: str) -> DataFrame:
    return pnl.profit_at_exit(pnl.fifo_sells(p.trades(spark, d))).select("trade_id", (F.round("profit", 7) + 0.0).alias("profit"))


@query(", n AS (SELECT wallet_id, token_id, sum(CASE WHEN action = 'BUY' THEN -usd ELSE usd END) AS net FROM trades GROUP BY ALL) SELECT wallet_id, arg_max(token_id, (net, -token_id)) AS best, arg_min(token_id, (net, token_id)) AS worst FROM n GROUP BY 1")
def agg_wallet_token_best_worst(spark: SparkSession, d: str) -> DataFrame:
    n = p.trades(spark, d).groupBy("wallet_id", "token_id").agg(F.sum(F.when(F.col("action") == "BUY", -F.col("usd")).otherwise(F.col("usd"))).alias("net"))
    return n.groupBy("wallet_id").agg(F.max_by("token_id", F.struct("net", -F.col("token_id"))).alias("best"), F.min_by("token_id", F.struct("net", "token_id")).alias("worst"))


@query("SELECT point_id, token_id, ts, price FROM market QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY ts DESC, point_id DESC) = 1")
def win_latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return tm.latest(p.market(spark, d), ["token_id"], "ts", "point_id").select("point_id", "token_id", "ts", "price")


@query("SELECT trade_id, wallet_id, usd::DOUBLE AS usd FROM trades QUALIFY row_number() OVER (PARTITION BY wallet_id ORDER BY ts DESC, trade_id DESC) = 1")
def win_latest_stats(spark: SparkSession, d: str) -> DataFrame:
    return tm.latest(p.trades(spark, d), ["wallet_id"], "ts", "trade_id").select("trade_id", "wallet_id", F.col("usd").cast("double").alias("usd"))


@query("SELECT DISTINCT ON (token_id) token_id, signal_id, rule FROM signals ORDER BY token_id, fired_at DESC, signal_id DESC")
def win_distinct_on(spark: SparkSession, d: str) -> DataFrame:
    return tm.nth_by(p.signals(spark, d), ["token_id"], [F.desc("fired_at"), F.desc("signal_id")]).select("token_id", "signal_id", "rule")


@query("SELECT token_id, point_id, price FROM market QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY ts DESC, point_id DESC) = 2")
def win_previous_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return tm.nth_by(p.market(spark, d), ["token_id"], [F.desc("ts"), F.desc("point_id")], 2).select("token_id", "point_id", "price")


@query("SELECT point_id, round(price - lag(price) OVER (PARTITION BY token_id ORDER BY ts, point_id), 6) AS delta FROM market")
def win_delta_previous(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("token_id").orderBy("ts", "point_id")
    return p.market(spark, d).select("point_id", F.round(F.col("price") - F.lag("price").over(by), 6).alias("delta"))


@query("SELECT wallet_id, min(ts) AS first_ts FROM trades GROUP BY 1")
def win_first_trade(spark: SparkSession, d: str) -> DataFrame:
    return p.trades(spark, d).groupBy("wallet_id").agg(F.min("ts").alias("first_ts"))


@query("SELECT wallet_id, token_id, arg_min(trade_id, (ts, trade_id)) AS trade_id, min(ts) AS ts, arg_min(usd, (ts, trade_id))::DOUBLE AS usd FROM trades WHERE action = 'BUY' GROUP BY ALL")
def win_first_buy_of_token(spark: SparkSession, d: str) -> DataFrame:
    m = p.trades(spark, d).where("action = 'BUY'").groupBy("wallet_id", "token_id").agg(F.min(F.struct("ts", "trade_id", "usd")).alias("m"))
    return m.select("wallet_id", "token_id", "m.trade_id", "m.ts", F.col("m.usd").cast("double").alias("usd"))


@query("SELECT dst, src, edge_id FROM edges QUALIFY row_number() OVER (PARTITION BY dst ORDER BY ts, edge_id) = 1")
def win_earliest_incoming(spark: SparkSession, d: str) -> DataFrame:
    return tm.nth_by(p.edges(spark, d), ["dst"], ["ts", "edge_id"]).select("dst", "src", "edge_id")


@query("SELECT token_id, signal_id, severity FROM signals QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'WATCH' THEN 1 ELSE 0 END DESC, fired_at DESC, signal_id) = 1")
def win_best_signal(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("severity") == "CRITICAL", 3).when(F.col("severity") == "HIGH", 2).when(F.col("severity") == "WATCH", 1).otherwise(0)
    return tm.nth_by(p.signals(spark, d), ["token_id"], [rank.desc(), F.desc("fired_at"), "signal_id"]).select("token_id", "signal_id", "severity")


@query("SELECT s.signal_id, m.price FROM signals s ASOF LEFT JOIN (SELECT token_id, ts, arg_max(price, point_id) AS price FROM market GROUP BY ALL) m ON s.token_id = m.token_id AND s.fired_at >= m.ts")
def jn_asof_entry_price(spark: SparkSession, d: str) -> DataFrame:
    return tm.asof(p.signals(spark, d), p.market(spark, d), ["token_id"], "fired_at", "ts", "point_id", ["price"]).select("signal_id", "price")


@query("SELECT s.signal_id, m.price FROM signals s ASOF LEFT JOIN (SELECT token_id, ts, arg_min(price, point_id) AS price FROM market GROUP BY ALL) m ON s.token_id = m.token_id AND s.fired_at <= m.ts")
def jn_asof_forward_entry(spark: SparkSession, d: str) -> DataFrame:
    return tm.asof(p.signals(spark, d), p.market(spark, d), ["token_id"], "fired_at", "ts", "point_id", ["price"], forward=True).select("signal_id", "price")


@query("SELECT t.trade_id, m.price, m.mcap, m.liquidity FROM trades t ASOF LEFT JOIN (SELECT token_id, ts, any_value(price) AS price, any_value(mcap) AS mcap, any_value(liquidity) AS liquidity FROM market GROUP BY token_id, ts HAVING count(*) = 1) m ON t.token_id = m.token_id AND t.ts >= m.ts")
def jn_asof_market(spark: SparkSession, d: str) -> DataFrame:
    return tm.asof(p.trades(spark, d).select("trade_id", "token_id", "ts"), p.market(spark, d), ["token_id"], "ts", "ts", "point_id", ["price", "mcap", "liquidity"]).select("trade_id", "price", "mcap", "liquidity")


@query(", m AS (SELECT token_id, ts, arg_max(mcap, point_id) AS mcap FROM market WHERE token_id <> 3 AND mcap IS NOT NULL GROUP BY ALL), a AS (SELECT s.signal_id, s.token_id, s.fired_at, m.mcap FROM signals s ASOF LEFT JOIN m ON s.token_id = m.token_id AND s.fired_at >= m.ts), f AS (SELECT token_id, arg_min(mcap, ts) AS first FROM m GROUP BY 1) SELECT signal_id, coalesce(mcap, first, 0.0::DOUBLE) AS mcap FROM a LEFT JOIN f USING (token_id)")
def src_asof_enrich(spark: SparkSession, d: str) -> DataFrame:
    m = p.market(spark, d).where("token_id <> 3 and mcap is not null")
    return tm.asof_or_first(p.signals(spark, d), m, ["token_id"], "fired_at", "ts", "point_id", "mcap", F.lit(0.0)).select("signal_id", "mcap")


@query("SELECT DISTINCT a.signal_id FROM signals a JOIN signals b ON a.token_id = b.token_id AND b.rule = 'B' AND a.rule = 'A' AND b.fired_at BETWEEN a.fired_at - INTERVAL 24 HOUR AND a.fired_at + INTERVAL 24 HOUR")
def jn_paired_fires(spark: SparkSession, d: str) -> DataFrame:
    s = p.signals(spark, d)
    a, b = s.where("rule = 'A'").select("token_id", "signal_id", F.col("fired_at").alias("at_a")), s.where("rule = 'B'").select("token_id", F.col("fired_at").alias("at_b"))
    after = tm.within(a, b, ["token_id"], "at_a", "at_b", 86400).select("signal_id")
    before = tm.within(b, a, ["token_id"], "at_b", "at_a", 86400).select("signal_id")
    return after.unionByName(before).distinct()


@query("""SELECT e.trade_id, t.edge_id FROM trades e JOIN edges t ON t.src = e.wallet_id AND t.ts BETWEEN e.ts AND e.ts + INTERVAL 24 HOUR WHERE e.action = 'SELL' AND t.action = 'transfer'""")
def jn_interval_rotation(spark: SparkSession, d: str) -> DataFrame:
    e = p.trades(spark, d).where("action = 'SELL'").select("wallet_id", "trade_id", F.col("ts").alias("exit_ts"))
    t = p.edges(spark, d).where("action = 'transfer'").select(F.col("src").alias("wallet_id"), "edge_id", F.col("ts").alias("transfer_ts"))
    return tm.within(e, t, ["wallet_id"], "exit_ts", "transfer_ts", 86400).select("trade_id", "edge_id")


@query("""SELECT token_id, rule, ts FROM (WITH RECURSIVE f AS (SELECT token_id, rule, min(fired_at) AS ts FROM signals GROUP BY ALL UNION ALL SELECT token_id, rule, ts FROM (SELECT f.token_id, f.rule, min(s.fired_at) AS ts FROM f JOIN signals s ON s.token_id = f.token_id AND s.rule = f.rule AND s.fired_at >= f.ts + INTERVAL 24 HOUR GROUP BY f.token_id, f.rule)) SELECT * FROM f)""")
def win_signal_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return tm.kept_fires(p.signals(spark, d), ["token_id", "rule"], "fired_at").withColumnRenamed("fired_at", "ts")


@query("""SELECT signal_id, before IS NULL OR epoch_us(fired_at) - epoch_us(before) >= 1800000000 OR (severity = 'CRITICAL' AND was <> 'CRITICAL') AS allowed FROM (SELECT *, lag(fired_at) OVER w AS before, lag(severity) OVER w AS was FROM signals WINDOW w AS (PARTITION BY token_id ORDER BY fired_at, signal_id))""")
def win_alert_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """Skipped alerts leave rows too, so the last alert is the row before."""
    by = Window.partitionBy("token_id").orderBy("fired_at", "signal_id")
    s = p.signals(spark, d).withColumn("before", F.lag("fired_at").over(by)).withColumn("was", F.lag("severity").over(by))
    gap = F.unix_micros(F.col("fired_at").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    return s.select("signal_id", (F.col("before").isNull() | (gap >= 1_800_000_000) | ((F.col("severity") == "CRITICAL") & (F.col("was") != "CRITICAL"))).alias("allowed"))
