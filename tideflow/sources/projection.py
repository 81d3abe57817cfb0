"""Domain views over the star-schema and event tables, for the queries: trades, market, wallets, edges, signals, posts.

VIEWS holds the same views as SQL, for the queries' oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usd(x: Column) -> Column:
    """Money as exact decimals, so that sums don't depend on their order."""
    return x.cast("decimal(20,4)")


def _k() -> Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, wallet_id, token_id, action, usd, qty, ts, block, mcap (null where unknown)."""
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    return e.select(
        F.col("event_id").alias("trade_id"),
        F.col("user_id").alias("wallet_id"),
        (F.col("k") % TOKENS).alias("token_id"),
        F.when(F.col("event_type").isin("purchase", "signup", "click"), "BUY").otherwise("SELL").alias("action"),
        usd(F.col("value")).alias("usd"),
        F.expr("k div 8 + 1").alias("qty"),
        "ts",
        F.expr("event_id div 3").alias("block"),
        F.when(F.col("k") % 13 != 0, usd(F.col("value")) * 10000).cast("decimal(24,4)").alias("mcap"),
    )


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, token_id, ts, price, mcap, liquidity."""
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    v = usd(F.col("value"))
    return e.select(F.col("event_id").alias("point_id"), (F.col("k") % TOKENS).alias("token_id"), "ts", v.cast("double").alias("price"), F.when(F.col("k") % 11 != 0, v.cast("double") * 10000).alias("mcap"), F.when(F.col("k") % 17 != 0, v.cast("double") * 500).alias("liquidity"))


def wallets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wallet_id, is_watched, meets_profitable, score, labels, cluster_id (null where none)."""
    w = F.col("wallet_id")
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("wallet_id")).distinct()
    labels = F.array_compact(F.array(F.when(w % 4 == 0, "human_like"), F.when(w % 4 == 1, "smart_money"), F.when(w % 10 == 3, "possible_bot"), F.when(w % 10 == 7, "sniper")))
    return ids.select("wallet_id", (w % 3 == 0).alias("is_watched"), (w % 5 == 0).alias("meets_profitable"), (w * 37 % 101).cast("double").alias("score"), labels.alias("labels"), F.when(w % 7 == 0, w % 4).alias("cluster_id"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, src, dst, action, asset, protocol, usd, ts."""
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    n = table(spark, sf_dir, "events").agg((F.max("user_id") + 1).alias("n"))
    k = F.col("k")
    out = e.where(F.col("event_type").isin("view", "error")).join(F.broadcast(n))  # one row
    return out.select(
        F.col("event_id").alias("edge_id"),
        F.col("user_id").alias("src"),
        ((F.col("user_id") + 1 + k % 5) % F.col("n")).alias("dst"),
        F.when(k % 10 == 0, "bridge_deposit").when(k % 10 == 1, "bridge_withdrawal").otherwise("transfer").alias("action"),
        F.when(k % 3 == 0, "SOL").when(k % 3 == 1, "USDC").otherwise("TOKEN").alias("asset"),
        F.when(k % 4 == 0, "wormhole").when(k % 4 == 1, "portal").alias("protocol"),
        usd(F.col("value")).alias("usd"),
        "ts",
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """address, chain, category: a small dimension of service addresses."""
    w = F.col("wallet_id")
    ids = wallets(spark, sf_dir).where(w % 9 == 4).select("wallet_id")
    return ids.select(w.alias("address"), F.when(w % 2 == 0, "SOLANA").otherwise("BSC").alias("chain"), F.when(w % 4 == 0, "CEX").when(w % 4 == 1, "ROUTER").when(w % 4 == 2, "BRIDGE").otherwise("MIXER").alias("category"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal_id, token_id, rule, severity, fired_at, entry_price, synthetic: one fire per 13th event."""
    e = table(spark, sf_dir, "events").withColumn("k", _k()).where("event_id % 13 = 0")
    i = F.col("event_id")
    rule = F.element_at(F.array(*[F.lit(x) for x in "ABCDEFG"]), (i % 7 + 1).cast("int"))
    severity = F.element_at(F.array(F.lit("INFO"), F.lit("WATCH"), F.lit("HIGH"), F.lit("CRITICAL")), (i % 4 + 1).cast("int"))
    return e.select(i.alias("signal_id"), (F.col("k") % TOKENS).alias("token_id"), rule.alias("rule"), severity.alias("severity"), F.col("ts").alias("fired_at"), F.when(F.col("k") % 10 != 0, usd(F.col("value")).cast("double")).alias("entry_price"), (i % 5 == 0).alias("synthetic"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, author, content, posted_at: each event as a post with cashtags, addresses and links."""
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    k = F.col("k")
    address = F.concat(F.lit("So1anaToken"), F.rpad(F.repeat((k % 9 + 1).cast("string"), 24), 24, "x"))
    content = (
        F.when(k % 5 == 0, F.concat(F.lit("buy $sym"), (k % 7).cast("string"), F.lit(" and $ABC now @bob")))
        .when(k % 5 == 1, F.concat(F.lit("look "), address))
        .when(k % 5 == 2, F.concat(F.lit("see https://pump.fun/coin/"), address, F.lit(" now")))
        .when(k % 5 == 3, F.lit("gm"))
        .otherwise(F.lit("To the MOON!!! nothing else to say"))
    )
    return e.select(F.col("event_id").alias("post_id"), F.when(k % 19 != 0, F.col("user_id") % 40).alias("author"), content.alias("content"), F.col("ts").alias("posted_at"))


_K = "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"
VIEWS = f"""
ev AS (SELECT *, {_K} AS k, CAST(value AS DECIMAL(20,4)) AS v FROM events),
trades AS (SELECT event_id AS trade_id, user_id AS wallet_id, k % 8 AS token_id, CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN 'BUY' ELSE 'SELL' END AS action,
  v AS usd, CAST(k // 8 + 1 AS BIGINT) AS qty, ts, event_id // 3 AS block, CASE WHEN k % 13 <> 0 THEN CAST(v * 10000 AS DECIMAL(24,4)) END AS mcap FROM ev),
market AS (SELECT event_id AS point_id, k % 8 AS token_id, ts, CAST(v AS DOUBLE) AS price, CASE WHEN k % 11 <> 0 THEN CAST(v AS DOUBLE) * 10000 END AS mcap, CASE WHEN k % 17 <> 0 THEN CAST(v AS DOUBLE) * 500 END AS liquidity FROM ev),
wallets AS (SELECT wallet_id, wallet_id % 3 = 0 AS is_watched, wallet_id % 5 = 0 AS meets_profitable, CAST(wallet_id * 37 % 101 AS DOUBLE) AS score,
  list_filter([CASE WHEN wallet_id % 4 = 0 THEN 'human_like' END, CASE WHEN wallet_id % 4 = 1 THEN 'smart_money' END, CASE WHEN wallet_id % 10 = 3 THEN 'possible_bot' END, CASE WHEN wallet_id % 10 = 7 THEN 'sniper' END], lambda x: x IS NOT NULL) AS labels,
  CASE WHEN wallet_id % 7 = 0 THEN wallet_id % 4 END AS cluster_id FROM (SELECT DISTINCT user_id AS wallet_id FROM events)),
edges AS (SELECT event_id AS edge_id, user_id AS src, (user_id + 1 + k % 5) % (SELECT max(user_id) + 1 FROM events) AS dst,
  CASE WHEN k % 10 = 0 THEN 'bridge_deposit' WHEN k % 10 = 1 THEN 'bridge_withdrawal' ELSE 'transfer' END AS action,
  CASE WHEN k % 3 = 0 THEN 'SOL' WHEN k % 3 = 1 THEN 'USDC' ELSE 'TOKEN' END AS asset, CASE WHEN k % 4 = 0 THEN 'wormhole' WHEN k % 4 = 1 THEN 'portal' END AS protocol,
  v AS usd, ts FROM ev WHERE event_type IN ('view', 'error')),
registry AS (SELECT wallet_id AS address, CASE WHEN wallet_id % 2 = 0 THEN 'SOLANA' ELSE 'BSC' END AS chain, CASE wallet_id % 4 WHEN 0 THEN 'CEX' WHEN 1 THEN 'ROUTER' WHEN 2 THEN 'BRIDGE' ELSE 'MIXER' END AS category FROM wallets WHERE wallet_id % 9 = 4),
signals AS (SELECT event_id AS signal_id, k % 8 AS token_id, substr('ABCDEFG', CAST(event_id % 7 + 1 AS INTEGER), 1) AS rule, CASE event_id % 4 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WATCH' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
  ts AS fired_at, CASE WHEN k % 10 <> 0 THEN CAST(v AS DOUBLE) END AS entry_price, event_id % 5 = 0 AS synthetic FROM ev WHERE event_id % 13 = 0),
posts AS (SELECT event_id AS post_id, CASE WHEN k % 19 <> 0 THEN user_id % 40 END AS author,
  CASE k % 5 WHEN 0 THEN 'buy $sym' || (k % 7) || ' and $ABC now @bob' WHEN 1 THEN 'look So1anaToken' || repeat(CAST(k % 9 + 1 AS VARCHAR), 24) WHEN 2 THEN 'see https://pump.fun/coin/So1anaToken' || repeat(CAST(k % 9 + 1 AS VARCHAR), 24) || ' now'
    WHEN 3 THEN 'gm' ELSE 'To the MOON!!! nothing else to say' END AS content, ts AS posted_at FROM ev)
"""
