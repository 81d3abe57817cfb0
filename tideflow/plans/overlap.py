"""Overlap, warehouse-style trader reports, and set operations over wallets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.operators import overlap as ov
from tideflow.plans.registry import query
from tideflow.sources import projection as p

_SIDES = "CAST(coalesce(sum(usd) FILTER (action = 'BUY'), 0) AS DOUBLE) AS buy_usd, CAST(coalesce(sum(usd) FILTER (action = 'SELL'), 0) AS DOUBLE) AS sell_usd"


def _o(name: str, tokens: str, least: int) -> str:
    return f", {name} AS (SELECT *, CASE WHEN sell_usd > 0 THEN round(sell_usd - buy_usd, 4) END AS pnl FROM (SELECT wallet_id, count(DISTINCT token_id) FILTER (action = 'BUY') AS n_tokens, {_SIDES}, count(*) AS trades, min(ts) FILTER (action = 'BUY') AS first_buy FROM trades WHERE token_id IN ({tokens}) GROUP BY 1) WHERE n_tokens >= {least})\n"


_L, _E = _o("ol", "1, 2, 3", 2), _o("oe", "3, 4, 5", 2)


def _local(spark: SparkSession, d: str) -> DataFrame:
    return ov.overlap_wallets(p.trades(spark, d), [1, 2, 3], 2)


@query(_L + "SELECT * FROM ol")
def agg_overlap_wallet(spark: SparkSession, d: str) -> DataFrame:
    return _local(spark, d)


@query(", s AS (SELECT wallet_id, string_agg(DISTINCT token_id, '|' ORDER BY token_id) AS token_set FROM trades WHERE action = 'BUY' AND token_id IN (1, 2, 3) GROUP BY 1) SELECT token_set, count(*) AS size, min(wallet_id) AS first_wallet FROM s GROUP BY 1 HAVING count(*) >= 2")
def agg_overlap_groups(spark: SparkSession, d: str) -> DataFrame:
    return ov.overlap_groups(p.trades(spark, d), [1, 2, 3])


@query(_L + "SELECT wallet_id, n_tokens = 3 AS traded_all, n_tokens = 3 AND first_buy <= min(first_buy) OVER () + INTERVAL 24 HOUR AS bought_all_early, pnl IS NOT NULL AS has_pnl FROM ol")
def flt_overlap_views(spark: SparkSession, d: str) -> DataFrame:
    o = _local(spark, d)
    early = o.agg(F.min("first_buy").alias("earliest"))  # one row
    every = F.col("n_tokens") == 3
    return o.join(F.broadcast(early)).select("wallet_id", every.alias("traded_all"), (every & (F.col("first_buy") <= F.col("earliest") + F.expr("INTERVAL 24 HOURS"))).alias("bought_all_early"), F.col("pnl").isNotNull().alias("has_pnl"))


@query(_L + "SELECT wallet_id, pnl, n_tokens FROM ol ORDER BY pnl DESC NULLS LAST, n_tokens DESC, wallet_id LIMIT 500")
def srt_overlap_view(spark: SparkSession, d: str) -> DataFrame:
    return _local(spark, d).select("wallet_id", "pnl", "n_tokens").orderBy(F.desc_nulls_last("pnl"), F.desc("n_tokens"), "wallet_id").limit(500)


@query(_L + "SELECT count(*) AS found, count(*) > 100 AS truncated FROM ol")
def srt_overlap_truncate(spark: SparkSession, d: str) -> DataFrame:
    return _local(spark, d).agg(F.count("*").alias("found")).withColumn("truncated", F.col("found") > 100)


@query(_L + _E + "SELECT wallet_id, n_tokens, buy_usd, is_local FROM (SELECT wallet_id, n_tokens, buy_usd, true AS is_local FROM ol UNION ALL SELECT wallet_id, n_tokens, buy_usd, false FROM oe) QUALIFY row_number() OVER (PARTITION BY wallet_id ORDER BY n_tokens DESC, is_local DESC) = 1")
def jn_hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    keep = ("wallet_id", "n_tokens", "buy_usd")
    return ov.merged(_local(spark, d).select(*keep), ov.overlap_wallets(p.trades(spark, d), [3, 4, 5], 2).select(*keep))


@query(_L + _E + "SELECT wallet_id, n_tokens FROM ol UNION ALL SELECT wallet_id, n_tokens FROM oe")
def set_union_all(spark: SparkSession, d: str) -> DataFrame:
    return _local(spark, d).select("wallet_id", "n_tokens").unionByName(ov.overlap_wallets(p.trades(spark, d), [3, 4, 5], 2).select("wallet_id", "n_tokens"))


@query("SELECT coalesce(b.wallet_id, s.wallet_id) AS wallet_id, coalesce(bought, 0) AS bought, coalesce(sold, 0) AS sold FROM (SELECT wallet_id, count(*) AS bought FROM trades WHERE action = 'BUY' GROUP BY 1) b FULL JOIN (SELECT wallet_id, count(*) AS sold FROM trades WHERE action = 'SELL' GROUP BY 1) s ON b.wallet_id = s.wallet_id")
def jn_full_outer_buys_sells(spark: SparkSession, d: str) -> DataFrame:
    """One conditional aggregate gives what a full join of both sides would, with one shuffle."""
    return p.trades(spark, d).groupBy("wallet_id").agg(F.count_if(ov.bought()).alias("bought"), F.count_if(ov.sold()).alias("sold"))


@query(", c AS (SELECT DISTINCT a.wallet_id AS a, b.wallet_id AS b, a.token_id FROM trades a JOIN trades b ON a.token_id = b.token_id AND a.wallet_id < b.wallet_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000) SELECT a, b, count(*) AS n_tokens FROM c GROUP BY 1, 2")
def jn_self_cotraders(spark: SparkSession, d: str) -> DataFrame:
    return ov.cotraders(p.trades(spark, d), least=1)


@query(", c AS (SELECT DISTINCT a.wallet_id AS a, b.wallet_id AS b, a.token_id FROM trades a JOIN trades b ON a.token_id = b.token_id AND a.wallet_id < b.wallet_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000) SELECT a, b, count(*) AS n_tokens FROM c GROUP BY 1, 2 HAVING count(*) >= 2")
def agg_recurring_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ov.cotraders(p.trades(spark, d))


_LAUNCH = ", la AS (SELECT token_id, min(ts) AS launch FROM trades GROUP BY 1)"


@query(_LAUNCH + "SELECT wallet_id, count(DISTINCT token_id) AS n_tokens FROM trades JOIN la USING (token_id) WHERE action = 'BUY' AND ts <= launch + INTERVAL 24 HOUR GROUP BY 1")
def jn_launch_window(spark: SparkSession, d: str) -> DataFrame:
    return ov.early_buyers(p.trades(spark, d), least=1)


@query(_LAUNCH + "SELECT wallet_id, count(DISTINCT token_id) AS n_tokens FROM trades JOIN la USING (token_id) WHERE action = 'BUY' AND ts <= launch + INTERVAL 24 HOUR GROUP BY 1 HAVING count(DISTINCT token_id) >= 2")
def agg_early_overlap(spark: SparkSession, d: str) -> DataFrame:
    return ov.early_buyers(p.trades(spark, d))


@query("SELECT wallet_id, count(DISTINCT token_id) AS n_tokens FROM trades GROUP BY 1 HAVING count(DISTINCT token_id) >= 3")
def agg_token_overlap_sql(spark: SparkSession, d: str) -> DataFrame:
    return p.trades(spark, d).groupBy("wallet_id").agg(F.count_distinct("token_id").alias("n_tokens")).where("n_tokens >= 3")


@query(f"SELECT wallet_id, {_SIDES}, count(*) AS trades FROM trades WHERE token_id = 1 GROUP BY 1")
def agg_top_traders_sql(spark: SparkSession, d: str) -> DataFrame:
    return p.trades(spark, d).where("token_id = 1").groupBy("wallet_id").agg(ov.side_sum(ov.bought()).alias("buy_usd"), ov.side_sum(ov.sold()).alias("sell_usd"), F.count("*").alias("trades"))


@query(", b AS (SELECT token_id, wallet_id, CAST(sum(usd) AS DOUBLE) AS buy_usd FROM trades WHERE token_id = 1 AND action = 'BUY' GROUP BY ALL) SELECT wallet_id, buy_usd FROM b ORDER BY buy_usd DESC, wallet_id LIMIT 20")
def srt_token_top_buyers(spark: SparkSession, d: str) -> DataFrame:
    b = p.trades(spark, d).where((F.col("token_id") == 1) & ov.bought()).groupBy("wallet_id").agg(F.sum("usd").cast("double").alias("buy_usd"))
    return b.orderBy(F.desc("buy_usd"), "wallet_id").limit(20)


@query(f", m AS (SELECT max(ts) - INTERVAL 30 DAY AS since FROM trades) SELECT wallet_id, {_SIDES}, count(DISTINCT date_trunc('day', ts)) AS active_days FROM trades, m WHERE ts >= since GROUP BY 1")
def agg_wallet_pnl_30d(spark: SparkSession, d: str) -> DataFrame:
    t = p.trades(spark, d)
    since = F.broadcast(t.agg((F.max("ts") - F.expr("INTERVAL 30 DAYS")).alias("since")))  # one row
    return t.join(since, F.col("ts") >= F.col("since")).groupBy("wallet_id").agg(ov.side_sum(ov.bought()).alias("buy_usd"), ov.side_sum(ov.sold()).alias("sell_usd"), F.count_distinct(F.date_trunc("day", "ts")).alias("active_days"))


@query(f", b AS (SELECT token_id, wallet_id, {_SIDES} FROM trades GROUP BY ALL) SELECT token_id, b.wallet_id, buy_usd, sell_usd, score, array_to_string(labels, ',') AS labels FROM b JOIN wallets USING (wallet_id) WHERE buy_usd > 0")
def agg_buyer_table(spark: SparkSession, d: str) -> DataFrame:
    b = p.trades(spark, d).groupBy("token_id", "wallet_id").agg(ov.side_sum(ov.bought()).alias("buy_usd"), ov.side_sum(ov.sold()).alias("sell_usd")).where("buy_usd > 0")
    return b.join(p.wallets(spark, d), "wallet_id").select("token_id", "wallet_id", "buy_usd", "sell_usd", "score", F.array_join("labels", ",").alias("labels"))


@query("SELECT s.signal_id FROM signals s WHERE NOT EXISTS (SELECT 1 FROM signals a WHERE a.token_id = s.token_id AND a.rule = s.rule AND a.severity = 'CRITICAL')")
def flt_pending_alerts(spark: SparkSession, d: str) -> DataFrame:
    s = p.signals(spark, d)
    return s.join(s.where("severity = 'CRITICAL'").select("token_id", "rule"), ["token_id", "rule"], "left_anti").select("signal_id")


@query("SELECT wallet_id FROM wallets w WHERE EXISTS (SELECT 1 FROM trades t WHERE t.wallet_id = w.wallet_id)")
def flt_has_trades(spark: SparkSession, d: str) -> DataFrame:
    return p.wallets(spark, d).join(p.trades(spark, d).select("wallet_id"), "wallet_id", "left_semi").select("wallet_id")


@query("SELECT wallet_id FROM wallets WHERE is_watched OR meets_profitable")
def flt_smart_wallet(spark: SparkSession, d: str) -> DataFrame:
    return p.wallets(spark, d).where("is_watched or meets_profitable").select("wallet_id")


@query("SELECT wallet_id FROM wallets WHERE list_contains(labels, 'possible_bot') OR (list_contains(labels, 'sniper') AND NOT list_has_any(labels, ['human_like', 'smart_money']))")
def flt_bot_labels(spark: SparkSession, d: str) -> DataFrame:
    offset = F.arrays_overlap("labels", F.array(F.lit("human_like"), F.lit("smart_money")))
    return p.wallets(spark, d).where(F.array_contains("labels", "possible_bot") | (F.array_contains("labels", "sniper") & ~offset)).select("wallet_id")


@query("SELECT trade_id FROM trades WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11'")
def flt_time_window(spark: SparkSession, d: str) -> DataFrame:
    return p.trades(spark, d).where("ts between TIMESTAMP_NTZ '2024-01-10 00:00:00' and TIMESTAMP_NTZ '2024-01-11 00:00:00'").select("trade_id")


@query("SELECT t.trade_id, w.score, w.cluster_id FROM trades t LEFT JOIN wallets w USING (wallet_id)")
def jn_wallet_dim(spark: SparkSession, d: str) -> DataFrame:
    return p.trades(spark, d).join(p.wallets(spark, d), "wallet_id", "left").select("trade_id", "score", "cluster_id")


@query("SELECT wallet_id, category FROM wallets LEFT JOIN registry ON address = wallet_id QUALIFY row_number() OVER (PARTITION BY wallet_id ORDER BY chain DESC NULLS LAST) = 1")
def jn_registry(spark: SparkSession, d: str) -> DataFrame:
    r = p.registry(spark, d).groupBy(F.col("address").alias("wallet_id")).agg(F.max_by("category", "chain").alias("category"))
    return p.wallets(spark, d).join(r, "wallet_id", "left").select("wallet_id", "category")


@query("SELECT CASE WHEN address // 9 % 3 = 0 THEN 'seed' WHEN address // 9 % 3 = 1 THEN 'import' ELSE 'manual' END AS source, count(*) AS n FROM registry GROUP BY 1")
def agg_registry_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows by their source (an address's remainder stands for it)."""
    a = F.floor(F.col("address") / 9) % 3
    return p.registry(spark, d).groupBy(F.when(a == 0, "seed").when(a == 1, "import").otherwise("manual").alias("source")).agg(F.count("*").alias("n"))


@query("SELECT src AS a, dst AS b FROM edges WHERE action = 'transfer' UNION SELECT dst, src FROM edges WHERE action <> 'transfer'")
def set_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    e, plain = p.edges(spark, d), F.col("action") == "transfer"
    return e.select(F.when(plain, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(plain, F.col("dst")).otherwise(F.col("src")).alias("b")).distinct()


@query("SELECT DISTINCT src AS wallet_id FROM edges")
def set_distinct(spark: SparkSession, d: str) -> DataFrame:
    return p.edges(spark, d).select(F.col("src").alias("wallet_id")).distinct()


@query("SELECT DISTINCT wallet_id FROM trades WHERE action = 'BUY' EXCEPT SELECT wallet_id FROM trades WHERE action = 'SELL'")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    t = p.trades(spark, d)
    return t.where(ov.bought()).select("wallet_id").distinct().join(t.where(ov.sold()).select("wallet_id"), "wallet_id", "left_anti")


@query("SELECT DISTINCT dst AS wallet_id FROM edges WHERE dst NOT IN (SELECT wallet_id FROM wallets)")
def set_anti_existing(spark: SparkSession, d: str) -> DataFrame:
    return p.edges(spark, d).select(F.col("dst").alias("wallet_id")).distinct().join(p.wallets(spark, d), "wallet_id", "left_anti")
