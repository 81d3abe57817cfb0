"""Queries over token windows: aggregates, scores, rules and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.operators import token_window as tw
from tideflow.plans.registry import query
from tideflow.settings import validated
from tideflow.sources import projection as p

#: Limits scaled to the driver's tables; the defaults are the settings' own.
SCALED = validated(
    {
        "rules": {
            "A": {"min_wallets": 14, "watch_min_wallets": 8, "min_buy_volume": 1000.0, "max_sold_pct": 60.0, "mcap_min": 1000.0, "min_liquidity": 10.0, "max_age_days": 60.0},
            "B": {"base_wallets": 8, "target_wallets": 9, "max_expansion": 3.0, "max_sell_to_buy_pct": 60.0},
            "C": {"min_human_ratio": 0.45, "max_block_pct": 40.0},
            "D": {"min_wallets": 8, "min_ratio": 1.5},
        }
    }
)

_BASE = """,
ends AS (SELECT token_id, max(ts) AS to_ts, max(ts) - INTERVAL 1440 MINUTE AS from_ts, max(ts) - INTERVAL 2880 MINUTE AS before_ts FROM trades GROUP BY token_id),
t AS (SELECT *, ts BETWEEN from_ts AND to_ts AS inside, action = 'BUY' AS buy, ts < from_ts AS before FROM trades JOIN ends USING (token_id)),
ww AS (SELECT token_id, wallet_id, to_ts, from_ts,
  coalesce(sum(usd) FILTER (inside AND buy), 0) AS buy_usd, coalesce(sum(usd) FILTER (inside AND NOT buy), 0) AS sell_usd,
  min(ts) FILTER (inside AND buy) AS first_buy, arg_min(block, (ts, trade_id)) FILTER (inside AND buy) AS first_block, max(usd) FILTER (inside AND buy) AS max_buy,
  coalesce(sum(usd) FILTER (ts >= before_ts AND before AND buy), 0) AS trailing_usd,
  coalesce(sum(usd) FILTER (before AND buy), 0) - coalesce(sum(usd) FILTER (before AND NOT buy), 0) AS held_usd, min(ts) AS first_ts,
  sum(CAST(usd AS DECIMAL(14,4)) * CAST(mcap AS DECIMAL(18,4))) FILTER (inside AND buy AND mcap IS NOT NULL) AS mcap_weight, coalesce(sum(usd) FILTER (inside AND buy AND mcap IS NOT NULL), 0) AS mcap_usd,
  coalesce(bool_or(buy AND ts >= to_ts - INTERVAL 30 MINUTE), false) AS in_30m, coalesce(bool_or(buy AND ts >= to_ts - INTERVAL 60 MINUTE), false) AS in_60m, coalesce(bool_or(buy AND ts >= to_ts - INTERVAL 360 MINUTE), false) AS in_360m
  FROM t GROUP BY ALL),
w AS (SELECT ww.*, is_watched IS NOT NULL AS tracked, coalesce(is_watched OR meets_profitable, false) AS smart, first_buy IS NOT NULL AS buyer, held_usd > 0 AS holder, labels, score, cluster_id,
  row_number() OVER (PARTITION BY token_id ORDER BY CASE WHEN held_usd > 0 THEN held_usd END DESC NULLS LAST, wallet_id) AS rnk,
  coalesce(CASE WHEN held_usd > 0 THEN CAST(sell_usd AS DOUBLE) / CAST(held_usd AS DOUBLE) * 100 END >= 80, false) AS sold_held, coalesce(CASE WHEN buy_usd > 0 THEN CAST(sell_usd AS DOUBLE) / CAST(buy_usd AS DOUBLE) * 100 END >= 80, false) AS sold_own
  FROM ww LEFT JOIN wallets USING (wallet_id)),
blocks AS (SELECT token_id, max(n) AS block_buyers FROM (SELECT token_id, first_block, count(*) AS n FROM w WHERE buyer GROUP BY ALL) GROUP BY token_id),
cl AS (SELECT token_id, max(n) AS largest, count(*) AS clusters FROM (SELECT token_id, cluster_id, count(*) AS n FROM w WHERE buyer AND smart AND cluster_id IS NOT NULL GROUP BY ALL) GROUP BY token_id),
mk AS (SELECT token_id, arg_max(struct_pack(m := mcap, l := liquidity), (ts, point_id)) FILTER (ts <= to_ts) AS pe, arg_max(struct_pack(m := mcap, l := liquidity), (ts, point_id)) FILTER (ts <= from_ts) AS ps,
  (epoch_us(max(to_ts)) - epoch_us(min(ts))) / 86400000000.0 AS age FROM market JOIN ends USING (token_id) GROUP BY token_id),
a AS (SELECT token_id, count(*) FILTER (buyer) AS buyers, count(*) FILTER (buyer AND sell_usd > 0) AS sold_buyers, coalesce(sum(buy_usd) FILTER (tracked), 0) AS b, coalesce(sum(sell_usd) FILTER (tracked), 0) AS s,
  count(*) FILTER (buyer AND smart) AS smart, count(*) FILTER (buyer AND list_contains(labels, 'human_like')) AS human, count(*) FILTER (buyer AND list_has_any(labels, ['human_like', 'smart_money'])) AS human_or_smart,
  count(*) FILTER (buyer AND list_contains(labels, 'possible_bot')) AS bots, count(*) FILTER (max_buy >= 300) AS whales, count(*) FILTER (buyer AND smart AND cluster_id IS NULL) AS unclustered,
  sum(mcap_weight) FILTER (tracked) AS mw, sum(mcap_usd) FILTER (tracked) AS mu, coalesce(sum(trailing_usd) FILTER (tracked), 0) AS tr,
  count(*) FILTER (smart AND holder) AS sh, count(*) FILTER (smart AND holder AND sold_held) AS sho, count(*) FILTER (smart AND buyer AND NOT holder) AS sn, count(*) FILTER (smart AND buyer AND NOT holder AND sold_own) AS sno,
  count(*) FILTER (rnk <= 5 AND holder AND sold_held) AS top_exits, count(*) FILTER (buyer AND smart AND first_ts = first_buy) AS new_smart, count(*) FILTER (buyer AND first_buy < from_ts + INTERVAL 720 MINUTE) AS early_buyers,
  count(*) FILTER (tracked AND in_30m) AS buyers_30m, count(*) FILTER (tracked AND in_60m) AS buyers_60m, count(*) FILTER (tracked AND in_360m) AS buyers_360m, avg(coalesce(score, 0)) FILTER (buyer) AS avg_score
  FROM w GROUP BY token_id),
agg AS (SELECT token_id, buyers, CAST(b AS DOUBLE) AS buy_usd, CAST(s AS DOUBLE) AS sell_usd, CAST(b - s AS DOUBLE) AS net_usd,
  round(CASE WHEN s > 0 THEN CAST(b AS DOUBLE) / CAST(s AS DOUBLE) WHEN b > 0 THEN 999.0 ELSE 0.0 END, 6) AS buy_sell_ratio, smart, human, human_or_smart, bots, whales,
  coalesce(clusters, 0) + unclustered AS entities, coalesce(largest, 0) AS largest_cluster, CASE WHEN mu > 0 THEN round(CAST(mw AS DOUBLE) / CAST(mu AS DOUBLE), 4) END AS avg_entry_mcap, pe.m AS current_mcap,
  round(CASE WHEN CASE WHEN mu > 0 THEN round(CAST(mw AS DOUBLE) / CAST(mu AS DOUBLE), 4) END > 0 THEN pe.m / round(CAST(mw AS DOUBLE) / CAST(mu AS DOUBLE), 4) - 1 END, 6) AS expansion,
  pe.l AS liquidity, round(CASE WHEN ps.l > 0 THEN (pe.l - ps.l) / ps.l * 100 END, 6) AS liquidity_change_pct, round(age, 6) AS age_days, CAST(tr AS DOUBLE) AS trailing_usd, tr > 0 AND CAST(b AS DOUBLE) >= 3.0 * CAST(tr AS DOUBLE) AS spike,
  round(CASE WHEN sh + sn > 0 THEN (sho + sno) * 100.0::DOUBLE / (sh + sn) ELSE 0.0 END, 6) AS exited_smart_pct, top_exits, new_smart, early_buyers, buyers_30m, buyers_60m, buyers_360m,
  round(CASE WHEN buyers > 0 THEN sold_buyers * 100.0::DOUBLE / buyers ELSE 0.0 END, 6) AS sold_pct, round(CASE WHEN buyers > 0 THEN coalesce(block_buyers, 0) * 100.0::DOUBLE / buyers ELSE 0.0 END, 6) AS block_pct, round(coalesce(avg_score, 0), 6) AS avg_score
  FROM a LEFT JOIN blocks USING (token_id) LEFT JOIN cl USING (token_id) LEFT JOIN mk USING (token_id)),
scored AS (SELECT *, round(least(greatest(round(least(smart / 40, 1.0) * 20 + least(entities / 25, 1.0) * 15 + least(greatest(net_usd / 50000, 0.0), 1.0) * 15 + avg_score / 100 * 15 + human / greatest(smart, 1) * 10
  + coalesce((1 - least(greatest((avg_entry_mcap - 100000.0) / (5000000.0 - 100000.0), 0.0), 1.0)) * 10, 0.0) + CASE WHEN expansion IS NULL THEN 0.0 ELSE (1 - least(expansion / 2, 1.0)) * 10 END + 5.0::DOUBLE, 9), 0.0), 100.0), 1) AS flow_score FROM agg),
ruled AS (SELECT *, smart >= 8 AS ra, early_buyers >= 8 AND smart >= 9 AND coalesce(expansion + 1 <= 3.0, false) AND CASE WHEN buy_usd > 0 THEN sell_usd / buy_usd * 100 ELSE 0.0 END <= 60.0 AS rb,
  buyers > 0 AND human_or_smart >= CAST(0.45 AS DOUBLE) * buyers AND bots <= CAST(0.2 AS DOUBLE) * buyers AND block_pct <= 40.0 AS rc, whales > 0 AND smart >= 8 AND buy_sell_ratio > 1.5 AS rd,
  exited_smart_pct >= 30.0 OR (net_usd < 0 AND top_exits >= 3) OR coalesce(liquidity_change_pct <= -30.0, false) OR (coalesce(expansion >= 1.0, false) AND new_smart < 3) AS rg FROM scored)
"""


def _agg(spark: SparkSession, d: str) -> DataFrame:
    return tw.token_window(p.trades(spark, d), p.wallets(spark, d), p.market(spark, d), 1440, whale_usd=300.0)


@query(_BASE + "SELECT token_id, wallet_id, CAST(buy_usd AS DOUBLE) AS buy_usd, CAST(sell_usd AS DOUBLE) AS sell_usd, first_buy, CAST(max_buy AS DOUBLE) AS max_buy, CAST(held_usd AS DOUBLE) AS held_usd, CAST(trailing_usd AS DOUBLE) AS trailing_usd FROM ww")
def agg_window_wallet(spark: SparkSession, d: str) -> DataFrame:
    w = tw.wallet_window(p.trades(spark, d), 1440)
    money = [F.col(c).cast("double").alias(c) for c in ("buy_usd", "sell_usd", "max_buy", "held_usd", "trailing_usd")]
    return w.select("token_id", "wallet_id", F.col("first_buy.ts").alias("first_buy"), *money)


@query(_BASE + "SELECT * FROM agg")
def agg_token_window(spark: SparkSession, d: str) -> DataFrame:
    return _agg(spark, d)


def _part(name: str, *columns: str) -> None:
    """A query for some of the aggregate's columns, so each operator is checked by its own name."""

    def f(spark: SparkSession, d: str) -> DataFrame:
        return _agg(spark, d).select("token_id", *columns)

    f.__name__ = name
    query(_BASE + f"SELECT token_id, {', '.join(columns)} FROM agg")(f)


_part("agg_volumes", "buy_usd", "sell_usd", "net_usd", "buy_sell_ratio")
_part("agg_smart_counts", "buyers", "smart", "human", "human_or_smart", "bots")
_part("agg_whales", "whales")
_part("agg_entities", "entities", "largest_cluster")
_part("agg_weighted_mcap", "avg_entry_mcap")
_part("agg_trailing_volume", "trailing_usd", "spike")
_part("agg_exited_pct", "exited_smart_pct")
_part("agg_top_holder_exits", "top_exits")
_part("agg_new_smart", "new_smart")
_part("agg_early_buyers", "early_buyers")
_part("agg_accumulation", "buyers_30m", "buyers_60m", "buyers_360m", "sold_pct")
_part("agg_market_point", "current_mcap", "expansion", "liquidity", "liquidity_change_pct", "age_days")
_part("agg_max_single_block", "block_pct")


@query(_BASE + "SELECT token_id, wallet_id, CAST(held_usd AS DOUBLE) AS held_usd FROM ww WHERE held_usd > 0")
def agg_prewindow_position(spark: SparkSession, d: str) -> DataFrame:
    return tw.wallet_window(p.trades(spark, d), 1440).where("held_usd > 0").select("token_id", "wallet_id", F.col("held_usd").cast("double").alias("held_usd"))


@query(_BASE + "SELECT token_id, flow_score FROM scored")
def score_flow(spark: SparkSession, d: str) -> DataFrame:
    agg = _agg(spark, d)
    return agg.select("token_id", tw.flow_score(agg).alias("flow_score"))


def _rule(letter: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return _agg(spark, d).select("token_id", tw.rules(SCALED)[letter].alias("fired"))

    f.__name__ = f"rule_{letter.lower()}"
    query(_BASE + f"SELECT token_id, r{letter.lower()} AS fired FROM ruled")(f)


for _letter in "BCDG":
    _rule(_letter)


@query(_BASE + """SELECT token_id, CASE WHEN smart < 8 THEN 'INFO' WHEN smart >= 14 AND buy_usd >= 1000.0 AND net_usd > 0 AND sold_pct < 60.0 AND coalesce(current_mcap BETWEEN 1000.0 AND 5000000.0, false)
  AND coalesce(liquidity >= 10.0, false) AND (coalesce(age_days < 60.0, false) OR spike) THEN 'HIGH' ELSE 'WATCH' END AS severity FROM ruled""")  # fmt: skip
def rule_a(spark: SparkSession, d: str) -> DataFrame:
    return _agg(spark, d).select("token_id", tw.severity_a(SCALED).alias("severity"))


@query(_BASE + "SELECT token_id, flow_score, smart, entities, net_usd FROM scored ORDER BY flow_score DESC, token_id LIMIT 200")
def srt_hot_tokens(spark: SparkSession, d: str) -> DataFrame:
    agg = _agg(spark, d)
    return agg.select("token_id", tw.flow_score(agg).alias("flow_score"), "smart", "entities", "net_usd").orderBy(F.desc("flow_score"), "token_id").limit(200)


@query("""SELECT c_custkey, round(least(greatest((least(greatest(c_acctbal / 10000, 0.0), 1.0) * 25 + least(greatest(c_custkey % 10 / 10 / 0.7::DOUBLE, 0.0), 1.0) * 15 + least(greatest(c_custkey % 40 / 30, 0.0), 1.0) * 10 + 7.5 + 5.0 + 5.0 + 7.5 - 30 * (c_custkey % 3 / 3))
  * (0.5 + 0.5 * (c_custkey % 101) / 100), 0.0), 100.0), 10) AS score FROM customer""", views=False)  # fmt: skip
def score_wallet(spark: SparkSession, d: str) -> DataFrame:
    k, half = F.col("c_custkey"), F.lit(0.5)
    score = tw.wallet_score(F.col("c_acctbal"), k % 10 / 10, k % 40, half, half, half, half, k % 3 / 3, (k % 101).cast("double"))
    return p.table(spark, d, "customer").select("c_custkey", F.round(score, 10).alias("score"))
