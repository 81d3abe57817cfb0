"""Queries over rules on two windows: now, replayed at every step, tuned and walked forward."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideflow.functions import scalar as sc
from tideflow.operators import outcome_panes as ix
from tideflow.operators import outcomes as oc
from tideflow.operators import replay as rp
from tideflow.operators import temporal as tm
from tideflow.operators import token_window as tw
from tideflow.plans import flows
from tideflow.plans import outcomes as oq
from tideflow.plans.registry import query
from tideflow.settings import validated
from tideflow.sources import projection as p
from tideflow.sources.shared import saved

#: Limits scaled to the driver's tables, where a token has about one trade in 30 minutes; the defaults are the settings' own.
SCALED = validated(
    {
        "rules": {
            "A": {"min_wallets": 2, "watch_min_wallets": 1, "min_buy_volume": 20.0, "max_sold_pct": 60.0, "mcap_min": 1000.0, "min_liquidity": 10.0, "max_age_days": 60.0},
            "B": {"base_wallets": 4, "target_wallets": 6, "max_expansion": 3.0, "max_sell_to_buy_pct": 80.0},
            "C": {"min_human_ratio": 0.45, "max_block_pct": 60.0},
            "D": {"min_wallets": 1, "min_ratio": 1.5},
        }
    }
)
#: The same dimensions as the fixed grid, with values of that scale.
TUNED = {d: (values, rp.TUNED[d][1]) for d, values in {"minWallets": (1, 2, 3, 4), "minEntities": (1, 2, 3), "minNetFlow": (0.0, 50.0, 150.0, 400.0), "maxSoldPct": (20.0, 30.0, 50.0), "maxMcapExpansion": (0.5, 1.0, 2.0), "minLiquidity": (10.0, 20.0, 50.0)}.items()}
WHALE = 300.0
GRID = rp.Grid("2024-01-05 00:00:00", "2024-01-25 00:00:00", 120)
#: Both halves of the walk, the second strictly later.
TUNE, TEST = rp.Grid("2024-01-05 00:00:00", "2024-01-15 00:00:00", 120), rp.Grid("2024-01-15 00:00:00.001", "2024-01-25 00:00:00", 120)
#: One step after all trades: each token as it is now.
NOW = rp.Grid("2024-02-01 00:00:00", "2024-02-01 00:00:00", 30)


# The conditions of rule E on a freshly funded wallet's first buy of a token.
_FUNDED = """edges e JOIN wallets s ON s.wallet_id = e.src AND (s.is_watched OR s.meets_profitable) JOIN (SELECT wallet_id, min(ts) AS first_ts FROM trades GROUP BY 1) f ON f.wallet_id = e.dst
  JOIN (SELECT wallet_id, token_id, usd, ts, mcap FROM trades WHERE action = 'BUY' QUALIFY row_number() OVER (PARTITION BY wallet_id, token_id ORDER BY ts, trade_id) = 1) b ON b.wallet_id = e.dst
  WHERE e.action = 'transfer' AND e.src <> e.dst AND f.first_ts > e.ts AND epoch_us(b.ts) - epoch_us(e.ts) BETWEEN 300000000 AND 7200000000 AND b.mcap <= 5000000 AND CAST(b.usd AS DOUBLE) / CAST(e.usd AS DOUBLE) * 100 BETWEEN 30 AND 110 AND e.usd > 0"""


def _stepped(grid: rp.Grid, trades: str = "trades", market: str = "market") -> str:
    """SQL of each token's two windows at each step, by joining trades to steps: what the operator does without copies."""
    a, b = f"TIMESTAMP '{grid.start}'", f"TIMESTAMP '{grid.end}'"
    keys = "token_id, k, minutes"
    return f""",
gs AS (SELECT row_number() OVER (ORDER BY t) - 1 AS k, t FROM (SELECT t FROM generate_series({a}, {b}, INTERVAL {grid.minutes} MINUTE) x(t) UNION SELECT {b})),
wn AS (SELECT e.*, minutes, to_ts - to_minutes(minutes) AS from_ts, to_ts - to_minutes(2 * minutes) AS before_ts FROM (SELECT token_id, k, t, max(ts) AS to_ts FROM {trades} JOIN gs ON ts <= t GROUP BY ALL) e, (VALUES (30), (1440)) v(minutes)),
tt AS (SELECT x.*, k, minutes, to_ts, from_ts, before_ts, ts >= from_ts AS inside, action = 'BUY' AS buy, ts < from_ts AS before FROM {trades} x JOIN wn ON wn.token_id = x.token_id AND x.ts <= to_ts),
ww AS (SELECT {keys}, wallet_id, to_ts, from_ts,
  coalesce(sum(usd) FILTER (inside AND buy), 0) AS buy_usd, coalesce(sum(usd) FILTER (inside AND NOT buy), 0) AS sell_usd,
  min(ts) FILTER (inside AND buy) AS first_buy, arg_min(block, (ts, trade_id)) FILTER (inside AND buy) AS first_block, max(usd) FILTER (inside AND buy) AS max_buy,
  coalesce(sum(usd) FILTER (ts >= before_ts AND before AND buy), 0) AS trailing_usd,
  coalesce(sum(usd) FILTER (before AND buy), 0) - coalesce(sum(usd) FILTER (before AND NOT buy), 0) AS held_usd, min(ts) AS first_ts,
  sum(CAST(usd AS DECIMAL(14,4)) * CAST(mcap AS DECIMAL(18,4))) FILTER (inside AND buy AND mcap IS NOT NULL) AS mcap_weight, coalesce(sum(usd) FILTER (inside AND buy AND mcap IS NOT NULL), 0) AS mcap_usd
  FROM tt GROUP BY ALL),
w AS (SELECT ww.*, is_watched IS NOT NULL AS tracked, coalesce(is_watched OR meets_profitable, false) AS smart, first_buy IS NOT NULL AS buyer, held_usd > 0 AS holder, labels, score, cluster_id,
  row_number() OVER (PARTITION BY {keys} ORDER BY CASE WHEN held_usd > 0 THEN held_usd END DESC NULLS LAST, ww.wallet_id) AS rnk,
  coalesce(CASE WHEN held_usd > 0 THEN CAST(sell_usd AS DOUBLE) / CAST(held_usd AS DOUBLE) * 100 END >= 80, false) AS sold_held, coalesce(CASE WHEN buy_usd > 0 THEN CAST(sell_usd AS DOUBLE) / CAST(buy_usd AS DOUBLE) * 100 END >= 80, false) AS sold_own
  FROM ww LEFT JOIN wallets USING (wallet_id)),
blocks AS (SELECT {keys}, max(n) AS block_buyers FROM (SELECT {keys}, first_block, count(*) AS n FROM w WHERE buyer GROUP BY ALL) GROUP BY ALL),
cl AS (SELECT {keys}, max(n) AS largest, count(*) AS clusters FROM (SELECT {keys}, cluster_id, count(*) AS n FROM w WHERE buyer AND smart AND cluster_id IS NOT NULL GROUP BY ALL) GROUP BY ALL),
mk AS (SELECT wn.token_id, k, minutes, arg_max(struct_pack(m := mcap, l := liquidity), (ts, point_id)) FILTER (ts <= to_ts) AS pe, arg_max(struct_pack(m := mcap, l := liquidity), (ts, point_id)) FILTER (ts <= from_ts) AS ps,
  (epoch_us(max(to_ts)) - epoch_us(min(ts))) / 86400000000.0 AS age FROM {market} m JOIN wn ON wn.token_id = m.token_id AND m.ts <= wn.t GROUP BY ALL),
a AS (SELECT {keys}, count(*) FILTER (buyer) AS buyers, count(*) FILTER (buyer AND sell_usd > 0) AS sold_buyers, coalesce(sum(buy_usd) FILTER (tracked), 0) AS b, coalesce(sum(sell_usd) FILTER (tracked), 0) AS s,
  count(*) FILTER (buyer AND smart) AS smart, count(*) FILTER (buyer AND list_contains(labels, 'human_like')) AS human, count(*) FILTER (buyer AND list_has_any(labels, ['human_like', 'smart_money'])) AS human_or_smart,
  count(*) FILTER (buyer AND list_contains(labels, 'possible_bot')) AS bots, count(*) FILTER (max_buy >= {WHALE}) AS whales, count(*) FILTER (buyer AND smart AND cluster_id IS NULL) AS unclustered,
  sum(mcap_weight) FILTER (tracked) AS mw, sum(mcap_usd) FILTER (tracked) AS mu, coalesce(sum(trailing_usd) FILTER (tracked), 0) AS tr,
  count(*) FILTER (smart AND holder) AS sh, count(*) FILTER (smart AND holder AND sold_held) AS sho, count(*) FILTER (smart AND buyer AND NOT holder) AS sn, count(*) FILTER (smart AND buyer AND NOT holder AND sold_own) AS sno,
  count(*) FILTER (rnk <= 5 AND holder AND sold_held) AS top_exits, count(*) FILTER (buyer AND smart AND first_ts = first_buy) AS new_smart, count(*) FILTER (buyer AND first_buy < from_ts + to_seconds(minutes * 30)) AS early_buyers,
  avg(coalesce(score, 0)) FILTER (buyer) AS avg_score
  FROM w GROUP BY ALL),
agg AS (SELECT token_id, k, minutes, t, to_ts, coalesce(buyers, 0) AS buyers, CAST(coalesce(b, 0) AS DOUBLE) AS buy_usd, CAST(coalesce(s, 0) AS DOUBLE) AS sell_usd, CAST(coalesce(b - s, 0) AS DOUBLE) AS net_usd,
  round(CASE WHEN s > 0 THEN CAST(b AS DOUBLE) / CAST(s AS DOUBLE) WHEN b > 0 THEN 999.0 ELSE 0.0 END, 6) AS buy_sell_ratio, coalesce(smart, 0) AS smart, coalesce(human, 0) AS human, coalesce(human_or_smart, 0) AS human_or_smart, coalesce(bots, 0) AS bots, coalesce(whales, 0) AS whales,
  coalesce(clusters, 0) + unclustered AS entities, coalesce(largest, 0) AS largest_cluster, CASE WHEN mu > 0 THEN round(CAST(mw AS DOUBLE) / CAST(mu AS DOUBLE), 4) END AS avg_entry_mcap, pe.m AS current_mcap,
  round(CASE WHEN CASE WHEN mu > 0 THEN round(CAST(mw AS DOUBLE) / CAST(mu AS DOUBLE), 4) END > 0 THEN pe.m / round(CAST(mw AS DOUBLE) / CAST(mu AS DOUBLE), 4) - 1 END, 6) + 0.0::DOUBLE AS expansion,
  pe.l AS liquidity, round(CASE WHEN ps.l > 0 THEN (pe.l - ps.l) / ps.l * 100 END, 6) AS liquidity_change_pct, round(age, 6) AS age_days, CAST(tr AS DOUBLE) AS trailing_usd, tr > 0 AND CAST(b AS DOUBLE) >= 3.0 * CAST(tr AS DOUBLE) AS spike,
  round(CASE WHEN sh + sn > 0 THEN (sho + sno) * 100.0::DOUBLE / (sh + sn) ELSE 0.0 END, 6) AS exited_smart_pct, coalesce(top_exits, 0) AS top_exits, new_smart, early_buyers,
  round(CASE WHEN buyers > 0 THEN sold_buyers * 100.0::DOUBLE / buyers ELSE 0.0 END, 6) AS sold_pct, round(CASE WHEN buyers > 0 THEN coalesce(block_buyers, 0) * 100.0::DOUBLE / buyers ELSE 0.0 END, 6) AS block_pct, round(coalesce(avg_score, 0), 6) AS avg_score
  FROM wn LEFT JOIN a USING ({keys}) LEFT JOIN blocks USING ({keys}) LEFT JOIN cl USING ({keys}) LEFT JOIN mk USING ({keys})),
fe AS (SELECT b.token_id, min(b.ts) AS seen FROM {_FUNDED} GROUP BY 1),
ff AS (SELECT b.token_id, min(b.ts) AS seen FROM rt JOIN trades b ON b.trade_id = rt.buy_id GROUP BY 1),
rl AS (SELECT token_id, k, t, 'A' AS rule, smart >= 1 AS fired, CASE WHEN smart >= 2 AND buy_usd >= 20.0 AND net_usd > 0 AND sold_pct < 60.0 AND coalesce(current_mcap BETWEEN 1000.0 AND 5000000.0, false) AND coalesce(liquidity >= 10.0, false) AND (coalesce(age_days < 60.0, false) OR spike) THEN 'HIGH' ELSE 'WATCH' END AS severity FROM agg WHERE minutes = 30
  UNION ALL SELECT token_id, k, t, 'B', early_buyers >= 4 AND smart >= 6 AND coalesce(expansion + 1 <= 3.0, false) AND CASE WHEN buy_usd > 0 THEN sell_usd / buy_usd * 100 ELSE 0.0 END <= 80.0, 'WATCH' FROM agg WHERE minutes = 1440
  UNION ALL SELECT token_id, k, t, 'C', buyers > 0 AND human_or_smart >= CAST(0.45 AS DOUBLE) * buyers AND bots <= CAST(0.2 AS DOUBLE) * buyers AND block_pct <= 60.0, 'WATCH' FROM agg WHERE minutes = 30
  UNION ALL SELECT token_id, k, t, 'D', whales > 0 AND smart >= 1 AND buy_sell_ratio > 1.5, 'HIGH' FROM agg WHERE minutes = 30
  UNION ALL SELECT token_id, k, t, 'E', coalesce(seen <= t, false), 'HIGH' FROM wn LEFT JOIN fe USING (token_id) WHERE minutes = 30
  UNION ALL SELECT token_id, k, t, 'F', coalesce(seen <= t, false), 'HIGH' FROM wn LEFT JOIN ff USING (token_id) WHERE minutes = 30
  UNION ALL SELECT token_id, k, t, 'G', exited_smart_pct >= 30.0 OR (net_usd < 0 AND top_exits >= 3) OR coalesce(liquidity_change_pct <= -30.0, false) OR (coalesce(expansion >= 1.0, false) AND new_smart < 3), 'CRITICAL' FROM agg WHERE minutes = 1440),
ru AS (SELECT token_id, k, t, rule, fired, CASE WHEN fired THEN severity ELSE 'INFO' END AS severity FROM rl)
"""


def _kept(source: str, keys: str, name: str, free: str = ">=") -> str:
    """SQL of the fires that the last kept one of their keys doesn't suppress for a day."""
    on = " AND ".join(f"c.{k} = f.{k}" for k in keys.split(", "))
    mine = ", ".join(f"f.{k}" for k in keys.split(", "))
    return f""",
{name} AS (SELECT {keys}, t FROM (WITH RECURSIVE f AS (SELECT {keys}, min(t) AS t FROM {source} GROUP BY ALL UNION ALL SELECT {mine}, (SELECT min(t) FROM {source} c WHERE {on} AND c.t {free} f.t + INTERVAL 24 HOUR) FROM f WHERE f.t IS NOT NULL) SELECT * FROM f) WHERE t IS NOT NULL)"""


def _windows(spark: SparkSession, d: str, grid: rp.Grid, within: bool = False) -> DataFrame:
    """The two windows at each step; within: from trades and points inside the grid's span alone."""
    t, m = p.trades(spark, d), p.market(spark, d)
    if within:
        t, m = (x.where(f"ts between TIMESTAMP_NTZ '{grid.start}' and TIMESTAMP_NTZ '{grid.end}'") for x in (t, m))
    return rp.stepped_windows(t, p.wallets(spark, d), m, grid, whale_usd=WHALE)


def _rules(spark: SparkSession, d: str, windows: DataFrame, grid: rp.Grid | None = None) -> DataFrame:
    """All seven rules at each step; grid: of chains whose last buy lies inside its span alone."""
    funded = flows.funded_rows(spark, d).where("gap <= 7200000000").select("token_id", F.col("buy_ts").alias("seen_ts"))
    rotated = flows.rotation_rows(spark, d).select(F.col("to_token").alias("token_id"), F.col("buy_ts").alias("seen_ts"))
    if grid:
        funded, rotated = (x.where(f"seen_ts between TIMESTAMP_NTZ '{grid.start}' and TIMESTAMP_NTZ '{grid.end}'") for x in (funded, rotated))
    return rp.stepped_rules(windows, funded, rotated, SCALED)


_NOW = flows._ROT + _stepped(NOW)


@query(_NOW + "SELECT token_id, rule, fired, severity FROM ru")
def rules_all(spark: SparkSession, d: str) -> DataFrame:
    """All seven rules of each token at its last trade: A, C, D, E on 30 minutes, B, F, G on a day, from one scan."""
    return _rules(spark, d, _windows(spark, d, NOW)).select("token_id", "rule", "fired", "severity")


_STATUS = _NOW + """, sc AS (SELECT *, round(least(greatest(round(least(smart / 40, 1.0) * 20 + least(entities / 25, 1.0) * 15 + least(greatest(net_usd / 50000, 0.0), 1.0) * 15 + avg_score / 100 * 15 + human / greatest(smart, 1) * 10
  + coalesce((1 - least(greatest((avg_entry_mcap - 100000.0) / (5000000.0 - 100000.0), 0.0), 1.0)) * 10, 0.0) + CASE WHEN expansion IS NULL THEN 0.0 ELSE (1 - least(expansion / 2, 1.0)) * 10 END + 5.0::DOUBLE, 9), 0.0), 100.0), 1) AS flow_score FROM agg WHERE minutes = 1440),
by_rule AS (SELECT token_id, list(rule) FILTER (fired) AS f FROM ru GROUP BY 1)
SELECT token_id, CASE WHEN list_contains(f, 'G') THEN 'distribution' WHEN list_contains(f, 'F') THEN 'rotation' WHEN len(f) > 0 THEN 'accumulating' WHEN flow_score < 10 AND a3.buy_usd = 0 AND a3.sell_usd = 0 THEN 'dead' ELSE 'watching' END AS status
FROM by_rule JOIN sc USING (token_id) JOIN (SELECT token_id, buy_usd, sell_usd FROM agg WHERE minutes = 30) a3 USING (token_id)"""


@query(_STATUS)
def signal_status(spark: SparkSession, d: str) -> DataFrame:
    """Each token's status from all seven rules: exits before rotations before accumulation, else dead or watching."""
    w = _windows(spark, d, NOW)
    fired = _rules(spark, d, w).groupBy("token_id").agg(*[F.bool_or(F.when(F.col("rule") == r, F.col("fired"))).alias(r) for r in "ABCDEFG"])
    score = w.where("minutes = 1440").select("token_id", tw.flow_score(w).alias("score"))
    volume = w.where("minutes = 30").select("token_id", (F.col("buy_usd") + F.col("sell_usd")).alias("volume"))
    return fired.join(score, "token_id").join(volume, "token_id").select("token_id", tw.signal_status({r: F.col(r) for r in "ABCDEFG"}, F.col("score"), F.col("volume")).alias("status"))


@query(_NOW + """SELECT token_id, rule, severity FROM ru JOIN (SELECT token_id, max(ts) AS to_ts FROM trades GROUP BY 1) e USING (token_id) WHERE fired AND NOT EXISTS (
  SELECT 1 FROM signals s WHERE s.token_id = ru.token_id AND s.rule = ru.rule AND s.fired_at > e.to_ts - INTERVAL 24 HOUR AND s.fired_at <= e.to_ts)""")  # fmt: skip
def signal_detect(spark: SparkSession, d: str) -> DataFrame:
    """Of the seven rules those that fire now and didn't in the last day."""
    ends = p.trades(spark, d).groupBy("token_id").agg(F.max("ts").alias("to_ts"))
    recent = p.signals(spark, d).join(ends, "token_id").where((F.col("fired_at") > F.col("to_ts") - F.expr("INTERVAL 24 HOURS")) & (F.col("fired_at") <= F.col("to_ts")))
    return _rules(spark, d, _windows(spark, d, NOW)).where("fired").join(recent.select("token_id", "rule"), ["token_id", "rule"], "left_anti").select("token_id", "rule", "severity")


_REPLAY = flows._ROT + _stepped(GRID)
_FIRES = _REPLAY + ", fd AS (SELECT token_id, rule, t FROM ru WHERE fired)" + _kept("fd", "token_id, rule", "fr")


@query(_REPLAY + "SELECT token_id, k, minutes, to_ts, buyers, buy_usd, sell_usd, smart, whales, entities, largest_cluster, avg_entry_mcap, current_mcap, expansion, liquidity, liquidity_change_pct, age_days, trailing_usd, spike, exited_smart_pct, top_exits, new_smart, early_buyers, sold_pct, block_pct, avg_score FROM agg")
def bt_replay_windows(spark: SparkSession, d: str) -> DataFrame:
    """What both windows of each token hold at each step of the replay."""
    return _windows(spark, d, GRID).drop("t", "net_usd", "buy_sell_ratio", "human", "human_or_smart", "bots")


@query(_FIRES + " SELECT token_id, rule, t, severity FROM fr JOIN ru USING (token_id, rule, t)")
def bt_replay(spark: SparkSession, d: str) -> DataFrame:
    """The seven rules' fires over the grid, each seeing nothing later than its step, after the day's dedupe."""
    return rp.replayed_fires(_rules(spark, d, saved(_windows(spark, d, GRID))))


def _hits(fires: DataFrame, market: DataFrame) -> DataFrame:
    """fires (token_id, t and others) with label, roi_pct and hit: what became of a signal at that token and time.

    The entry is the last price up to the fire, if it is above zero; a fire without points stays pending.
    """
    at = saved(fires.select("token_id", "t").distinct())
    told = at.withColumn("signal_id", F.struct("token_id", "t")).withColumn("fired_at", F.col("t"))
    priced = tm.asof(told, market.withColumn("entry_price", F.col("price")), ["token_id"], "fired_at", "ts", "point_id", ["entry_price"])
    got = ix.judged(priced, market).select("signal_id.token_id", "signal_id.t", "label", "roi_pct", "max_upside_pct", "max_drawdown_pct", (F.coalesce(F.col("max_upside_pct"), F.lit(0.0)) >= 100).alias("hit"))
    return fires.join(got, ["token_id", "t"], "left").na.fill("neutral_pending", ["label"]).na.fill(False, ["hit"])


def _hit_sql(fires: str, points: str) -> str:
    """SQL: fa, each (token, time) of fires with its entry, and ht, whether the price doubled."""
    return f""",
fa AS (SELECT x.token_id, x.t, (SELECT arg_max(price, (ts, point_id)) FROM {points} m WHERE m.token_id = x.token_id AND m.ts <= x.t) AS entry FROM (SELECT DISTINCT token_id, t FROM {fires}) x),
hp AS (SELECT a.token_id, a.t, m.ts, m.point_id, CASE WHEN entry > 0 THEN price / entry END AS multiple, m.liquidity FROM fa a JOIN {points} m ON m.token_id = a.token_id AND m.ts >= a.t AND epoch_us(m.ts) - epoch_us(a.t) <= 604800000000),
ht AS (SELECT token_id, t, coalesce(round((max(multiple) - 1) * 100, 6) >= 100, false) AS hit, round((arg_max(multiple, (ts, point_id)) FILTER (multiple IS NOT NULL) - 1) * 100, 6) AS roi_pct,
  round((max(multiple) - 1) * 100, 6) AS max_upside_pct, round((min(multiple) - 1) * 100, 6) AS max_drawdown_pct FROM hp GROUP BY 1, 2)"""


_EVAL = _FIRES + _hit_sql("fr", "market") + """,
wd AS (SELECT *, min(multiple) OVER w AS lb, max(multiple) OVER w AS tb, first_value(liquidity) OVER (PARTITION BY token_id, t ORDER BY ts, point_id) AS el FROM hp WINDOW w AS (PARTITION BY token_id, t ORDER BY ts, point_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lb AS (SELECT token_id, t, CASE WHEN coalesce(bool_or(liquidity IS NOT NULL AND coalesce(tb < 2, true) AND (coalesce(el > 0 AND liquidity <= el * 0.1::DOUBLE, false) OR liquidity < 1000)), false) THEN 'hard_failure'
  WHEN coalesce(bool_or(multiple >= 5 AND coalesce(lb > 0.4::DOUBLE, true)), false) THEN 'major_win' WHEN coalesce(bool_or(multiple >= 2 AND coalesce(lb > 0.5, true)), false) THEN 'good_win' WHEN coalesce(bool_or(multiple >= 1.5 AND coalesce(lb > 0.5, true)), false) THEN 'small_win'
  WHEN coalesce(bool_or(multiple <= 0.4::DOUBLE AND coalesce(tb < 2, true)), false) THEN 'failure' ELSE 'neutral_pending' END AS label FROM wd GROUP BY 1, 2)"""


@query(_EVAL + " SELECT token_id, rule, t, coalesce(label, 'neutral_pending') AS label, roi_pct, coalesce(hit, false) AS hit FROM fr LEFT JOIN lb USING (token_id, t) LEFT JOIN ht USING (token_id, t)")
def bt_replay_eval(spark: SparkSession, d: str) -> DataFrame:
    """What became of each replayed fire."""
    fires = rp.replayed_fires(_rules(spark, d, saved(_windows(spark, d, GRID))))
    return _hits(fires, p.market(spark, d)).select("token_id", "rule", "t", "label", "roi_pct", "hit")


_METRICS = _EVAL + f""",
em AS (SELECT fr.rule, fr.token_id, fr.t, coalesce(label, 'neutral_pending') AS label, roi_pct, max_upside_pct, max_drawdown_pct, g.entities, g.sold_pct, g.current_mcap, g.liquidity, CASE WHEN g.smart > 0 THEN g.largest_cluster / g.smart END AS share
  FROM fr LEFT JOIN lb USING (token_id, t) LEFT JOIN ht USING (token_id, t) LEFT JOIN agg g ON g.token_id = fr.token_id AND g.t = fr.t AND g.minutes = CASE WHEN rule IN ('B', 'F', 'G') THEN 1440 ELSE 30 END)"""


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """Replayed fires with what became of them and what their rule's window held."""
    w = saved(_windows(spark, d, GRID))
    fires = _hits(rp.replayed_fires(_rules(spark, d, w)), p.market(spark, d))
    share = F.when(F.col("smart") > 0, F.col("largest_cluster") / F.col("smart")).alias("share")
    of = w.select("token_id", "t", "minutes", "entities", "sold_pct", "current_mcap", "liquidity", share)
    return fires.withColumn("minutes", F.when(F.col("rule").isin("B", "F", "G"), 1440).otherwise(30)).join(of, ["token_id", "t", "minutes"], "left")


_SUM = oq._SUM
_COMBOS = ("A", "A+B", "A+C", "A+entityAdjusted", "A+lowSellPressure", "F", "F+clusterConf", "A/B/F")
_PAIRED = "EXISTS (SELECT 1 FROM em o WHERE o.rule = '{}' AND o.token_id = em.token_id AND abs(epoch_us(o.t) - epoch_us(em.t)) <= 86400000000)"


@query(_METRICS + f""", cb AS (SELECT * FROM (SELECT em.*, unnest(list_filter([CASE WHEN rule = 'A' THEN 'A' END, CASE WHEN rule = 'A' AND {_PAIRED.format("B")} THEN 'A+B' END, CASE WHEN rule = 'A' AND {_PAIRED.format("C")} THEN 'A+C' END, CASE WHEN rule = 'A' AND entities >= 1 THEN 'A+entityAdjusted' END,
  CASE WHEN rule = 'A' AND sold_pct < 30 THEN 'A+lowSellPressure' END, CASE WHEN rule = 'F' THEN 'F' END, CASE WHEN rule IN ('A', 'B', 'F') THEN 'A/B/F' END], lambda x: x IS NOT NULL)) AS combo FROM em)),
sm AS (SELECT combo, {_SUM} FROM cb GROUP BY 1)
SELECT n.combo, coalesce(signals, 0) AS signals, hit_50, hit_2x, hit_5x, median_return, avg_return, max_upside, max_drawdown, failure_rate, hard_failure_rate FROM (SELECT unnest([{", ".join(repr(c) for c in _COMBOS)}]) AS combo) n LEFT JOIN sm USING (combo)""")  # fmt: skip
def agg_combo_perf(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of eight combinations of replayed fires, those without any too.

    A fire of rule A is paired with another rule's of its token within a day to either side. Replayed fires carry no
    confidence of a rotation, so F+clusterConf has none.
    """
    e = saved(_measured(spark, d))
    day, gap = 86_400_000_000, F.abs(F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.col("other_t").cast("timestamp")))
    bucket = F.floor(F.unix_micros(F.col("t").cast("timestamp")) / day)
    near = F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b")
    others = e.where("rule in ('B', 'C')").select("token_id", F.col("rule").alias("other"), F.col("t").alias("other_t"), bucket.alias("b"))
    paired = e.where("rule = 'A'").select("token_id", "t", near).join(others, ["token_id", "b"]).where(gap <= day).groupBy("token_id", "t").agg(F.collect_set("other").alias("others"))
    a, cfg = F.col("rule") == "A", SCALED["rules"]["A"]
    said = {
        "A": a,
        "A+B": a & F.array_contains("others", "B"),
        "A+C": a & F.array_contains("others", "C"),
        "A+entityAdjusted": a & (F.col("entities") >= math.ceil(cfg["watch_min_wallets"] / 2)),
        "A+lowSellPressure": a & (F.col("sold_pct") < cfg["max_sold_pct"] / 2),
        "F": F.col("rule") == "F",
        "A/B/F": F.col("rule").isin("A", "B", "F"),
    }
    named = F.explode(F.array_compact(F.array(*[F.when(v, k) for k, v in said.items()]))).alias("combo")
    g = e.join(paired, ["token_id", "t"], "left").select("*", named).groupBy("combo").agg(*oc.summary_columns())
    every = spark.createDataFrame([(c,) for c in _COMBOS], "combo string")
    return F.broadcast(every).join(g, "combo", "left").withColumn("signals", F.coalesce("signals", F.lit(0)))


_BUCKETS = {"mcapAtTrigger": ("<100k", "100k-1M", "1M-5M", ">5M", "unknown"), "liquidity": ("<20k", "20k-100k", ">100k", "unknown"), "uniqueEntityCount": ("1-4", "5-14", "15+"), "clusterConcentration": ("low", "medium", "high", "unknown")}
_BUCKET_ROWS = [(k, b) for k, bs in _BUCKETS.items() for b in bs]


@query(_METRICS + f""", bb AS (SELECT em.*, unnest([struct_pack(d := 'mcapAtTrigger', b := CASE WHEN current_mcap IS NULL THEN 'unknown' WHEN current_mcap < 100000 THEN '<100k' WHEN current_mcap < 1000000 THEN '100k-1M' WHEN current_mcap < 5000000 THEN '1M-5M' ELSE '>5M' END),
  struct_pack(d := 'liquidity', b := CASE WHEN liquidity IS NULL THEN 'unknown' WHEN liquidity < 20000 THEN '<20k' WHEN liquidity < 100000 THEN '20k-100k' ELSE '>100k' END), struct_pack(d := 'uniqueEntityCount', b := CASE WHEN entities < 1 THEN NULL WHEN entities <= 4 THEN '1-4' WHEN entities <= 14 THEN '5-14' ELSE '15+' END),
  struct_pack(d := 'clusterConcentration', b := CASE WHEN share IS NULL THEN 'unknown' WHEN share >= 0.66::DOUBLE THEN 'high' WHEN share >= 0.33::DOUBLE THEN 'medium' ELSE 'low' END)]) AS x FROM em),
sm AS (SELECT x.d AS dimension, x.b AS bucket, {_SUM} FROM bb GROUP BY 1, 2)
SELECT dimension, bucket, coalesce(signals, 0) AS signals, hit_50, hit_2x, hit_5x, median_return, avg_return, max_upside, max_drawdown, failure_rate, hard_failure_rate FROM (VALUES {", ".join(str(r) for r in _BUCKET_ROWS)}) n(dimension, bucket) LEFT JOIN sm USING (dimension, bucket)""")  # fmt: skip
def agg_bucket_perf(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of replayed fires by market value, liquidity, entities and the largest cluster's share, empty buckets too."""
    of = {"mcapAtTrigger": oc.mcap_bucket(F.col("current_mcap")), "liquidity": oc.liquidity_bucket(F.col("liquidity")), "uniqueEntityCount": sc.entity_bucket(F.col("entities")), "clusterConcentration": sc.concentration_band(F.col("share"))}
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("bucket")) for k, v in of.items()])).alias("x")
    g = _measured(spark, d).select("*", named).groupBy("x.dimension", "x.bucket").agg(*oc.summary_columns())
    every = spark.createDataFrame(_BUCKET_ROWS, "dimension string, bucket string")
    return F.broadcast(every).join(g, ["dimension", "bucket"], "left").withColumn("signals", F.coalesce("signals", F.lit(0)))


def _tune_sql(points: str) -> str:
    rows = ", ".join(f"({i}, '{d}', CAST({v} AS DOUBLE))" for i, (d, v) in enumerate([("base", 0.0)] + [(d, v) for d, (values, _) in TUNED.items() for v in values]))
    return f""", sg AS (SELECT * FROM (VALUES {rows}) v(i, dimension, value)),
tf AS (SELECT dimension, value, token_id, rule, t FROM ru, sg WHERE fired AND rule <> 'B' UNION ALL SELECT dimension, value, token_id, 'B', t FROM agg, sg WHERE minutes = 1440
  AND early_buyers >= 4 AND smart >= 6 AND coalesce(expansion + 1 <= CASE WHEN dimension = 'maxMcapExpansion' THEN value ELSE 3.0 END, false) AND CASE WHEN buy_usd > 0 THEN sell_usd / buy_usd * 100 ELSE 0.0 END <= 80.0){_kept("tf", "dimension, value, token_id, rule", "tk")},
tp AS (SELECT tk.* FROM tk LEFT JOIN (SELECT token_id, t, entities, net_usd FROM agg WHERE minutes = 30) g USING (token_id, t)
  WHERE rule <> 'A' OR CASE dimension WHEN 'minEntities' THEN coalesce(entities >= value, false) WHEN 'minNetFlow' THEN coalesce(net_usd >= value, false) ELSE true END){_hit_sql("tp", points)},
ts AS (SELECT sg.i, sg.dimension, sg.value, count(tp.token_id) AS signals, count(*) FILTER (hit) AS hits FROM sg LEFT JOIN (tp LEFT JOIN ht USING (token_id, t)) tp ON tp.dimension = sg.dimension AND tp.value = sg.value AND rule IN ('A', 'F') GROUP BY ALL),
tu AS (SELECT *, round(CASE WHEN signals > 0 THEN hits / signals ELSE 0.0 END, 6) AS hit_rate, signals < 5 AS few, CASE WHEN signals < 5 THEN 0.0 ELSE round(hits / signals, 6) END AS score FROM ts)"""


def _tuned(spark: SparkSession, d: str, grid: rp.Grid, within: bool = False) -> DataFrame:
    w = saved(_windows(spark, d, grid, within))
    m = p.market(spark, d)
    if within:
        m = m.where(f"ts between TIMESTAMP_NTZ '{grid.start}' and TIMESTAMP_NTZ '{grid.end}'")
    rules = saved(_rules(spark, d, w, grid if within else None))
    return rp.tuned_scores(_hits(rp.tuned_rules(rules, w, TUNED, SCALED), m), TUNED)


_TUNE = _REPLAY + _tune_sql("market")


@query(_TUNE + " SELECT dimension, value, signals, hits, hit_rate, score, few, round(score - (SELECT score FROM tu WHERE dimension = 'base'), 6) AS against_base, row_number() OVER (ORDER BY score DESC, i) AS place FROM tu")
def bt_tune(spark: SparkSession, d: str) -> DataFrame:
    """The base setting and one value at a time of six dimensions over one replay: signals of rules A and F that doubled.

    few: fewer than five signals, which score 0; place: by score, then in the grid's order.
    """
    g = saved(_tuned(spark, d, GRID))  # a row a setting
    base = g.where("dimension = 'base'").select(F.col("score").alias("base"))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "i"))
    return g.join(F.broadcast(base)).select("dimension", "value", "signals", "hits", "hit_rate", "score", "few", F.round(F.col("score") - F.col("base"), 6).alias("against_base"), place.alias("place"))


@query(_TUNE + " (SELECT dimension, value, 'best' AS side FROM tu ORDER BY score DESC, i LIMIT 3) UNION ALL (SELECT dimension, value, 'worst' AS side FROM tu ORDER BY score, i DESC LIMIT 3)")
def srt_best_worst_sets(spark: SparkSession, d: str) -> DataFrame:
    """The three best settings, and the three worst from the end of the same order."""
    s = saved(_tuned(spark, d, GRID))
    best = s.orderBy(F.desc("score"), "i").limit(3).select("dimension", "value", F.lit("best").alias("side"))
    return best.unionByName(s.orderBy("score", F.desc("i")).limit(3).select("dimension", "value", F.lit("worst").alias("side")))


def _half_sql(grid: rp.Grid) -> str:
    """The tuned scores of one half, from rows inside it alone."""
    span = f"ts BETWEEN TIMESTAMP '{grid.start}' AND TIMESTAMP '{grid.end}'"
    inside = f", in_trades AS (SELECT * FROM trades WHERE {span}), in_market AS (SELECT * FROM market WHERE {span})"
    seen = f" AND b.ts BETWEEN TIMESTAMP '{grid.start}' AND TIMESTAMP '{grid.end}'"
    chain = _stepped(grid, "in_trades", "in_market").replace("AND e.usd > 0 GROUP BY 1", f"AND e.usd > 0{seen} GROUP BY 1").replace("b.trade_id = rt.buy_id GROUP BY 1", f"b.trade_id = rt.buy_id{seen} GROUP BY 1")
    return inside + chain + _tune_sql("in_market")


def _walk_sql() -> str:
    from tideflow.sources.projection import VIEWS

    half = lambda g: f"(WITH {VIEWS}{flows._ROT}{_half_sql(g)} SELECT * FROM tu)"
    return f"""WITH tu1 AS {half(TUNE)}, tu2 AS {half(TEST)}, b AS (SELECT * FROM tu1 ORDER BY score DESC, i LIMIT 1),
wf AS (SELECT b.dimension, b.value, b.signals AS tune_signals, b.hit_rate AS tune_rate, c.signals AS test_signals, c.hit_rate AS test_rate FROM b JOIN (SELECT * FROM tu2 UNION ALL SELECT i, 'x', value, signals, hits, hit_rate, few, score FROM tu2 WHERE false) c
  ON c.dimension = CASE WHEN b.dimension IN ('minEntities', 'minNetFlow') THEN 'base' ELSE b.dimension END AND (c.value = b.value OR b.dimension IN ('minEntities', 'minNetFlow')))
SELECT *, round(CASE WHEN test_signals = 0 THEN 100.0 WHEN tune_rate > 0 THEN (tune_rate - test_rate) / tune_rate * 100 ELSE 0.0 END, 4) AS degradation_pct,
  CASE WHEN CASE WHEN test_signals = 0 THEN 100.0 WHEN tune_rate > 0 THEN (tune_rate - test_rate) / tune_rate * 100 ELSE 0.0 END > 30 THEN 'degrades' ELSE 'holds up' END AS verdict FROM wf"""


@query(_walk_sql(), views=False)
def bt_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """The best setting of the first half, tried on the second, each half from its own rows alone.

    A filter on rule A's fires is no setting, so where one is best, what goes on to the second half is the base.
    """
    best = _tuned(spark, d, TUNE, True).orderBy(F.desc("score"), "i").limit(1)
    filtered = F.col("dimension").isin(*rp.FILTERED)
    best = best.select("dimension", "value", F.col("signals").alias("tune_signals"), F.col("hit_rate").alias("tune_rate"), F.when(filtered, "base").otherwise(F.col("dimension")).alias("d"), F.when(filtered, 0.0).otherwise(F.col("value")).alias("v"))
    test = _tuned(spark, d, TEST, True).select(F.col("dimension").alias("d"), F.col("value").alias("v"), F.col("signals").alias("test_signals"), F.col("hit_rate").alias("test_rate"))
    a, b = F.col("tune_rate"), F.col("test_rate")
    lost = F.when(F.col("test_signals") == 0, 100.0).when(a > 0, (a - b) / a * 100).otherwise(0.0)
    out = best.join(test, ["d", "v"])
    return out.select("dimension", "value", "tune_signals", "tune_rate", "test_signals", "test_rate", F.round(lost, 4).alias("degradation_pct"), F.when(lost > 30, "degrades").otherwise("holds up").alias("verdict"))


@query(_TUNE + """ SELECT 'score' AS part, dimension AS name, value AS setting, score AS value FROM tu UNION ALL SELECT 'signals', dimension, value, signals FROM tu
  UNION ALL SELECT 'precision', rule, 0.0, round(count(*) FILTER (hit) / count(*), 6) FROM tp LEFT JOIN ht USING (token_id, t) WHERE dimension = 'base' GROUP BY rule
  UNION ALL SELECT 'most active token', CAST(token_id AS VARCHAR), 0.0, n FROM (SELECT token_id, count(*) AS n FROM trades GROUP BY 1 ORDER BY n DESC, token_id LIMIT 1)""")  # fmt: skip
def bt_run(spark: SparkSession, d: str) -> DataFrame:
    """A whole run as one report: scores and signals of all settings, the base's hit rate by rule, the most active token."""
    w = saved(_windows(spark, d, GRID))
    fires = saved(_hits(rp.tuned_rules(saved(_rules(spark, d, w)), w, TUNED, SCALED), p.market(spark, d)))
    g = saved(rp.tuned_scores(fires, TUNED))
    row = lambda df, part, name, setting, value: df.select(F.lit(part).alias("part"), name.cast("string").alias("name"), setting.cast("double").alias("setting"), value.cast("double").alias("value"))
    by_rule = fires.where("dimension = 'base'").groupBy("rule").agg(F.round(F.count_if("hit") / F.count("*"), 6).alias("rate"))
    top = p.trades(spark, d).groupBy("token_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token_id").limit(1)
    zero, c = F.lit(0.0), F.col
    parts = [row(g, "score", c("dimension"), c("value"), c("score")), row(g, "signals", c("dimension"), c("value"), c("signals")), row(by_rule, "precision", c("rule"), zero, c("rate")), row(top, "most active token", c("token_id"), zero, c("n"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
