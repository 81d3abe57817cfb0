"""Explanations of the replay's fires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.operators import explain as ex
from tideflow.operators import replay as rp
from tideflow.plans import replay as bq
from tideflow.plans import rotation as rq
from tideflow.plans.registry import query
from tideflow.plans.scalars import _FIXED, _FIXED1
from tideflow.sources.shared import saved


def _usd(x: str) -> str:
    a = f"abs({x})"
    large = " ".join(f"WHEN {a} >= {m} THEN regexp_replace({_FIXED1.format(x=f'({a} / {m})')}, '\\.0$', '') || '{n}'" for m, n in (("1e9", "B"), ("1e6", "M"), ("1e3", "k")))
    return f"CASE WHEN {x} = 0 THEN '$0.00' ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END || '$' || CASE {large} WHEN {a} >= 1 THEN {_FIXED.format(x=a, m=100, n=2)} WHEN {a} >= 0.00005 THEN {_FIXED.format(x=a, m=10000, n=4)} ELSE {_FIXED.format(x=a, m=1000000, n=6)} END END"


def _signed(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN '+' ELSE '' END || ({_usd(x)})"


def _whole(x: str) -> str:
    return f"CAST(CAST(floor({x} + 0.5) AS BIGINT) AS VARCHAR)"


_BAND = "CASE WHEN confidence <= 30 THEN 'weak' WHEN confidence <= 60 THEN 'possible' WHEN confidence <= 80 THEN 'probable' ELSE 'strong' END"
# The chains' own views start with those that the replay's have in front, so these are put in once.
_SQL = bq._FIRES + rq._CHAINS.removeprefix(bq.flows._ROT) + f""",
fg AS (SELECT token_id, minutes, t, smart, entities, net_usd, sold_pct, coalesce(expansion, 0.0) + 1 AS multiple, coalesce(liquidity, 0.0) AS liquidity, lag(smart) OVER s AS was_smart, lag(net_usd) OVER s AS was_net FROM agg WINDOW s AS (PARTITION BY token_id, minutes ORDER BY k)),
ch AS (SELECT * FROM cn QUALIFY row_number() OVER (PARTITION BY to_token, buy_ts, buy_id ORDER BY confidence DESC, gap_min, from_token) = 1),
fx AS (SELECT token_id, rule, t, severity, coalesce(rule = 'F' AND buy_id IS NOT NULL, false) AS rotation, '$T' || token_id AS name, '$T' || from_token AS source, sent, got, bridged, protocol, gap_min, confidence
  FROM fr JOIN ru USING (token_id, rule, t) LEFT JOIN ch ON to_token = token_id AND buy_ts <= t QUALIFY row_number() OVER (PARTITION BY token_id, rule, t ORDER BY buy_ts DESC NULLS LAST, buy_id DESC) = 1),
ft AS (SELECT * FROM fx JOIN fg USING (token_id, t) WHERE minutes = CASE WHEN rule IN ('B', 'G') THEN 1440 ELSE 30 END)
SELECT token_id, rule, t, CASE WHEN rotation THEN source || ' → ' || name || ': probable profit rotation' WHEN rule = 'G' THEN name || ': exit warning (' || lower(severity) || ')' ELSE name || ': ' || lower(severity) || ' signal (rule ' || rule || ')' END AS headline,
  CASE WHEN rotation THEN 'Wallet group realized profit on ' || source || CASE WHEN bridged THEN ', bridged funds through ' || coalesce(protocol, 'a cross-chain bridge') || ',' ELSE ',' END || ' and a linked wallet bought ' || name || ' ' || {_whole("gap_min")} || ' minutes later. Amount match: ' || {_whole("got / sent * 100")} || '%. Confidence: ' || {_BAND} || '.'
    WHEN rule = 'G' THEN smart || ' previously-tracked smart wallets are showing distribution on ' || name || ' — ' || {_whole("sold_pct")} || '% of buyers have sold their position. Net smart flow has turned to ' || {_signed("net_usd")} || ', and liquidity stands at ' || {_usd("liquidity")} || '.'
    ELSE smart || ' tracked smart wallets bought ' || name || ', but entity clustering estimates ' || entities || ' unique entities. Net smart flow is ' || {_signed("net_usd")} || ', sell pressure is ' || CASE WHEN sold_pct < 20 THEN 'low' WHEN sold_pct < 40 THEN 'moderate' ELSE 'high' END || ' (' || {_whole("sold_pct")} || '% of buyers have sold), and market cap expanded only ' || {_FIXED1.format(x="multiple")} || 'x from average smart entry.' END AS why,
  CASE WHEN rotation THEN 'Amount match falling outside the 80-105% band; Re-buy landing beyond the 60-minute window; No further linked wallets repeating the pattern'
    WHEN rule = 'G' THEN 'Exited smart-wallet share dropping back below 30%; Liquidity stabilizing (no further drop beyond 30%); Net smart flow turning positive with new smart buyers returning'
    ELSE 'Sell pressure rising above 60% of buyers; Market cap expanding beyond 3× average smart entry; Net smart flow turning negative' END AS invalidates,
  CASE WHEN smart >= was_smart THEN '+' ELSE '' END || (smart - was_smart) || ' smart wallet' || CASE WHEN abs(smart - was_smart) = 1 THEN '' ELSE 's' END || ' and ' || {_signed("(net_usd - was_net)")} || ' net flow since the last check.' AS changed,
  CASE WHEN rotation THEN 'This looks like a ' || {_BAND} || ' profit rotation from ' || source || ' into ' || name || ', not a coincidental buy.' WHEN rule = 'G' THEN 'This looks like an exit warning — smart money distribution, not fresh accumulation.' WHEN rule = 'F' THEN 'No clear read yet — insufficient signal to characterize this move.'
    WHEN multiple < 1.5 THEN 'This looks like accumulation, not late chase.' WHEN multiple > 2 THEN 'This looks like expansion already underway — late-entry risk.' ELSE 'This sits between early accumulation and a confirmed chase — worth continued watching, not yet a clear read.' END AS conclusion FROM ft"""


@query(_SQL)
def explain(spark: SparkSession, d: str) -> DataFrame:
    """Each kept fire of the replay in words, from its window at that step, the step before and the last known rotation."""
    windows = saved(bq._windows(spark, d, bq.GRID))
    fires = rp.replayed_fires(bq._rules(spark, d, windows)).withColumn("symbol", F.concat(F.lit("T"), F.col("token_id").cast("string")))
    told = ex.with_chains(saved(fires), rq._chains(spark, d))
    out = ex.explained(told, ex.figures(windows), bq.SCALED)
    return out.select("token_id", "rule", "t", "headline", F.array_join("why", " ").alias("why"), F.array_join("invalidates", "; ").alias("invalidates"), "changed", "conclusion")
