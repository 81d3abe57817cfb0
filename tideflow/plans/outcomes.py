"""Queries over signal outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.operators import outcome_panes as ix
from tideflow.operators import outcomes as oc
from tideflow.operators import temporal as tm
from tideflow.plans.registry import query
from tideflow.sources import projection as p

_S = """,
pts AS (SELECT signal_id, m.ts, m.point_id, (epoch_us(m.ts) - epoch_us(fired_at)) / 60000000.0 AS minutes, CASE WHEN entry_price > 0 THEN price / entry_price END AS multiple, liquidity * 10 AS liquidity
  FROM signals s JOIN market m ON m.token_id = s.token_id AND m.ts >= s.fired_at AND epoch_us(m.ts) - epoch_us(fired_at) <= 604800000000),
ex AS (SELECT signal_id, round((max(multiple) - 1) * 100, 6) AS max_upside_pct, round((min(multiple) - 1) * 100, 6) AS max_drawdown_pct, round((arg_max(multiple, (ts, point_id)) - 1) * 100, 6) AS roi_pct,
  round(arg_min(minutes, (-multiple, minutes)), 6) AS to_peak, round(min(minutes) FILTER (multiple >= 2), 6) AS to_2x, round(min(minutes) FILTER (multiple >= 5), 6) AS to_5x, round(min(minutes) FILTER (multiple >= 10), 6) AS to_10x
  FROM pts WHERE multiple IS NOT NULL GROUP BY 1),
wd AS (SELECT *, min(multiple) OVER w AS lb, max(multiple) OVER w AS tb, first_value(liquidity) OVER (PARTITION BY signal_id ORDER BY ts, point_id) AS el FROM pts WINDOW w AS (PARTITION BY signal_id ORDER BY ts, point_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lb AS (SELECT signal_id, CASE WHEN coalesce(bool_or(liquidity IS NOT NULL AND coalesce(tb < 2, true) AND (coalesce(el > 0 AND liquidity <= el * 0.1::DOUBLE, false) OR liquidity < 1000)), false) THEN 'hard_failure'
  WHEN coalesce(bool_or(multiple >= 5 AND coalesce(lb > 0.4::DOUBLE, true)), false) THEN 'major_win' WHEN coalesce(bool_or(multiple >= 2 AND coalesce(lb > 0.5, true)), false) THEN 'good_win' WHEN coalesce(bool_or(multiple >= 1.5 AND coalesce(lb > 0.5, true)), false) THEN 'small_win'
  WHEN coalesce(bool_or(multiple <= 0.4::DOUBLE AND coalesce(tb < 2, true)), false) THEN 'failure' ELSE 'neutral_pending' END AS label FROM wd GROUP BY 1),
ev2 AS (SELECT s.signal_id, s.token_id, s.rule, s.severity, s.synthetic, max_upside_pct, max_drawdown_pct, roi_pct, label FROM signals s JOIN lb USING (signal_id) LEFT JOIN ex USING (signal_id))
"""
_SUM = """count(*) AS signals, round(count(*) FILTER (max_upside_pct >= 50) / count(*), 6) AS hit_50, round(count(*) FILTER (max_upside_pct >= 100) / count(*), 6) AS hit_2x, round(count(*) FILTER (max_upside_pct >= 400) / count(*), 6) AS hit_5x,
  round(quantile_cont(roi_pct, 0.5), 4) AS median_return, round(CAST(sum(CAST(roi_pct AS DECIMAL(24,6))) AS DOUBLE) / count(roi_pct), 4) AS avg_return, max(max_upside_pct) AS max_upside, min(max_drawdown_pct) AS max_drawdown,
  round(count(*) FILTER (label = 'failure') / count(*), 6) AS failure_rate, round(count(*) FILTER (label = 'hard_failure') / count(*), 6) AS hard_failure_rate"""


def _market(spark: SparkSession, d: str) -> DataFrame:
    return p.market(spark, d).withColumn("liquidity", F.col("liquidity") * 10)


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Label and extremes of each signal with points, from the index over market points."""
    return ix.judged(p.signals(spark, d), _market(spark, d))


def slices(spark: SparkSession, d: str) -> DataFrame:
    """Extremes of each signal up to each horizon, from the same index."""
    return ix.horizon_slices(p.signals(spark, d), _market(spark, d))


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    return p.signals(spark, d).join(judged(spark, d), "signal_id")


@query(_S + "SELECT * FROM ex")
def win_outcome_extremes(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).where("max_upside_pct is not null").drop("label")


@query(_S + "SELECT * FROM lb")
def win_outcome_label(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("signal_id", "label")


_HZ = _S + """, hz AS (SELECT signal_id, horizon, round((max(multiple) - 1) * 100, 6) AS max_upside_pct, round((min(multiple) - 1) * 100, 6) AS max_drawdown_pct, round((arg_max(multiple, (ts, point_id)) - 1) * 100, 6) AS roi_pct
  FROM pts JOIN (VALUES ('M15', 15), ('H1', 60), ('H6', 360), ('H24', 1440), ('D3', 4320), ('D7', 10080)) h(horizon, lim) ON minutes <= lim WHERE multiple IS NOT NULL GROUP BY 1, 2)
"""


@query(_HZ + "SELECT * FROM hz")
def win_horizon_slices(spark: SparkSession, d: str) -> DataFrame:
    return slices(spark, d)


@query(_HZ + "SELECT signal_id, horizon, roi_pct FROM hz QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY CASE horizon WHEN 'D7' THEN 6 WHEN 'D3' THEN 5 WHEN 'H24' THEN 4 WHEN 'H6' THEN 3 WHEN 'H1' THEN 2 ELSE 1 END DESC) = 1")
def win_best_horizon(spark: SparkSession, d: str) -> DataFrame:
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(oc.HORIZONS) for x in (F.lit(k), F.lit(i))]), F.col("horizon"))
    return tm.nth_by(slices(spark, d), ["signal_id"], [rank.desc()]).select("signal_id", "horizon", "roi_pct")


@query(_HZ + "SELECT signal_id, horizon, roi_pct FROM hz JOIN signals USING (signal_id) JOIN (VALUES ('M15', 15), ('H1', 60), ('H6', 360), ('H24', 1440), ('D3', 4320), ('D7', 10080)) h(horizon, lim) USING (horizon) WHERE epoch_us(TIMESTAMP '2024-01-28') - epoch_us(fired_at) >= CAST(lim AS BIGINT) * 60000000 QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY lim DESC) = 1")
def win_latest_elapsed(spark: SparkSession, d: str) -> DataFrame:
    lim = F.element_at(F.create_map(*[x for k, v in oc.HORIZONS.items() for x in (F.lit(k), F.lit(v))]), F.col("horizon"))
    h = slices(spark, d).join(p.signals(spark, d).select("signal_id", "fired_at"), "signal_id").withColumn("lim", lim)
    gone = F.expr("unix_micros(cast(TIMESTAMP_NTZ '2024-01-28 00:00:00' as timestamp)) - unix_micros(cast(fired_at as timestamp))")
    return tm.nth_by(h.where(gone >= F.col("lim") * F.lit(60_000_000).cast("long")), ["signal_id"], [F.desc("lim")]).select("signal_id", "horizon", "roi_pct")


@query(_S + f"SELECT {_SUM} FROM ev2")
def agg_outcome_summary(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).agg(*oc.summary_columns())


@query(_S + f", g AS (SELECT rule, synthetic, {_SUM} FROM ev2 GROUP BY ALL) SELECT r.rule, r.synthetic, coalesce(signals, 0) AS signals, hit_50, hit_2x, median_return, avg_return, failure_rate FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E', 'F', 'G']) AS rule, synthetic FROM (VALUES (true), (false)) v(synthetic)) r LEFT JOIN g USING (rule, synthetic)")
def agg_rule_perf(spark: SparkSession, d: str) -> DataFrame:
    """All seven rules for real and synthetic signals, also those without any."""
    dim = spark.range(14).select(F.element_at(F.array(*[F.lit(x) for x in "ABCDEFG"]), (F.col("id") % 7 + 1).cast("int")).alias("rule"), (F.col("id") < 7).alias("synthetic"))
    g = _evaluated(spark, d).groupBy("rule", "synthetic").agg(*oc.summary_columns())
    return dim.join(g, ["rule", "synthetic"], "left").select("rule", "synthetic", F.coalesce("signals", F.lit(0)).alias("signals"), "hit_50", "hit_2x", "median_return", "avg_return", "failure_rate")


@query(_S + "(SELECT signal_id, roi_pct, 'best' AS side FROM ev2 WHERE roi_pct IS NOT NULL ORDER BY roi_pct DESC, signal_id LIMIT 6) UNION ALL (SELECT signal_id, roi_pct, 'worst' AS side FROM ev2 WHERE roi_pct IS NOT NULL ORDER BY roi_pct, signal_id LIMIT 6)")
def srt_win_fail(spark: SparkSession, d: str) -> DataFrame:
    e = _evaluated(spark, d).where("roi_pct is not null").select("signal_id", "roi_pct")
    best = e.orderBy(F.desc("roi_pct"), "signal_id").limit(6).withColumn("side", F.lit("best"))
    return best.unionByName(e.orderBy("roi_pct", "signal_id").limit(6).withColumn("side", F.lit("worst")))


_SHADOW_NOW = "2024-01-28 00:00:00"


@query(_HZ + f""", st AS (SELECT s.signal_id, h.horizon, hz.signal_id IS NOT NULL AS told, epoch_us(TIMESTAMP '{_SHADOW_NOW}') - epoch_us(fired_at) AS age, lim, label FROM signals s CROSS JOIN (VALUES ('M15', 15), ('H1', 60), ('H6', 360), ('H24', 1440), ('D3', 4320), ('D7', 10080)) h(horizon, lim) LEFT JOIN hz USING (signal_id, horizon) LEFT JOIN lb USING (signal_id)),
  sx AS (SELECT signal_id, horizon, CASE WHEN NOT told THEN 'unknown' WHEN age < CAST(lim AS BIGINT) * 60000000 THEN 'pending' WHEN label IN ('small_win', 'good_win', 'major_win') THEN 'good' WHEN label IN ('failure', 'hard_failure') THEN 'bad' WHEN age < 604800000000 THEN 'pending' ELSE 'unknown' END AS status FROM st)
  SELECT signal_id, max(status) FILTER (horizon = 'M15') AS m15, max(status) FILTER (horizon = 'D7') AS d7, CASE WHEN bool_or(status = 'bad') THEN 'bad' WHEN bool_or(status = 'good') THEN 'good' WHEN bool_or(status = 'pending') THEN 'pending' ELSE 'unknown' END AS overall FROM sx GROUP BY 1""")
def bt_shadow(spark: SparkSession, d: str) -> DataFrame:
    """Each signal's status at its first and last horizon and overall: the worst that any horizon tells; after seven days nothing is pending."""
    s = p.signals(spark, d).join(judged(spark, d).select("signal_id", "label"), "signal_id", "left")
    told = slices(spark, d).select("signal_id", "horizon", F.lit(True).alias("told"))
    age = F.unix_micros(F.lit(_SHADOW_NOW).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col("fired_at").cast("timestamp"))
    h = F.explode(F.array(*[F.struct(F.lit(k).alias("horizon"), F.lit(v).cast("long").alias("lim")) for k, v in oc.HORIZONS.items()]))
    x = s.select("signal_id", "label", age.alias("age"), h.alias("h")).select("signal_id", "label", "age", "h.*").join(told, ["signal_id", "horizon"], "left")
    lab = F.col("label")
    status = F.when(F.col("told").isNull(), "unknown").when(F.col("age") < F.col("lim") * 60_000_000, "pending").when(lab.isin("major_win", "good_win", "small_win"), "good").when(lab.isin("failure", "hard_failure"), "bad").when(F.col("age") < 604_800_000_000, "pending").otherwise("unknown")
    x = x.withColumn("status", status)
    any_ = lambda v: F.bool_or(F.col("status") == v)
    at = lambda k: F.max(F.when(F.col("horizon") == k, F.col("status")))
    return x.groupBy("signal_id").agg(at("M15").alias("m15"), at("D7").alias("d7"), F.when(any_("bad"), "bad").when(any_("good"), "good").when(any_("pending"), "pending").otherwise("unknown").alias("overall"))


@query(_S + "SELECT synthetic, count(*) AS n FROM ev2 GROUP BY 1")
def flt_real_synthetic(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).groupBy("synthetic").agg(F.count("*").alias("n"))


@query(_HZ + "SELECT s.signal_id FROM signals s LEFT JOIN (SELECT signal_id, count(*) AS n FROM hz GROUP BY 1) USING (signal_id) WHERE coalesce(n, 0) < 6")
def flt_eligible_backtest(spark: SparkSession, d: str) -> DataFrame:
    n = slices(spark, d).groupBy("signal_id").count()
    return p.signals(spark, d).join(n, "signal_id", "left").where(F.coalesce("count", F.lit(0)) < 6).select("signal_id")


#: Settings that the replay tries: smart buyers that a fire takes.
TRIED = (2, 4, 6, 8, 10)
_REPLAY = """,
sp AS (SELECT * FROM generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-25', INTERVAL 12 HOUR) x(t)),
rp AS (SELECT token_id, t, count(DISTINCT wallet_id) FILTER (action = 'BUY' AND (is_watched OR meets_profitable)) AS smart, CAST(coalesce(sum(usd) FILTER (action = 'BUY'), 0) AS DOUBLE) AS buy_usd FROM trades JOIN wallets USING (wallet_id) JOIN sp ON ts <= t AND ts >= t - INTERVAL 24 HOUR GROUP BY ALL),
mk AS (SELECT token_id, ts, arg_max(price, point_id) AS price FROM market GROUP BY ALL), en AS (SELECT rp.*, mk.price AS entry FROM rp ASOF LEFT JOIN mk ON mk.token_id = rp.token_id AND mk.ts <= rp.t),
ho AS (SELECT en.token_id, t, smart, buy_usd, coalesce(max(price) FILTER (entry > 0) / any_value(entry) >= 2, false) AS hit FROM en LEFT JOIN market m ON m.token_id = en.token_id AND m.ts >= t AND epoch_us(m.ts) - epoch_us(t) <= 604800000000 GROUP BY en.token_id, t, smart, buy_usd),
cd AS (SELECT v.n AS min_smart, token_id, t FROM ho, (VALUES (2), (4), (6), (8), (10)) v(n) WHERE smart >= v.n),
fr AS (SELECT min_smart, token_id, t FROM (WITH RECURSIVE f AS (SELECT min_smart, token_id, min(t) AS t FROM cd GROUP BY ALL UNION ALL SELECT f.min_smart, f.token_id, (SELECT min(t) FROM cd c WHERE c.min_smart = f.min_smart AND c.token_id = f.token_id AND c.t >= f.t + INTERVAL 24 HOUR) FROM f WHERE f.t IS NOT NULL) SELECT * FROM f) WHERE t IS NOT NULL),
fh AS (SELECT fr.*, hit FROM fr JOIN ho USING (token_id, t))
"""


def _replay(spark: SparkSession, d: str) -> DataFrame:
    """token_id, t, smart, buy_usd of each token at each step: a trade goes to the steps within a day after it, so there's no join."""
    w = p.wallets(spark, d).select("wallet_id", (F.col("is_watched") | F.col("meets_profitable")).alias("of_smart"))
    t = p.trades(spark, d).where("ts >= TIMESTAMP_NTZ '2024-01-04 00:00:00' and ts <= TIMESTAMP_NTZ '2024-01-25 00:00:00'").join(w, "wallet_id")
    steps = F.expr("filter(sequence(TIMESTAMP_NTZ '2024-01-05 00:00:00', TIMESTAMP_NTZ '2024-01-25 00:00:00', INTERVAL 12 HOURS), s -> s >= ts and s <= ts + INTERVAL 24 HOURS)")
    buy = F.col("action") == "BUY"
    return t.withColumn("t", F.explode(steps)).groupBy("token_id", "t").agg(F.count_distinct(F.when(buy & F.col("of_smart"), F.col("wallet_id"))).alias("smart"), F.coalesce(F.sum(F.when(buy, F.col("usd"))), F.lit(0)).cast("double").alias("buy_usd"))


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    """min_smart, token_id, t, hit: fires of each setting after the day's dedupe, and whether the price doubled in seven days."""
    m = p.market(spark, d)
    rows = tm.asof(_replay(spark, d), m.withColumn("entry_price", F.col("price")), ["token_id"], "t", "ts", "point_id", ["entry_price"])
    as_signals = rows.select(F.struct("token_id", "t").alias("signal_id"), "token_id", F.col("t").alias("fired_at"), "entry_price")
    doubled = ix.horizon_slices(as_signals, m).where("horizon = 'D7'").select("signal_id.token_id", "signal_id.t", (F.col("max_upside_pct") >= 100).alias("hit"))
    tried = rows.withColumn("min_smart", F.explode(F.array(*[F.lit(x) for x in TRIED]))).where("smart >= min_smart")
    fires = tm.kept_fires(tried.select("min_smart", "token_id", F.col("t")), ["min_smart", "token_id"], "t")
    return fires.join(doubled, ["token_id", "t"], "left").select("min_smart", "token_id", "t", F.coalesce("hit", F.lit(False)).alias("hit"))


@query(_REPLAY + "SELECT * FROM rp")
def bt_replay_smart(spark: SparkSession, d: str) -> DataFrame:
    """Smart buyers and volume of each token at each step of half a day."""
    return _replay(spark, d)


@query(_REPLAY + "SELECT * FROM fh")
def bt_replay_fires(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d)


@query("""SELECT token_id, greatest(lo, least(x.t, hi)) AS t FROM (SELECT token_id, min(ts) AS lo, max(ts) AS hi FROM trades GROUP BY 1) e, unnest(generate_series(lo, hi, INTERVAL 3 DAY)) x(t) UNION SELECT token_id, max(ts) FROM trades GROUP BY 1""")
def fn_step_series(spark: SparkSession, d: str) -> DataFrame:
    """Steps of three days from each token's first trade to its last, which is always one."""
    e = p.trades(spark, d).groupBy("token_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    steps = F.array_union(F.expr("sequence(lo, hi, INTERVAL 3 DAYS)"), F.array("hi"))
    return e.select("token_id", F.explode(steps).alias("t"))
