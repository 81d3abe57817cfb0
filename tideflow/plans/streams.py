"""Queries over streams: each drips a table in four parts of time and gives what the runs leave, as the batch form would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.plans.registry import query
from tideflow.sources import projection as p
from tideflow.streaming import jobs

CUTS = ("2024-01-01", "2024-01-09", "2024-01-17", "2024-01-25", "2100-01-01")


def _parts(df: DataFrame, ts: str) -> list[DataFrame]:
    at = lambda t: F.lit(f"{t} 00:00:00").cast("timestamp_ntz")
    return [df.where((F.col(ts) >= at(a)) & (F.col(ts) < at(b))) for a, b in zip(CUTS, CUTS[1:])]


def _trades(spark: SparkSession, d: str) -> DataFrame:
    return p.trades(spark, d).select("trade_id", "wallet_id", "token_id", "action", F.col("usd").cast("double").alias("usd"), "ts")


@query("SELECT token_id, count(*) AS n FROM trades WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY 1")
def st_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Counts that each run adds to: the checkpoint keeps what was read."""
    t = jobs.Table(spark, "counts", ["token_id"])
    run = jobs.into(t, jobs.added(["token_id"], ["n"]), of=lambda s: s.select("token_id", F.lit(1).cast("long").alias("n")))
    jobs.drip(spark, _parts(_trades(spark, d), "ts"), run)
    return t.read()


@query("SELECT trade_id, wallet_id, usd::DOUBLE AS usd FROM trades WHERE ts >= TIMESTAMP '2024-01-01'")
def st_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """Every part comes twice; natural keys leave each row once."""
    t = jobs.Table(spark, "trades", ["trade_id"])
    parts = [x for part in _parts(_trades(spark, d).select("trade_id", "wallet_id", "usd", "ts"), "ts") for x in (part, part)]
    jobs.drip(spark, parts, jobs.into(t, jobs.inserted(["trade_id"])))
    return t.read().select("trade_id", "wallet_id", "usd")


@query(", l AS (SELECT token_id, max(date_trunc('hour', ts)) AS last FROM trades WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY 1) SELECT token_id, CAST(sum(usd) FILTER (action = 'BUY') AS DOUBLE) AS buy_usd, count(*) AS n FROM trades JOIN l USING (token_id) WHERE ts >= TIMESTAMP '2024-01-01' AND date_trunc('hour', ts) > last - INTERVAL 24 HOUR GROUP BY 1")
def st_window_anchored(spark: SparkSession, d: str) -> DataFrame:
    """The last 24 whole hours up to each token's latest trade, from hourly sums that the runs keep."""
    t = jobs.Table(spark, "hours", ["token_id", "hour"])
    hourly = lambda s: s.select("token_id", F.date_trunc("hour", "ts").alias("hour"), F.when(F.col("action") == "BUY", F.col("usd").cast("decimal(20,4)")).alias("buy_usd"), F.lit(1).cast("long").alias("n"))
    jobs.drip(spark, _parts(_trades(spark, d), "ts"), jobs.into(t, lambda old, new: jobs.added(["token_id", "hour"], ["buy_usd", "n"])(None if old is None else old.withColumn("buy_usd", F.col("buy_usd").cast("decimal(38,4)")), new.withColumn("buy_usd", F.col("buy_usd").cast("decimal(38,4)"))).withColumn("buy_usd", F.col("buy_usd").cast("decimal(38,4)")), of=hourly))
    h = t.read()
    last = h.groupBy("token_id").agg(F.max("hour").alias("last"))  # one row a token
    recent = h.join(last, "token_id").where(F.col("hour") > F.col("last") - F.expr("INTERVAL 24 HOURS"))
    return recent.groupBy("token_id").agg(F.sum("buy_usd").cast("double").alias("buy_usd"), F.sum("n").alias("n"))


_SLIDES = ", w AS (SELECT token_id, to_timestamp(CAST(floor(epoch(ts) / 43200) AS BIGINT) * 43200 + 43200 * u) AT TIME ZONE 'UTC' AS until FROM trades, (VALUES (1), (2)) v(u) WHERE ts >= TIMESTAMP '2024-01-01')"


@query(_SLIDES + " SELECT token_id, until, count(*) AS n FROM w GROUP BY ALL")
def st_trailing(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the last day at every half day."""
    t = jobs.Table(spark, "trailing")
    jobs.drip(spark, _parts(_trades(spark, d), "ts"), jobs.into(t, jobs.replaced, "complete", lambda s: jobs.trailing(s, "ts", ["token_id"], 1440, 720)))
    return t.read()


@query(""", e AS (SELECT * FROM signals WHERE fired_at >= TIMESTAMP '2024-01-01')
SELECT token_id, rule, ts FROM (WITH RECURSIVE f AS (SELECT token_id, rule, min(fired_at) AS ts FROM e GROUP BY ALL UNION ALL SELECT f.token_id, f.rule, (SELECT min(fired_at) FROM e s WHERE s.token_id = f.token_id AND s.rule = f.rule AND s.fired_at >= f.ts + INTERVAL 24 HOUR) FROM f WHERE f.ts IS NOT NULL) SELECT * FROM f) WHERE ts IS NOT NULL""")
def st_dedupe_24h(spark: SparkSession, d: str) -> DataFrame:
    """Fires that no kept one of their token and rule precedes by less than a day."""
    t = jobs.Table(spark, "fires", ["id"])
    s = p.signals(spark, d).select("token_id", "rule", F.col("signal_id").alias("id"), "fired_at")
    run = jobs.into(t, jobs.inserted(["id"]), of=lambda x: jobs.gated(x, ["token_id", "rule"], "fired_at", 1440, F.lit(-1)).where("passed"))
    jobs.drip(spark, _parts(s, "fired_at"), run)
    return t.read().select("token_id", "rule", F.col("ts").cast("timestamp_ntz").alias("ts")).distinct()


@query(""", a AS (SELECT *, lag(fired_at) OVER w AS before, lag(severity) OVER w AS was FROM signals WHERE fired_at >= TIMESTAMP '2024-01-01' WINDOW w AS (PARTITION BY token_id, rule ORDER BY fired_at, signal_id))
SELECT signal_id, before IS NULL OR epoch_us(fired_at) - epoch_us(before) >= 7200000000 OR (severity = 'CRITICAL' AND was <> 'CRITICAL') AS passed FROM a""")
def st_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """Alerts after two hours without one of their token and rule, or on the first critical one."""
    t = jobs.Table(spark, "alerts", ["id"])
    s = p.signals(spark, d).select("token_id", "rule", F.col("signal_id").alias("id"), "fired_at", "severity")
    run = jobs.into(t, jobs.inserted(["id"]), of=lambda x: jobs.gated(x, ["token_id", "rule"], "fired_at", 120, (F.col("severity") == "CRITICAL").cast("int")))
    jobs.drip(spark, _parts(s, "fired_at"), run)
    return t.read().select(F.col("id").alias("signal_id"), "passed")


@query(" SELECT token_id, date_trunc('day', ts) + INTERVAL 1 DAY AS until, count(*) AS n FROM trades WHERE ts >= TIMESTAMP '2024-01-01' AND (ts >= TIMESTAMP '2024-01-05' OR trade_id % 5 <> 0) GROUP BY ALL".replace(" SELECT", "SELECT", 1))
def st_late(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts; rows that come two days or more after their day has ended are dropped. Here every fifth of the first days comes last."""
    t = jobs.Table(spark, "daily", ["token_id", "until"])
    early = (F.col("ts") < F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")) & (F.col("trade_id") % 5 == 0)
    rows = _trades(spark, d)
    parts = [*_parts(rows.where(~early), "ts"), rows.where(early)]

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        if old is None:
            return new
        return old.join(new.select("token_id", "until"), ["token_id", "until"], "left_anti").select(*new.columns).unionByName(new)

    jobs.drip(spark, parts, jobs.into(t, merge, "update", lambda s: jobs.trailing(s, "ts", ["token_id"], 1440, 1440, "2 days")))
    return t.read()
