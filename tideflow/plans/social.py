"""Mentions, spam, velocity and liquidity risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.operators import social as so
from tideflow.operators import temporal as tm
from tideflow.plans.registry import query
from tideflow.sources import projection as p

_A = "[1-9A-HJ-NP-Za-km-z]{32,44}"
_M = f""",
ln AS (SELECT post_id, author, posted_at, 'url' AS kind, unnest(list_distinct(regexp_extract_all(content, 'https?://(?:www\\.)?(?:dexscreener\\.com/solana/|birdeye\\.so/token/|solscan\\.io/token/|pump\\.fun/(?:coin/)?)({_A})', 1))) AS token, 85 AS confidence FROM posts),
ba AS (SELECT post_id, author, posted_at, 'address' AS kind, unnest(list_distinct(regexp_extract_all(regexp_replace(content, 'https?://\\S+', ' ', 'g'), '{_A}'))) AS token, 90 AS confidence FROM posts),
tg AS (SELECT post_id, author, posted_at, 'ticker' AS kind, unnest(list_distinct(list_transform(regexp_extract_all(content, '\\$([A-Za-z][A-Za-z0-9]{{1,9}})\\b', 1), lambda x: upper(x)))) AS token, 40 AS confidence FROM posts),
mn AS (SELECT * FROM ln UNION ALL SELECT * FROM ba WHERE regexp_matches(token, '[1-9]') AND NOT EXISTS (SELECT 1 FROM ln WHERE ln.post_id = ba.post_id AND ln.token = ba.token) UNION ALL SELECT * FROM tg)
"""
_NOW = "2024-01-20 00:00:00"
_N = ", ".join(f"count(*) FILTER (posted_at BETWEEN TIMESTAMP '{_NOW}' - INTERVAL {m} MINUTE AND TIMESTAMP '{_NOW}') AS n_{m}, count(DISTINCT author) FILTER (posted_at BETWEEN TIMESTAMP '{_NOW}' - INTERVAL {m} MINUTE AND TIMESTAMP '{_NOW}') AS authors_{m}" for m in (60, 360, 1440))


@query(_M + "SELECT post_id, kind, token, confidence FROM mn")
def soc_extract(spark: SparkSession, d: str) -> DataFrame:
    return so.mentions(p.posts(spark, d)).select("post_id", "kind", "token", "confidence")


@query("SELECT post_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(content), 'https?://\\S+', ' ', 'g'), '@\\w+', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), 1, 280) AS snippet FROM posts")
def fn_normalize_snippet(spark: SparkSession, d: str) -> DataFrame:
    return p.posts(spark, d).select("post_id", so.snippet(F.col("content")).alias("snippet"))


def _spam_sql(posts: str = "posts") -> str:
    """The look-back and the weights are fixed values."""
    return f""",
spm AS (SELECT p.post_id,
  CASE WHEN n >= 3 THEN 80 WHEN author IS NOT NULL AND b >= 5 THEN 60 WHEN length(regexp_replace(s, '[^a-z0-9]', '', 'g')) < 12 THEN 50 ELSE 0 END AS spam_score,
  CASE WHEN n >= 3 THEN 'copypasta' WHEN author IS NOT NULL AND b >= 5 THEN 'repeat_author' WHEN length(regexp_replace(s, '[^a-z0-9]', '', 'g')) < 12 THEN 'low_content' END AS spam_reason
FROM (SELECT *, count(DISTINCT author) OVER (PARTITION BY s ORDER BY posted_at RANGE BETWEEN INTERVAL 360 MINUTE PRECEDING AND CURRENT ROW) AS n, count(*) OVER (PARTITION BY author ORDER BY posted_at RANGE BETWEEN INTERVAL 360 MINUTE PRECEDING AND CURRENT ROW) AS b
  FROM (SELECT *, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(content), 'https?://\\S+', ' ', 'g'), '@\\w+', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), 1, 280) AS s FROM {posts})) p)
"""


_SPAM = _spam_sql()


@query(_M + _SPAM + f", ok AS (SELECT mn.* FROM mn JOIN spm USING (post_id) WHERE spam_score < 70), v AS (SELECT token, {_N} FROM ok GROUP BY 1) SELECT *, round(CASE WHEN n_1440 > 0 THEN (n_60 / 60) / (n_1440 / 1440) ELSE 0.0 END, 6) AS accel FROM v")
def soc_velocity(spark: SparkSession, d: str) -> DataFrame:
    """Velocity of the mentions in posts that aren't hidden as spam."""
    posts = p.posts(spark, d)
    fine = so.spam(posts).where("spam_score < 70").select("post_id")
    return so.velocity(so.mentions(posts).join(fine, "post_id"), _NOW)


@query(_M + ", src AS (SELECT unnest([0, 1, 2, 3, 4]) AS source) SELECT source, count(post_id) AS n, count(DISTINCT token) AS tokens FROM src LEFT JOIN mn ON author % 4 = source GROUP BY 1")
def agg_social_health(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of each source, also of those without any."""
    m = so.mentions(p.posts(spark, d)).select((F.col("author") % 4).alias("source"), "post_id", "token")
    src = spark.range(5).select(F.col("id").alias("source"))
    return src.join(m, "source", "left").groupBy("source").agg(F.count("post_id").alias("n"), F.count_distinct("token").alias("tokens"))


_RISK = """, lt AS (SELECT token_id, CASE WHEN liquidity > 0 THEN liquidity END AS l, CASE WHEN mcap > 0 THEN mcap END AS c FROM market QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY ts DESC, point_id DESC) = 1), r AS (SELECT *, l / c AS r FROM lt)
SELECT token_id, round(r, 8) AS ratio, round(r / 2, 8) AS float_fraction, round(2 / r - 1, 6) AS overhang, round(200000 / l, 6) AS slippage_pct, round(0.207::DOUBLE * l, 6) AS dump_to_halve, round(0.01::DOUBLE * l, 6) AS size_for_2pct,
  CASE WHEN l IS NULL THEN 'unknown' WHEN l < 10000 THEN 'critical' WHEN l < 50000 THEN 'low' WHEN l < 250000 THEN 'medium' ELSE 'high' END AS liquidity_band,
  CASE WHEN r IS NULL THEN 'unknown' WHEN r < 0.02 THEN 'critical' WHEN r < 0.05 THEN 'fragile' WHEN r < 0.15 THEN 'moderate' ELSE 'healthy' END AS ratio_band, CASE WHEN r IS NULL THEN 'low' ELSE 'medium' END AS confidence, array_to_string(list_filter([CASE WHEN l IS NULL THEN 'no liquidity' END, CASE WHEN c IS NULL THEN 'no market cap' END, CASE WHEN r > 1 THEN 'liquidity above market cap' END], lambda x: x IS NOT NULL), '; ') AS caveats FROM r"""


@query(_RISK)
def cf_liquidity_risk(spark: SparkSession, d: str) -> DataFrame:
    return so.liquidity_risk(tm.nth_by(p.market(spark, d), ["token_id"], [F.desc("ts"), F.desc("point_id")]))


@query(_SPAM + "SELECT post_id, spam_score, spam_reason FROM spm")
def soc_spam(spark: SparkSession, d: str) -> DataFrame:
    return so.spam(p.posts(spark, d))


_INGEST = _M + ", told AS (SELECT * FROM posts WHERE post_id IN (SELECT post_id FROM mn))" + _spam_sql("told") + """,
ta AS (SELECT DISTINCT token_id, 'So1anaToken' || repeat(CAST(token_id + 1 AS VARCHAR), 24) AS address FROM trades),
sm AS (SELECT author % 4 AS source, post_id || '::' || CASE WHEN kind = 'ticker' THEN '$' ELSE '' END || token AS dedupe_key, post_id, kind, token, token_id, confidence, spam_score, spam_reason FROM mn JOIN spm USING (post_id) LEFT JOIN ta ON address = token)
"""


def ingested(spark: SparkSession, d: str) -> DataFrame:
    """All posts, each fetched twice, as mentions; an author's remainder stands for the source, a digit for a token's address."""
    posts = p.posts(spark, d).withColumn("source", F.col("author") % 4)
    tokens = p.trades(spark, d).select("token_id").distinct()
    tokens = tokens.select("token_id", F.concat(F.lit("So1anaToken"), F.repeat((F.col("token_id") + 1).cast("string"), 24)).alias("address"))
    return so.ingest(posts.unionByName(posts), tokens)


@query(_INGEST + "SELECT source, dedupe_key, kind, token_id, confidence, spam_score, spam_reason FROM sm")
def soc_ingest(spark: SparkSession, d: str) -> DataFrame:
    return ingested(spark, d).select("source", "dedupe_key", "kind", "token_id", "confidence", "spam_score", "spam_reason")


@query(_INGEST + "SELECT token_id IS NOT NULL AS linked, coalesce(spam_reason, 'none') AS reason, count(*) AS mentions, count(DISTINCT post_id) AS posts FROM sm GROUP BY 1, 2")
def agg_social_ingest(spark: SparkSession, d: str) -> DataFrame:
    """What an ingest pass stored: mentions and posts by link and reason."""
    m = ingested(spark, d).groupBy(F.col("token_id").isNotNull().alias("linked"), F.coalesce("spam_reason", F.lit("none")).alias("reason"))
    return m.agg(F.count("*").alias("mentions"), F.count_distinct("post_id").alias("posts"))
