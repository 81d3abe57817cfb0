"""Queries over transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.operators import flows as fl
from tideflow.operators import graph_search as gs
from tideflow.operators import pnl
from tideflow.operators import temporal as tm
from tideflow.plans.pnl import _FIFO as FIFO
from tideflow.plans.registry import query
from tideflow.sources import projection as p

_REL = "CASE WHEN action = 'bridge_deposit' THEN 'BRIDGE_OUT' WHEN action = 'bridge_withdrawal' THEN 'BRIDGE_IN' WHEN asset IN ('SOL', 'BNB') THEN 'NATIVE' WHEN asset IN ('USDC', 'USDT') THEN 'STABLE' ELSE 'TOKEN' END"
_AGG = f""",
ae AS (SELECT src, dst, {_REL} AS relationship, asset, sum(usd) AS usd, count(*) AS txs, min(ts) AS first_ts, max(ts) AS last_ts FROM edges GROUP BY ALL)
"""
_BRIDGE = """,
dp AS (SELECT *, coalesce(protocol, '') AS pr FROM edges WHERE action = 'bridge_deposit'), wd AS (SELECT *, coalesce(protocol, '') AS pr FROM edges WHERE action = 'bridge_withdrawal'),
bc AS (SELECT dp.edge_id AS dep_id, wd.edge_id AS wd_id, dp.asset, dp.pr, CAST(least(dp.usd, wd.usd) AS DOUBLE) / CAST(greatest(dp.usd, wd.usd) AS DOUBLE) AS ratio FROM dp JOIN wd ON dp.asset = wd.asset AND dp.pr = wd.pr AND abs(epoch_us(dp.ts) - epoch_us(wd.ts)) <= 21600000000
  WHERE greatest(dp.usd, wd.usd) > 0 AND CAST(least(dp.usd, wd.usd) AS DOUBLE) / CAST(greatest(dp.usd, wd.usd) AS DOUBLE) >= 0.8::DOUBLE)
"""


@query("SELECT edge_id, " + _REL + " AS relationship FROM edges")
def prj_relationship(spark: SparkSession, d: str) -> DataFrame:
    return p.edges(spark, d).select("edge_id", fl.relationship(F.col("action"), F.col("asset")).alias("relationship"))


@query(_AGG + "SELECT src, dst, relationship, asset, CAST(usd AS DOUBLE) AS usd, txs, first_ts, last_ts FROM ae QUALIFY row_number() OVER (PARTITION BY src ORDER BY usd DESC, dst, relationship, asset) <= 20")
def agg_edges(spark: SparkSession, d: str) -> DataFrame:
    return fl.aggregate_edges(p.edges(spark, d), 20).select("src", "dst", "relationship", "asset", F.col("usd").cast("double").alias("usd"), "txs", "first_ts", "last_ts")


@query("SELECT count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS recent FROM edges")
def agg_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return p.edges(spark, d).agg(F.count("*").alias("total"), F.count_if(F.expr("ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00'")).alias("recent"))


@query("SELECT src, count(DISTINCT dst) AS out_degree, CAST(sum(usd) AS DOUBLE) AS sent FROM edges GROUP BY src ORDER BY out_degree DESC, sent DESC, src LIMIT 1")
def agg_top_funder(spark: SparkSession, d: str) -> DataFrame:
    return p.edges(spark, d).groupBy("src").agg(F.count_distinct("dst").alias("out_degree"), F.sum("usd").cast("double").alias("sent")).orderBy(F.desc("out_degree"), F.desc("sent"), "src").limit(1)


def _bridge(spark: SparkSession, d: str) -> DataFrame:
    return fl.bridge_candidates(p.edges(spark, d), 360, 0.8)


@query(_BRIDGE + "SELECT dep_id, wd_id, ratio FROM bc")
def jn_bridge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _bridge(spark, d).select("dep_id", "wd_id", "ratio")


@query(_BRIDGE + "SELECT dep_id, wd_id, ratio FROM (SELECT *, row_number() OVER (PARTITION BY dep_id ORDER BY ratio DESC, wd_id) AS x, row_number() OVER (PARTITION BY wd_id ORDER BY ratio DESC, dep_id) AS y FROM bc) WHERE x = 1 AND y = 1")
def bridge_mutual_best(spark: SparkSession, d: str) -> DataFrame:
    return fl.mutual_best(_bridge(spark, d)).select("dep_id", "wd_id", "ratio")


# The oracle walks the pairs one by one.
_GREEDY = _BRIDGE + """, pq AS (SELECT *, row_number() OVER (ORDER BY ratio DESC, dep_id, wd_id) AS rn FROM bc),
gm AS (SELECT unnest(ds) AS dep_id, unnest(ws) AS wd_id FROM (WITH RECURSIVE g AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS ds, CAST([] AS BIGINT[]) AS ws
  UNION ALL SELECT pq.rn, CASE WHEN list_contains(ds, dep_id) OR list_contains(ws, wd_id) THEN ds ELSE list_append(ds, dep_id) END, CASE WHEN list_contains(ds, dep_id) OR list_contains(ws, wd_id) THEN ws ELSE list_append(ws, wd_id) END FROM g JOIN pq ON pq.rn = g.rn + 1) SELECT ds, ws FROM g ORDER BY rn DESC LIMIT 1))
"""


@query(_GREEDY + "SELECT dep_id, wd_id, ratio FROM gm JOIN bc USING (dep_id, wd_id)")
def jn_bridge_greedy(spark: SparkSession, d: str) -> DataFrame:
    return fl.greedy_match(_bridge(spark, d))


@query(_GREEDY + ", sv AS (SELECT DISTINCT address FROM registry WHERE category IN ('CEX', 'MIXER')), mt AS (SELECT dep_id AS edge_id FROM gm UNION SELECT wd_id FROM gm) SELECT edge_id, CASE WHEN edge_id IN (FROM mt) THEN 95 ELSE 35 END AS confidence, CASE WHEN edge_id IN (FROM mt) THEN 'matched' WHEN src IN (FROM sv) OR dst IN (FROM sv) THEN 'exchange or mixer' ELSE 'no match' END AS reason FROM edges WHERE action LIKE 'bridge%'")
def bridge_pass(spark: SparkSession, d: str) -> DataFrame:
    """Each bridge leg with its confidence and reason."""
    legs = p.edges(spark, d).where("action in ('bridge_deposit', 'bridge_withdrawal')").select("edge_id", "src", "dst")
    got = fl.greedy_match(_bridge(spark, d)).select(F.explode(F.array("dep_id", "wd_id")).alias("edge_id")).withColumn("hit", F.lit(True))
    service = p.registry(spark, d).where("category in ('CEX', 'MIXER')").select("address").distinct().withColumn("service", F.lit(True))
    legs = legs.join(got, "edge_id", "left")
    for end in ("src", "dst"):
        legs = legs.join(service.withColumnsRenamed({"address": end, "service": f"{end}_service"}), end, "left")
    why = F.when(F.col("hit"), "matched").when(F.col("src_service") | F.col("dst_service"), "exchange or mixer").when(F.coalesce("src_service", "dst_service"), "exchange or mixer").otherwise("no match")
    return legs.select("edge_id", F.when(F.col("hit"), 95).otherwise(35).alias("confidence"), why.alias("reason"))


@query(_BRIDGE + "SELECT DISTINCT least(a.src, b.dst) AS a, greatest(a.src, b.dst) AS b FROM bc JOIN edges a ON a.edge_id = dep_id JOIN edges b ON b.edge_id = wd_id WHERE a.src <> b.dst AND ratio >= 0.9")
def jn_bridge_pair_evidence(spark: SparkSession, d: str) -> DataFrame:
    b = _bridge(spark, d).where("ratio >= 0.9 and dep_src <> wd_dst")
    return b.select(F.least("dep_src", "wd_dst").alias("a"), F.greatest("dep_src", "wd_dst").alias("b")).distinct()


_ROT = FIFO + """,
xp AS (SELECT trade_id, CAST(sum(CAST(round(realized, 7) AS DECIMAL(28,7))) OVER (PARTITION BY wallet_id, token_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS DOUBLE) AS profit FROM sells),
mv AS (SELECT x.trade_id AS exit_id, e.edge_id, e.dst, e.ts AS move_ts FROM trades x JOIN xp ON xp.trade_id = x.trade_id AND xp.profit >= 5 JOIN edges e ON e.src = x.wallet_id AND e.action = 'transfer' AND e.ts BETWEEN x.ts AND x.ts + INTERVAL 24 HOUR
  WHERE x.action = 'SELL' AND x.usd > 0 AND CAST(e.usd AS DOUBLE) / CAST(x.usd AS DOUBLE) * 100 BETWEEN 80 AND 105),
rt AS (SELECT exit_id, edge_id, b.trade_id AS buy_id FROM mv JOIN trades b ON b.wallet_id = mv.dst AND b.action = 'BUY' AND b.mcap IS NOT NULL AND b.mcap <= 5000000 AND b.ts BETWEEN move_ts AND move_ts + INTERVAL 360 MINUTE
  QUALIFY row_number() OVER (PARTITION BY exit_id, edge_id ORDER BY b.ts, b.trade_id) = 1)
"""


@query(_ROT + "SELECT exit_id, edge_id, buy_id FROM rt")
def rotation_match(spark: SparkSession, d: str) -> DataFrame:
    return rotation_rows(spark, d).select("exit_id", "edge_id", "buy_id")


def rotation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Exits of enough realized profit whose proceeds move on and buy another token."""
    t = p.trades(spark, d)
    profit = pnl.profit_at_exit(pnl.fifo_sells(t)).select("trade_id", "profit")
    exits = t.where("action = 'SELL'").join(profit, "trade_id")
    return fl.rotations(exits, p.edges(spark, d).where("action = 'transfer'"), t.where("action = 'BUY'"), min_profit=5.0, buy_minutes=360)


@query("SELECT r.edge_id, s.edge_id AS receipt_id FROM edges r JOIN edges s ON s.src = r.src AND s.dst = r.dst AND s.edge_id <> r.edge_id AND s.ts BETWEEN r.ts AND r.ts + INTERVAL 10 DAY AND CAST(s.usd AS DOUBLE) BETWEEN 0.8 * CAST(r.usd AS DOUBLE) AND 1.05 * CAST(r.usd AS DOUBLE) QUALIFY row_number() OVER (PARTITION BY r.edge_id ORDER BY s.ts, s.edge_id) = 1")
def jn_earliest_receipt(spark: SparkSession, d: str) -> DataFrame:
    e = p.edges(spark, d)
    a = e.select("src", "dst", "edge_id", "ts", F.col("usd").cast("double").alias("u"))
    b = e.select("src", "dst", F.col("edge_id").alias("receipt_id"), F.col("ts").alias("receipt_ts"), F.col("usd").cast("double").alias("v"))
    pairs = tm.within(a, b, ["src", "dst"], "ts", "receipt_ts", 864000).where("edge_id <> receipt_id").where(F.col("v").between(0.8 * F.col("u"), 1.05 * F.col("u")))
    return tm.nth_by(pairs, ["edge_id"], ["receipt_ts", "receipt_id"]).select("edge_id", "receipt_id")


@query("SELECT e.edge_id, arg_min(b.trade_id, (b.ts, b.trade_id)) AS buy_id FROM edges e JOIN trades b ON b.wallet_id = e.dst AND b.action = 'BUY' AND b.mcap IS NOT NULL AND b.ts BETWEEN e.ts AND e.ts + INTERVAL 60 MINUTE GROUP BY 1")
def jn_earliest_dest_buy(spark: SparkSession, d: str) -> DataFrame:
    e = p.edges(spark, d).select(F.col("dst").alias("wallet_id"), "edge_id", F.col("ts").alias("move_ts"))
    b = p.trades(spark, d).where("action = 'BUY' and mcap is not null").select("wallet_id", "trade_id", F.col("ts").alias("buy_ts"))
    return tm.within(e, b, ["wallet_id"], "move_ts", "buy_ts", 3600).groupBy("edge_id").agg(F.min(F.struct("buy_ts", "trade_id")).alias("m")).select("edge_id", F.col("m.trade_id").alias("buy_id"))


@query("SELECT e.edge_id, e.src, e.dst, f.first_ts IS NULL OR f.first_ts > e.ts AS fresh FROM edges e JOIN wallets s ON s.wallet_id = e.src AND (s.is_watched OR s.meets_profitable) JOIN wallets k ON k.wallet_id = e.dst LEFT JOIN (SELECT wallet_id, min(ts) AS first_ts FROM trades GROUP BY 1) f ON f.wallet_id = e.dst WHERE e.action = 'transfer' AND e.src <> e.dst")
def funding_events(spark: SparkSession, d: str) -> DataFrame:
    return fl.funding_events(p.edges(spark, d), p.trades(spark, d), p.wallets(spark, d)).select("edge_id", "src", "dst", "fresh")


@query("""SELECT b.token_id, bool_or(epoch_us(b.ts) - epoch_us(e.ts) <= 7200000000) AS fired, true AS within_a_day FROM edges e JOIN wallets s ON s.wallet_id = e.src AND (s.is_watched OR s.meets_profitable) JOIN (SELECT wallet_id, min(ts) AS first_ts FROM trades GROUP BY 1) f ON f.wallet_id = e.dst
  JOIN (SELECT wallet_id, token_id, usd, ts, mcap FROM trades WHERE action = 'BUY' QUALIFY row_number() OVER (PARTITION BY wallet_id, token_id ORDER BY ts, trade_id) = 1) b ON b.wallet_id = e.dst
  WHERE e.action = 'transfer' AND e.src <> e.dst AND f.first_ts > e.ts AND epoch_us(b.ts) - epoch_us(e.ts) BETWEEN 300000000 AND 86400000000 AND b.mcap <= 5000000 AND CAST(b.usd AS DOUBLE) / CAST(e.usd AS DOUBLE) * 100 BETWEEN 30 AND 110 AND e.usd > 0 GROUP BY 1""")  # fmt: skip
def rule_e(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that a freshly funded wallet buys first for 30 to 110 percent of it: 5 to 120 minutes after, and up to a day after."""
    return funded_rows(spark, d).groupBy("token_id").agg(F.bool_or(F.col("gap") <= 7_200_000_000).alias("fired"), F.lit(True).alias("within_a_day"))


def funded_rows(spark: SparkSession, d: str) -> DataFrame:
    """edge_id, token_id, buy_ts, gap (microseconds): first buys of a token, up to a day after the fresh funding that they fit."""
    t = p.trades(spark, d)
    buys = t.where("action = 'BUY'").groupBy("wallet_id", "token_id").agg(F.min(F.struct("ts", "trade_id", "usd", "mcap")).alias("m"))
    buys = buys.select(F.col("wallet_id").alias("dst"), "token_id", F.col("m.ts").alias("buy_ts"), F.col("m.usd").alias("buy_usd"), "m.mcap")
    f = fl.funding_events(p.edges(spark, d), t, p.wallets(spark, d)).where("fresh and usd > 0").withColumnRenamed("ts", "fund_ts")
    gap = F.unix_micros(F.col("buy_ts").cast("timestamp")) - F.unix_micros(F.col("fund_ts").cast("timestamp"))
    out = tm.within(f, buys, ["dst"], "fund_ts", "buy_ts", 86400).where((gap >= 300_000_000) & (F.col("mcap") <= 5000000) & (F.col("buy_usd").cast("double") / F.col("usd").cast("double") * 100).between(30, 110))
    return out.select("edge_id", "token_id", "buy_ts", gap.alias("gap"))


@query(_ROT + "SELECT DISTINCT b.token_id, true AS fired FROM rt JOIN trades b ON b.trade_id = rt.buy_id")
def rule_f(spark: SparkSession, d: str) -> DataFrame:
    return rotation_rows(spark, d).select(F.col("to_token").alias("token_id"), F.lit(True).alias("fired")).distinct()


_KINDS = fl.EVIDENCE
_LINKS = """,
dr AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n, CAST(min(usd) AS DOUBLE) AS lo, CAST(max(usd) AS DOUBLE) AS most FROM edges WHERE action = 'transfer' AND src <> dst GROUP BY ALL),
bl AS (SELECT least(x.src, y.dst) AS a, greatest(x.src, y.dst) AS b, x.ts AS dt, x.edge_id AS d_id, y.ts AS wt, y.edge_id AS w_id, CAST(least(x.usd, y.usd) AS DOUBLE) / CAST(greatest(x.usd, y.usd) AS DOUBLE) AS ratio FROM edges x JOIN edges y ON x.action = 'bridge_deposit' AND y.action = 'bridge_withdrawal' AND x.src <> y.dst AND x.usd > 0 AND y.usd > 0
  AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 7200000000 AND CAST(least(x.usd, y.usd) AS DOUBLE) / CAST(greatest(x.usd, y.usd) AS DOUBLE) >= 0.9::DOUBLE),
bp AS (SELECT a, b, arg_min(ratio, (dt, d_id, wt, w_id)) AS ratio FROM bl GROUP BY 1, 2),
pp AS (SELECT a, b, coalesce(n, 0) AS n, lo, most, ratio FROM dr FULL JOIN bp USING (a, b)),
ow AS (SELECT w, f, began IS NULL OR began > t AS fresh, coalesce(began >= t AND began <= t + INTERVAL 60 MINUTE, false) AS soon FROM (SELECT dst AS w, arg_min(src, (ts, edge_id)) AS f, min(ts) AS t FROM edges GROUP BY 1) LEFT JOIN (SELECT wallet_id AS w, min(ts) AS began FROM trades GROUP BY 1) USING (w)),
tc AS (SELECT DISTINCT address, category = 'ROUTER' AS router, w FROM (SELECT dst AS address, src AS w FROM edges UNION SELECT src, dst FROM edges) JOIN registry USING (address) WHERE category IN ('CEX', 'MIXER', 'ROUTER')),
mt AS (SELECT pp.a, pp.b, bool_or(NOT x.router) AS service, bool_or(x.router) AS router FROM pp JOIN tc x ON x.w = pp.a JOIN tc y ON y.w = pp.b AND y.address = x.address GROUP BY 1, 2),
al AS (SELECT pp.*, CASE WHEN n >= 2 THEN CASE WHEN most > 0 THEN lo / most END ELSE ratio END AS alike, coalesce(x.f = y.f, false) AS same_funding, coalesce(x.soon, false) OR coalesce(y.soon, false) AS soon, coalesce(x.fresh, false) OR coalesce(y.fresh, false) AS fresh, coalesce(service, false) AS service, coalesce(router, false) AS router
  FROM pp LEFT JOIN mt USING (a, b) LEFT JOIN ow x ON x.w = pp.a LEFT JOIN ow y ON y.w = pp.b),
le AS (SELECT a, b, n >= 1 AS direct_transfer, n >= 2 AS repeated_transfers, same_funding, ratio IS NOT NULL AS bridge_match, coalesce(alike >= 0.9::DOUBLE, false) AS amount_similar, soon AS dest_buys_60m, fresh AS fresh_wallet, service AS cex_or_mixer, router AND n = 0 AS router_only, coalesce(alike < 0.9::DOUBLE, false) AS weak_amount, coalesce(most < 10, false) AS dust_only FROM al),
lc AS (SELECT a, b, CAST(least(greatest(35 * direct_transfer::INT + 20 * repeated_transfers::INT + 25 * same_funding::INT + 30 * bridge_match::INT + 15 * amount_similar::INT + 15 * dest_buys_60m::INT + 15 * fresh_wallet::INT - 30 * cex_or_mixer::INT - 20 * router_only::INT - 15 * weak_amount::INT - 25 * dust_only::INT, 0), 100) AS INTEGER) AS confidence FROM le)
"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    e = fl.link_evidence(p.edges(spark, d), p.registry(spark, d), p.trades(spark, d))
    return e.withColumn("confidence", fl.link_confidence({k: F.col(k) for k in _KINDS}))


@query(_LINKS + "SELECT * FROM le")
def link_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("a", "b", *_KINDS)


@query(_LINKS + "SELECT a, b, confidence, CASE WHEN confidence <= 30 THEN 'weak' WHEN confidence <= 60 THEN 'possible' WHEN confidence <= 80 THEN 'probable' ELSE 'strong' END AS band FROM lc")
def link_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("a", "b", "confidence", fl.band(F.col("confidence")).alias("band"))


_CC = "cc AS (SELECT member, min(cluster) AS cluster FROM (WITH RECURSIVE g AS (SELECT a AS x, b AS y FROM lk UNION SELECT b, a FROM lk), r AS (SELECT x AS member, x AS cluster FROM g UNION SELECT r.member, g.y FROM r JOIN g ON g.x = r.cluster) SELECT * FROM r) GROUP BY 1)"
_CLUSTERS = _LINKS + ", lk AS (SELECT a, b FROM lc WHERE confidence >= 61), " + _CC


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return fl.components(_links(spark, d).where("confidence >= 61").select("a", "b"))


@query(_CLUSTERS + "SELECT member, cluster FROM cc")
def cluster_cc(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d)


@query(_CLUSTERS + """, ml AS (SELECT a AS member, b AS other, confidence FROM lc UNION ALL SELECT b, a, confidence FROM lc), mx AS (SELECT m.member, x.cluster, max(confidence) AS best FROM ml m JOIN cc x ON x.member = m.member JOIN cc y ON y.member = m.other AND y.cluster = x.cluster GROUP BY ALL),
  cf AS (SELECT cluster, round(avg(best), 6) AS confidence FROM mx GROUP BY 1), fu AS (SELECT cluster, f, count(*) AS n FROM cc JOIN ow ON w = member GROUP BY ALL), fm AS (SELECT cluster, f AS funder FROM fu QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f) = 1),
  tv AS (SELECT cluster, count(DISTINCT member) AS wallets, count(DISTINCT token_id) AS tokens, CAST(coalesce(sum(usd), 0) AS DOUBLE) AS volume, CAST(coalesce(sum(CASE WHEN action = 'SELL' THEN usd ELSE -usd END), 0) AS DOUBLE) AS net FROM cc LEFT JOIN trades ON wallet_id = member GROUP BY 1)
  SELECT * FROM tv LEFT JOIN cf USING (cluster) LEFT JOIN fm USING (cluster)""")
def agg_cluster_profile(spark: SparkSession, d: str) -> DataFrame:
    """Size, tokens, volume and net result of each cluster, the mean of its members' best confidence, and its commonest funder."""
    links = fl.saved(_links(spark, d).select("a", "b", "confidence"))
    c = fl.components(links.where("confidence >= 61").select("a", "b"))
    t = c.join(p.trades(spark, d), F.col("member") == F.col("wallet_id"), "left")
    net = F.sum(F.when(F.col("action") == "SELL", F.col("usd")).otherwise(-F.col("usd")))
    size = t.groupBy("cluster").agg(F.count_distinct("member").alias("wallets"), F.count_distinct("token_id").alias("tokens"), F.coalesce(F.sum("usd"), F.lit(0)).cast("double").alias("volume"), F.coalesce(net, F.lit(0)).cast("double").alias("net"))
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("member"), F.col("b").alias("other")), F.struct(F.col("b").alias("member"), F.col("a").alias("other")))).alias("x"), "confidence").select("x.*", "confidence")
    own = both.join(c, "member").join(c.select(F.col("member").alias("other"), "cluster"), ["other", "cluster"]).groupBy("member", "cluster").agg(F.max("confidence").alias("best"))
    mean = own.groupBy("cluster").agg(F.round(F.avg("best"), 6).alias("confidence"))
    first = p.edges(spark, d).groupBy(F.col("dst").alias("member")).agg(F.min(F.struct("ts", "edge_id", "src"))["src"].alias("funder"))
    modal = c.join(first, "member").groupBy("cluster", "funder").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", (-F.col("funder")).alias("f"), "funder"))["funder"].alias("funder"))
    return size.join(mean, "cluster", "left").join(modal, "cluster", "left")


@query(_CLUSTERS + "SELECT cluster, count(DISTINCT token_id) AS tokens, count(*) FILTER (action = 'BUY' AND ts >= TIMESTAMP '2024-01-29') AS buys_24h, count(*) FILTER (action = 'SELL' AND ts >= TIMESTAMP '2024-01-29') AS exits_24h FROM cc JOIN trades ON wallet_id = member GROUP BY 1")
def agg_cluster_activity(spark: SparkSession, d: str) -> DataFrame:
    c = _clusters(spark, d).join(p.trades(spark, d), F.col("member") == F.col("wallet_id"))
    late = F.expr("ts >= TIMESTAMP_NTZ '2024-01-29 00:00:00'")
    return c.groupBy("cluster").agg(F.count_distinct("token_id").alias("tokens"), F.count_if(late & (F.col("action") == "BUY")).alias("buys_24h"), F.count_if(late & (F.col("action") == "SELL")).alias("exits_24h"))


@query(", fu AS (SELECT dst AS w, src AS f FROM edges WHERE action = 'transfer' AND src <> dst QUALIFY row_number() OVER (PARTITION BY dst ORDER BY ts, edge_id) = 1), fn AS (SELECT f, count(*) AS n FROM fu GROUP BY 1) SELECT least(x.w, y.w) AS a, greatest(x.w, y.w) AS b, NULL AS funder FROM fu x JOIN fu y ON x.f = y.f AND x.w < y.w JOIN fn ON fn.f = x.f WHERE n <= 50 UNION ALL SELECT w, NULL, f FROM fu JOIN fn USING (f) WHERE n > 50")
def jn_self_cofunded(spark: SparkSession, d: str, most: int = 50) -> DataFrame:
    """Pairs of wallets with one earliest funder; a funder of more wallets keeps them as members (b null) instead of pairs."""
    funded = tm.nth_by(p.edges(spark, d).where("action = 'transfer' and src <> dst"), ["dst"], ["ts", "edge_id"]).select("src", "dst")
    funded = funded.join(funded.groupBy("src").agg(F.count("*").alias("n")), "src")
    few = funded.where(F.col("n") <= most)
    pairs = few.select("src", F.col("dst").alias("a")).join(few.select("src", F.col("dst").alias("b")), "src").where("a < b").select("a", "b", F.lit(None).cast("long").alias("funder"))
    return pairs.unionByName(funded.where(F.col("n") > most).select(F.col("dst").alias("a"), F.lit(None).cast("long").alias("b"), F.col("src").alias("funder")))


_PATHS = _AGG + """, e AS (SELECT src AS s, dst AS d, first_ts AS t, CAST(usd AS DOUBLE) AS v FROM ae WHERE usd >= 100),
pp AS (SELECT path, hops, least, retention FROM (WITH RECURSIVE r AS (SELECT [s, d] AS nodes, t, v AS least, v AS first, v AS last FROM e WHERE s = 3 AND s <> d
  UNION ALL SELECT list_append(nodes, d), e.t, least(r.least, v), first, v FROM r JOIN e ON e.s = nodes[-1] AND e.t >= r.t WHERE NOT list_contains(nodes, d) AND len(nodes) < 5)
  SELECT DISTINCT array_to_string(nodes, '>') AS path, len(nodes) - 1 AS hops, least, round(least(greatest(last / first * 100, 0.0), 999.0), 4) AS retention FROM r) ORDER BY least DESC, path, retention LIMIT 20)
"""


@query(_PATHS + "SELECT path, CAST(hops AS INTEGER) AS hops, least, retention FROM pp")
def graph_paths(spark: SparkSession, d: str) -> DataFrame:
    return fl.paths(fl.aggregate_edges(p.edges(spark, d)).where("usd >= 100"), 3)


@query(", nd AS (SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM (WITH RECURSIVE r AS (SELECT CAST(3 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM r JOIN (SELECT DISTINCT src, dst FROM edges WHERE usd >= 100) e ON e.src = r.node WHERE depth < 3 AND (r.node NOT IN (SELECT address FROM registry) OR depth = 0)) SELECT * FROM r) GROUP BY 1), cn AS (SELECT e.dst AS node, max(greatest(10, CASE WHEN action LIKE 'bridge%' THEN 60 ELSE 80 END - 10 * depth)) AS best FROM edges e JOIN nd ON nd.node = e.src WHERE usd >= 100 AND depth < 3 AND (e.src NOT IN (SELECT address FROM registry) OR e.src = 3) GROUP BY 1) SELECT node, depth, CAST(CASE WHEN node = 3 THEN 100 ELSE coalesce(best, 10) END AS INTEGER) AS confidence FROM nd LEFT JOIN cn USING (node)")
def graph_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within three hops, services reached but not expanded, and the confidence that their edges give them."""
    stop = p.registry(spark, d).where("address <> 3").select("address").distinct()
    e = p.edges(spark, d).where("usd >= 100")
    nodes = fl.frontier(e, 3, 3, 100.0, stop).join(stop.select(F.col("address").alias("node"), F.lit(False).alias("open")), "node", "left")
    nodes = fl.saved(nodes.select("node", "depth", F.coalesce("open", F.lit(True)).alias("expanded")))
    return fl.hop_confidence(nodes, e.withColumn("relationship", fl.relationship(F.col("action"), F.col("asset"))), 3, 3)


@query()
def graph_bfs_budget(spark: SparkSession, d: str) -> DataFrame:
    return fl.frontier(p.edges(spark, d), 3, 3, 100.0, p.registry(spark, d), max_nodes=40)


def _best_first(spark: SparkSession, d: str) -> gs.Found:
    return gs.best_first(fl.aggregate_edges(p.edges(spark, d), 10**9), 3, 3, 100, 40, 60, mode="CAPITAL_FLOW", closed=p.registry(spark, d))


@query()
def graph_best_first(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a search that takes the most valuable edge of all branches first, within 40 nodes and 60 edges."""
    f = _best_first(spark, d)
    return f.nodes.select("node", "depth", "confidence", F.col("sent_usd").cast("double").alias("sent_usd"), F.col("received_usd").cast("double").alias("received_usd"), "txs", F.lit(f.truncated).alias("truncated"))


@query()
def graph_best_first_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the same search, assets merged."""
    return _best_first(spark, d).edges.withColumn("usd", F.col("usd").cast("double"))


@query(_AGG + "SELECT CAST(count(*) AS BIGINT) AS edges, count(*) FILTER (usd >= 100 AND last_ts >= TIMESTAMP '2024-01-10' AND first_ts <= TIMESTAMP '2024-01-20') AS passed FROM ae")
def flt_graph_gate1(spark: SparkSession, d: str) -> DataFrame:
    ok = F.expr("usd >= 100 and last_ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00' and first_ts <= TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    return fl.aggregate_edges(p.edges(spark, d), 10**9).agg(F.count("*").alias("edges"), F.count_if(ok).alias("passed"))


@query(_AGG + ", i AS (SELECT dst, sum(usd) AS inbound FROM ae GROUP BY 1) SELECT src, ae.dst, relationship, asset FROM ae JOIN i ON i.dst = ae.src WHERE ae.usd >= inbound * 0.5 OR txs >= 4")
def flt_graph_gate2(spark: SparkSession, d: str) -> DataFrame:
    e = fl.aggregate_edges(p.edges(spark, d), 10**9)
    inbound = e.groupBy(F.col("dst").alias("src")).agg(F.sum("usd").alias("inbound"))
    return e.join(inbound, "src").where("usd >= inbound * 0.5 or txs >= 4").select("src", "dst", "relationship", "asset")


@query("SELECT DISTINCT e.src FROM edges e JOIN registry r ON r.address = e.src WHERE category IN ('ROUTER', 'CEX', 'BRIDGE')")
def flt_do_not_expand(spark: SparkSession, d: str) -> DataFrame:
    return p.edges(spark, d).join(p.registry(spark, d).where("category in ('ROUTER', 'CEX', 'BRIDGE')").select(F.col("address").alias("src")), "src", "left_semi").select("src").distinct()


@query("SELECT e.edge_id, CASE WHEN action <> 'transfer' THEN action WHEN d.category = 'CEX' THEN 'cex_deposit' WHEN s.category = 'CEX' THEN 'cex_withdrawal' ELSE action END AS action FROM edges e LEFT JOIN registry d ON d.address = e.dst LEFT JOIN registry s ON s.address = e.src")
def src_cex_retag(spark: SparkSession, d: str) -> DataFrame:
    r = p.registry(spark, d).select("address", "category")
    e = p.edges(spark, d).join(r.select(F.col("address").alias("dst"), F.col("category").alias("to")), "dst", "left").join(r.select(F.col("address").alias("src"), F.col("category").alias("of")), "src", "left")
    return e.select("edge_id", F.when(F.col("action") != "transfer", F.col("action")).when(F.col("to") == "CEX", "cex_deposit").when(F.col("of") == "CEX", "cex_withdrawal").otherwise(F.col("action")).alias("action"))


@query("SELECT min(edge_id) AS edge_id, src, dst, CASE WHEN action LIKE 'bridge%' THEN 'bridge' ELSE 'transfer' END AS family, edge_id // 6 AS tx FROM edges GROUP BY src, dst, family, tx")
def src_edge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e = p.edges(spark, d).select("edge_id", "src", "dst", F.when(F.col("action").like("bridge%"), "bridge").otherwise("transfer").alias("family"), F.expr("edge_id div 6").alias("tx"))
    return tm.nth_by(e, ["src", "dst", "family", "tx"], ["edge_id"])


@query("SELECT e.edge_id, CASE r.category WHEN 'CEX' THEN 'exchange' WHEN 'ROUTER' THEN 'router' WHEN 'BRIDGE' THEN 'bridge' WHEN 'MIXER' THEN 'mixer' ELSE 'wallet' END AS node_type FROM edges e LEFT JOIN registry r ON r.address = e.dst")
def prj_node_type(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("category")
    e = p.edges(spark, d).join(p.registry(spark, d), F.col("address") == F.col("dst"), "left")
    return e.select("edge_id", F.when(c == "CEX", "exchange").when(c == "ROUTER", "router").when(c == "BRIDGE", "bridge").when(c == "MIXER", "mixer").otherwise("wallet").alias("node_type"))


@query("SELECT wallet_id, CAST(coalesce(i, 0) - coalesce(o, 0) AS DOUBLE) AS net_flow FROM (SELECT dst AS wallet_id, sum(usd) AS i FROM edges GROUP BY 1) FULL JOIN (SELECT src AS wallet_id, sum(usd) AS o FROM edges GROUP BY 1) USING (wallet_id) ORDER BY net_flow DESC, wallet_id LIMIT 500")
def srt_connected_wallets(spark: SparkSession, d: str) -> DataFrame:
    e = p.edges(spark, d)
    flow = e.select(F.explode(F.array(F.struct(F.col("dst").alias("w"), F.col("usd").alias("u")), F.struct(F.col("src").alias("w"), (-F.col("usd")).alias("u")))).alias("x")).groupBy(F.col("x.w").alias("wallet_id")).agg(F.sum("x.u").cast("double").alias("net_flow"))
    return flow.orderBy(F.desc("net_flow"), "wallet_id").limit(500)


@query(_ROT + """, n AS (SELECT rt.exit_id, rt.edge_id, 'Token ' || x.token_id AS n1, 'Wallet ' || x.wallet_id AS n2, 'Transfer' AS n3, 'Wallet ' || e.dst AS n4, 'Token ' || b.token_id AS n5, CAST(x.usd AS DOUBLE) AS sold, CAST(e.usd AS DOUBLE) AS moved, CAST(b.usd AS DOUBLE) AS bought FROM rt JOIN trades x ON x.trade_id = rt.exit_id JOIN edges e USING (edge_id) JOIN trades b ON b.trade_id = rt.buy_id)
SELECT exit_id, edge_id, u.k AS link, CASE u.k WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 ELSE n4 END AS source, CASE u.k WHEN 1 THEN n2 WHEN 2 THEN n3 WHEN 3 THEN n4 ELSE n5 END AS target, CASE u.k WHEN 1 THEN sold WHEN 4 THEN bought ELSE moved END AS value FROM n, (VALUES (1), (2), (3), (4)) u(k)""")  # fmt: skip
def sankey(spark: SparkSession, d: str) -> DataFrame:
    """Five nodes and four links a rotation: token, wallet, transfer, wallet, token, weighed by the value at each hop."""
    t = p.trades(spark, d)
    r = rotation_rows(spark, d).select("exit_id", "edge_id", "buy_id", "from_token", "wallet_id", "dst", "to_token", F.col("exit_usd").cast("double").alias("sold"), F.col("move_usd").cast("double").alias("moved"))
    r = r.join(t.select(F.col("trade_id").alias("buy_id"), F.col("usd").cast("double").alias("bought")), "buy_id")
    name = lambda kind, c: F.concat(F.lit(f"{kind} "), F.col(c).cast("string"))
    nodes = [name("Token", "from_token"), name("Wallet", "wallet_id"), F.lit("Transfer"), name("Wallet", "dst"), name("Token", "to_token")]
    links = [F.struct(F.lit(k + 1).alias("link"), nodes[k].alias("source"), nodes[k + 1].alias("target"), F.col(v).alias("value")) for k, v in enumerate(("sold", "moved", "moved", "bought"))]
    return r.select("exit_id", "edge_id", F.explode(F.array(*links)).alias("l")).select("exit_id", "edge_id", "l.*")
