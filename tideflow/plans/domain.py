"""Queries over candidates, risks, social and confluence snapshots, alerts, and the joins and lists around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideflow.operators import candidates as cd
from tideflow.operators import flows as fl
from tideflow.operators import outcomes as oc
from tideflow.operators import overlap as ov
from tideflow.operators import pnl
from tideflow.operators import social
from tideflow.operators import temporal as tm
from tideflow.operators import token_window as tw
from tideflow.operators import writes as wr
from tideflow.plans import flows as fq
from tideflow.plans import outcomes as oq
from tideflow.plans import overlap as vq
from tideflow.plans import pnl as pq
from tideflow.plans import social as sq
from tideflow.plans import windows as wq
from tideflow.plans.registry import query
from tideflow.sources import projection as p
from tideflow.sources.shared import small_or_shuffled

_ntz = lambda t: F.lit(t).cast("timestamp_ntz")


# ---- filters, joins, sets


@query("SELECT address, category FROM registry WHERE category IN ('CEX', 'ROUTER', 'POOL', 'BRIDGE', 'MIXER')")
def flt_exclude_service(spark: SparkSession, d: str) -> DataFrame:
    return p.registry(spark, d).where(F.col("category").isin(*cd.SERVICES)).select("address", "category")


@query("SELECT signal_id FROM signals WHERE severity IN ('HIGH', 'CRITICAL') AND rule = 'A' AND NOT synthetic")
def flt_feed_ui(spark: SparkSession, d: str) -> DataFrame:
    return p.signals(spark, d).where(F.col("severity").isin("HIGH", "CRITICAL") & (F.col("rule") == "A") & ~F.col("synthetic")).select("signal_id")


@query("SELECT wallet_id FROM trades QUALIFY row_number() OVER (PARTITION BY wallet_id ORDER BY ts DESC, trade_id DESC) = 1 AND trade_id % 5 <> 0")
def flt_excl_csv_stats(spark: SparkSession, d: str) -> DataFrame:
    """Wallets whose latest statistics don't come from a list (every fifth trade stands for a list's row)."""
    last = tm.latest(p.trades(spark, d).select("wallet_id", "ts", "trade_id"), ["wallet_id"], "ts", "trade_id")
    return last.where("trade_id % 5 <> 0").select("wallet_id")


@query("SELECT edge_id FROM edges JOIN wallets a ON a.wallet_id = src AND a.is_watched JOIN wallets b ON b.wallet_id = dst AND b.is_watched")
def jn_inner_known_wallets(spark: SparkSession, d: str) -> DataFrame:
    known = p.wallets(spark, d).where("is_watched").select("wallet_id")
    e = p.edges(spark, d).select("edge_id", "src", "dst")
    return e.join(known.withColumnRenamed("wallet_id", "src"), "src").join(known.withColumnRenamed("wallet_id", "dst"), "dst").select("edge_id")


_TOUCH = ", tc AS (SELECT DISTINCT address, category, w FROM (SELECT dst AS address, src AS w FROM edges UNION SELECT src, dst FROM edges) JOIN registry USING (address) WHERE category IN ('CEX', 'MIXER', 'ROUTER')), tn AS (SELECT address, count(*) AS n FROM tc GROUP BY 1)"


@query(_TOUCH + " SELECT DISTINCT a.w AS a, b.w AS b, a.category = 'ROUTER' AS router, NULL AS address FROM tc a JOIN tc b ON a.address = b.address AND a.w < b.w JOIN tn ON tn.address = a.address WHERE n <= 6 UNION ALL SELECT w, NULL, category = 'ROUTER', address FROM tc JOIN tn USING (address) WHERE n > 6")
def jn_self_intermediary(spark: SparkSession, d: str, most: int = 6) -> DataFrame:
    """Pairs of wallets at one exchange, mixer or router; a service with more wallets keeps them as members (b null) instead of pairs."""
    e = p.edges(spark, d)
    ends = e.select(F.explode(F.array(F.struct(F.col("dst").alias("address"), F.col("src").alias("w")), F.struct(F.col("src").alias("address"), F.col("dst").alias("w")))).alias("x")).select("x.*").distinct()
    t = ends.join(p.registry(spark, d).where("category in ('CEX', 'MIXER', 'ROUTER')").select("address", "category"), "address")
    t = t.join(t.groupBy("address").agg(F.count("*").alias("n")), "address")
    few = t.where(F.col("n") <= most)
    router = (F.col("category") == "ROUTER").alias("router")
    pairs = few.select("address", F.col("w").alias("a"), router).join(few.select("address", F.col("w").alias("b")), "address").where("a < b").select("a", "b", "router").distinct()
    return pairs.withColumn("address", F.lit(None).cast("long")).unionByName(t.where(F.col("n") > most).select(F.col("w").alias("a"), F.lit(None).cast("long").alias("b"), router, "address"))


@query(""", br AS (SELECT edge_id AS b_id, src AS b_src, dst AS b_dst, protocol, ts AS b_ts FROM edges WHERE action LIKE 'bridge%' AND protocol IS NOT NULL),
c AS (SELECT e.edge_id, b.protocol, CASE WHEN b_src = e.src THEN 0 ELSE 1 END AS pref, abs(epoch_us(b_ts) - epoch_us(e.ts)) AS gap, b_id FROM edges e JOIN br b ON (b_src = e.src OR b_dst = e.dst) AND abs(epoch_us(b_ts) - epoch_us(e.ts)) <= 86400000000 WHERE e.action = 'transfer')
SELECT edge_id, protocol FROM c QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY pref, gap, b_id) = 1""")
def jn_bridge_protocol_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The protocol of the bridge leg nearest in time: one of the transfer's source before one of its destination."""
    e = p.edges(spark, d)
    t, b = e.where("action = 'transfer'"), e.where("action like 'bridge%' and protocol is not null")
    found = None
    for pref, end in enumerate(("src", "dst")):
        left = t.select(F.col(end).alias("w"), "edge_id", F.col("ts").alias("t"))
        right = b.select(F.col(end).alias("w"), F.col("edge_id").alias("b_id"), "protocol", F.col("ts").alias("b_t"))
        both = tm.within(left, right, ["w"], "t", "b_t", 86400).unionByName(tm.within(right, left, ["w"], "b_t", "t", 86400))
        both = both.select("edge_id", F.lit(pref).alias("pref"), F.abs(F.unix_micros(F.col("b_t").cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp"))).alias("gap"), "b_id", "protocol")
        found = both if found is None else found.unionByName(both)
    return found.groupBy("edge_id").agg(F.min(F.struct("pref", "gap", "b_id", "protocol")).alias("m")).select("edge_id", "m.protocol")


@query(sq._INGEST + wq._BASE + """, lm AS (SELECT token_id, count(*) AS mentions, count(DISTINCT source) AS sources FROM sm WHERE token_id IS NOT NULL AND spam_score < 70 GROUP BY 1), sg AS (SELECT token_id, count(*) AS signals FROM signals GROUP BY 1)
SELECT token_id, coalesce(mentions, 0) AS mentions, coalesce(sources, 0) AS sources, coalesce(signals, 0) AS signals, flow_score FROM (SELECT token_id FROM lm UNION SELECT token_id FROM sg) LEFT JOIN lm USING (token_id) LEFT JOIN sg USING (token_id) LEFT JOIN scored USING (token_id)""")  # fmt: skip
def jn_social_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with linked mentions that aren't hidden as spam, or with signals, and their score."""
    m = sq.ingested(spark, d).where("token_id is not null and spam_score < 70").groupBy("token_id").agg(F.count("*").alias("mentions"), F.count_distinct("source").alias("sources"))
    s = p.signals(spark, d).groupBy("token_id").agg(F.count("*").alias("signals"))
    a = wq._agg(spark, d)
    none = [F.coalesce(c, F.lit(0)).alias(c) for c in ("mentions", "sources", "signals")]
    return m.join(s, "token_id", "full").join(a.select("token_id", tw.flow_score(a).alias("flow_score")), "token_id", "left").select("token_id", *none, "flow_score")


@query(vq._L + ", cs AS (SELECT trade_id, wallet_id, CASE WHEN trade_id % 3 = 0 THEN 'local' ELSE 'warehouse' END AS source, CASE trade_id % 4 WHEN 0 THEN 'promoted' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status FROM trades WHERE trade_id % 7 = 0) SELECT ol.wallet_id, status FROM ol LEFT JOIN (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY wallet_id ORDER BY source = 'warehouse' DESC, trade_id) = 1) c USING (wallet_id)")
def jn_candidate_status(spark: SparkSession, d: str) -> DataFrame:
    """Each overlap wallet's status as a candidate, one source before the other."""
    i = F.col("trade_id")
    c = p.trades(spark, d).where("trade_id % 7 = 0").select("wallet_id", (i % 3 == 0).alias("local"), i, F.when(i % 4 == 0, "promoted").when(i % 4 == 1, "rejected").otherwise("pending").alias("status"))
    best = c.groupBy("wallet_id").agg(F.min(F.struct("local", "trade_id", "status")).alias("m")).select("wallet_id", "m.status")
    return vq._local(spark, d).select("wallet_id").join(best, "wallet_id", "left")


@query(fq._CLUSTERS + "SELECT a, b, x.cluster FROM lc JOIN cc x ON x.member = a JOIN cc y ON y.member = b AND y.cluster = x.cluster")
def set_intersect_members(spark: SparkSession, d: str) -> DataFrame:
    """Evidence pairs with both ends in one cluster."""
    links = fl.saved(fq._links(spark, d).select("a", "b", "confidence"))
    c = small_or_shuffled(fl.components(links.where("confidence >= 61")))
    x, y = c.select(F.col("member").alias("a"), "cluster"), c.select(F.col("member").alias("b"), F.col("cluster").alias("of_b"))
    return links.select("a", "b").join(x, "a").join(y, "b").where("cluster = of_b").select("a", "b", "cluster")


# ---- aggregates and lists

_STATUS = "CASE trade_id % 4 WHEN 0 THEN 'promoted' WHEN 1 THEN 'rejected' ELSE 'pending' END"


@query(f"SELECT wallet_id % 5 AS source, count(*) FILTER ({_STATUS} = 'pending') AS pending, count(*) FILTER ({_STATUS} = 'promoted') AS promoted, count(*) FILTER ({_STATUS} = 'rejected') AS rejected, count(*) AS total FROM trades GROUP BY 1")
def agg_source_health(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("trade_id") % 4
    t = p.trades(spark, d).select((F.col("wallet_id") % 5).alias("source"), F.when(i == 0, "promoted").when(i == 1, "rejected").otherwise("pending").alias("status"))
    g = t.groupBy("source").pivot("status", ["pending", "promoted", "rejected"]).count().na.fill(0)
    return g.withColumn("total", F.col("pending") + F.col("promoted") + F.col("rejected"))


@query("SELECT token_id, round(max(h) / sum(h), 9) AS top1, round(sum(h) FILTER (n <= 5) / sum(h), 9) AS top5 FROM (SELECT token_id, h, row_number() OVER (PARTITION BY token_id ORDER BY h DESC, wallet_id) AS n FROM (SELECT token_id, wallet_id, CAST(sum(qty) AS DOUBLE) AS h FROM trades WHERE action = 'BUY' GROUP BY ALL)) GROUP BY 1")
def agg_holder_concentration(spark: SparkSession, d: str) -> DataFrame:
    """The largest holder's and the five largest's share of what was bought."""
    h = p.trades(spark, d).where("action = 'BUY'").groupBy("token_id", "wallet_id").agg(F.sum("qty").cast("double").alias("h"))
    ranked = h.withColumn("n", F.row_number().over(Window.partitionBy("token_id").orderBy(F.desc("h"), "wallet_id")))
    return ranked.groupBy("token_id").agg(F.round(F.max("h") / F.sum("h"), 9).alias("top1"), F.round(F.sum(F.when(F.col("n") <= 5, F.col("h"))) / F.sum("h"), 9).alias("top5"))


@query(", m AS (SELECT token_id, ts, point_id, mcap FROM market WHERE mcap IS NOT NULL), l AS (SELECT token_id, max(ts) AS last, arg_max(mcap, (ts, point_id)) AS now FROM m GROUP BY 1), b AS (SELECT token_id, arg_max(mcap, (ts, point_id)) AS before FROM m JOIN l USING (token_id) WHERE ts <= last - INTERVAL 24 HOUR GROUP BY 1) SELECT token_id, round(now / before, 6) AS expansion, now / before >= 2 AS expanded FROM l JOIN b USING (token_id) WHERE before > 0")
def agg_lookback_expansion(spark: SparkSession, d: str) -> DataFrame:
    """The latest value by the one a day before: two maxima by time, one pass."""
    m = p.market(spark, d).where("mcap is not null")
    last = m.groupBy("token_id").agg(F.max("ts").alias("last"))  # one row a token
    point = F.struct("ts", "point_id", "mcap")
    g = m.join(last, "token_id").groupBy("token_id").agg(F.max(point)["mcap"].alias("now"), F.max(F.when(F.col("ts") <= F.col("last") - F.expr("INTERVAL 24 HOURS"), point))["mcap"].alias("before"))
    return g.where("before > 0").select("token_id", F.round(F.col("now") / F.col("before"), 6).alias("expansion"), (F.col("now") / F.col("before") >= 2).alias("expanded"))


@query("SELECT rule, signal_id FROM signals QUALIFY row_number() OVER (PARTITION BY rule ORDER BY fired_at DESC, signal_id DESC) <= 6 ORDER BY rule")
def srt_feed_caps(spark: SparkSession, d: str) -> DataFrame:
    """The six newest of each section."""
    by = Window.partitionBy("rule").orderBy(F.desc("fired_at"), F.desc("signal_id"))
    return p.signals(spark, d).withColumn("n", F.row_number().over(by)).where("n <= 6").select("rule", "signal_id")


@query("(SELECT 'bridge' AS list, edge_id AS id FROM edges WHERE action LIKE 'bridge%' ORDER BY usd DESC, edge_id LIMIT 100) UNION ALL (SELECT 'timeline', trade_id FROM trades WHERE token_id = 1 ORDER BY ts DESC, trade_id DESC LIMIT 50)")
def srt_flow_tables(spark: SparkSession, d: str) -> DataFrame:
    b = p.edges(spark, d).where("action like 'bridge%'").orderBy(F.desc("usd"), "edge_id").limit(100).select(F.lit("bridge").alias("list"), F.col("edge_id").alias("id"))
    t = p.trades(spark, d).where("token_id = 1").orderBy(F.desc("ts"), F.desc("trade_id")).limit(50).select(F.lit("timeline").alias("list"), F.col("trade_id").alias("id"))
    return b.unionByName(t)


@query(fq._PATHS + "SELECT path, least FROM pp ORDER BY least DESC, path, retention LIMIT 5")
def srt_paths(spark: SparkSession, d: str) -> DataFrame:
    return fl.paths(fl.aggregate_edges(p.edges(spark, d)).where("usd >= 100"), 3, top=5).select("path", "least")


@query("SELECT trade_id, wallet_id FROM trades WHERE trade_id % 4 > 1 ORDER BY ts, trade_id LIMIT 25")
def srt_batch_oldest(spark: SparkSession, d: str) -> DataFrame:
    """The oldest 25 pending ones."""
    return p.trades(spark, d).where("trade_id % 4 > 1").orderBy("ts", "trade_id").limit(25).select("trade_id", "wallet_id")


# ---- passes over all tokens and wallets


@query(wq._BASE + "SELECT token_id, flow_score, (SELECT max(ts) FROM trades) AS at FROM scored".replace(" AS at", " AS scored_at"))
def flow_pass(spark: SparkSession, d: str) -> DataFrame:
    """One snapshot of every token with trades."""
    t = p.trades(spark, d)
    at = t.agg(F.max("ts").alias("scored_at"))  # one row
    a = wq._agg(spark, d)
    return a.select("token_id", tw.flow_score(a).alias("flow_score")).join(F.broadcast(at))


@query(fq._CLUSTERS + "SELECT trade_id, cluster FROM trades LEFT JOIN cc ON member = wallet_id")
def cluster_persist(spark: SparkSession, d: str) -> DataFrame:
    """Every trade stamped anew with its wallet's cluster."""
    return p.trades(spark, d).select("trade_id", "wallet_id").join(fq._clusters(spark, d).withColumnRenamed("member", "wallet_id"), "wallet_id", "left").select("trade_id", "cluster")


# ---- candidates

_CAND = """,
cn AS (SELECT wallet_id, realized + coalesce(unrealized, 0) AS pnl, trade_count, win_rate, realized, avg_trade_size, CASE WHEN wallet_id % 6 <> 5 THEN confidence END AS confidence, CASE WHEN wallet_id % 4 = 1 THEN (realized + coalesce(unrealized, 0)) * 1.5 WHEN wallet_id % 4 = 2 THEN (realized + coalesce(unrealized, 0)) * 3 END AS claimed_pnl, CASE WHEN wallet_id % 3 = 0 THEN trade_count END AS claimed_trades, category, labels FROM st LEFT JOIN registry ON address = wallet_id JOIN wallets USING (wallet_id)),
cu AS (SELECT *, CASE WHEN claimed_pnl IS NOT NULL AND pnl > 0 THEN 1 ELSE 0 END + CASE WHEN claimed_trades IS NOT NULL AND trade_count > 0 THEN 1 ELSE 0 END AS n, CASE WHEN claimed_pnl IS NOT NULL AND pnl > 0 AND claimed_pnl / pnl BETWEEN 0.5 AND 2 THEN 1 ELSE 0 END + CASE WHEN claimed_trades IS NOT NULL AND trade_count > 0 THEN 1 ELSE 0 END AS good FROM cn),
cx AS (SELECT *, CAST(least(greatest(floor(confidence * (0.7::DOUBLE + 0.3::DOUBLE * CASE WHEN n > 0 THEN good / n ELSE 1.0 END) + 0.5), 0), 100) AS INTEGER) AS conf, list_filter([CASE WHEN pnl < 40 THEN 'pnl' END, CASE WHEN trade_count < 8 THEN 'trade_count' END, CASE WHEN win_rate < 0.3 THEN 'win_rate' END, CASE WHEN realized < 20 THEN 'realized' END, CASE WHEN avg_trade_size < 50 THEN 'avg_trade_size' END], lambda x: x IS NOT NULL) AS failing,
  coalesce(list_has_any(labels, ['possible_bot', 'mev']) OR (list_contains(labels, 'sniper') AND NOT list_has_any(labels, ['human_like', 'smart_money'])), false) AS bot FROM cu),
cv AS (SELECT wallet_id, CASE WHEN category IS NOT NULL THEN 'reject' WHEN bot THEN 'reject' WHEN confidence IS NULL THEN 'insufficient' WHEN len(failing) > 0 THEN 'reject' ELSE 'promote' END AS verdict,
  CASE WHEN category IS NOT NULL OR bot THEN 85 WHEN confidence IS NULL THEN 0 ELSE conf END AS confidence, CASE WHEN category IS NOT NULL THEN 'service ' || category WHEN bot THEN 'bot' WHEN confidence IS NULL THEN 'no evidence' WHEN len(failing) > 0 THEN 'below ' || array_to_string(failing, ', ') ELSE 'clears all' END AS reason FROM cx)
"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    s, w = pnl.wallet_stats(pq._pnl(spark, d)), F.col("wallet_id")
    c = s.join(p.registry(spark, d).select(F.col("address").alias("wallet_id"), "category"), "wallet_id", "left").join(p.wallets(spark, d).select("wallet_id", "labels"), "wallet_id")
    c = c.withColumn("pnl", F.col("realized") + F.coalesce("unrealized", F.lit(0.0))).withColumn("confidence", F.when(w % 6 != 5, F.col("confidence")))
    claimed = F.when(w % 4 == 1, F.col("pnl") * 1.5).when(w % 4 == 2, F.col("pnl") * 3)
    v = cd.verdict(F.col("category"), F.col("labels"), [(claimed, F.col("pnl")), (F.when(w % 3 == 0, F.col("trade_count")), F.col("trade_count"))], pq.SCALED)
    return c.withColumn("v", v).select("wallet_id", "v.verdict", "v.confidence", "v.reason")


@query(pq._FIFO + _CAND + "SELECT * FROM cv")
def cand_validate(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d)


@query(pq._FIFO + _CAND + "SELECT CASE verdict WHEN 'promote' THEN 'promoted' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS status, string_split(reason, ' ')[1] AS reason, count(*) AS n FROM cv JOIN (SELECT wallet_id FROM (SELECT wallet_id, min(ts) AS t FROM trades GROUP BY 1) ORDER BY t, wallet_id LIMIT 12) USING (wallet_id) GROUP BY ALL")
def cand_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """A batch of the oldest candidates, their new status, and reasons counted."""
    batch = p.trades(spark, d).groupBy("wallet_id").agg(F.min("ts").alias("t")).orderBy("t", "wallet_id").limit(12).select("wallet_id")
    v = F.col("verdict")
    status = F.when(v == "promote", "promoted").when(v == "reject", "rejected").otherwise("pending")
    return _verdicts(spark, d).join(F.broadcast(batch), "wallet_id").groupBy(status.alias("status"), F.split("reason", " ")[0].alias("reason")).agg(F.count("*").alias("n"))


_SYNC = ", ol0 AS (SELECT wallet_id, min(ts) AS first_seen, 'rejected' AS status, 1 AS sync FROM trades WHERE wallet_id % 3 = 0 GROUP BY 1), nw AS (SELECT wallet_id, max(ts) AS first_seen, 'pending' AS status, 2 AS sync FROM trades WHERE wallet_id % 2 = 0 GROUP BY 1)"


@query(_SYNC + " SELECT wallet_id, coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(o.status, n.status) AS status, coalesce(n.sync, o.sync) AS sync FROM ol0 o FULL JOIN nw n USING (wallet_id)")
def cand_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A source's rows again: status and first sight stay."""
    t = p.trades(spark, d)
    old = t.where("wallet_id % 3 = 0").groupBy("wallet_id").agg(F.min("ts").alias("first_seen")).withColumn("status", F.lit("rejected")).withColumn("sync", F.lit(1))
    new = t.where("wallet_id % 2 = 0").groupBy("wallet_id").agg(F.max("ts").alias("first_seen")).withColumn("status", F.lit("pending")).withColumn("sync", F.lit(2))
    return wr.upsert(old, new, ["wallet_id"], ["sync"])


@query("SELECT DISTINCT dst AS wallet_id, 0.0::DOUBLE AS pnl, 'discovered' AS source FROM edges WHERE dst NOT IN (SELECT wallet_id FROM trades WHERE action = 'BUY' AND ts < TIMESTAMP '2024-01-02')")
def cand_discover(spark: SparkSession, d: str) -> DataFrame:
    """Unseen ends of transfers as wallets with neutral statistics."""
    known = p.trades(spark, d).where((F.col("action") == "BUY") & (F.col("ts") < _ntz("2024-01-02 00:00:00"))).select("wallet_id").distinct()
    return p.edges(spark, d).select(F.col("dst").alias("wallet_id")).distinct().join(known, "wallet_id", "left_anti").select("wallet_id", F.lit(0.0).alias("pnl"), F.lit("discovered").alias("source"))


@query(vq._L + "SELECT wallet_id, n_tokens, pnl FROM ol ORDER BY pnl DESC NULLS LAST, wallet_id LIMIT 100")
def overlap_local(spark: SparkSession, d: str) -> DataFrame:
    return vq._local(spark, d).select("wallet_id", "n_tokens", "pnl").orderBy(F.desc_nulls_last("pnl"), "wallet_id").limit(100)


@query(vq._E + "SELECT wallet_id, n_tokens, 'pending' AS status, 'warehouse' AS source FROM oe")
def overlap_external(spark: SparkSession, d: str) -> DataFrame:
    """Another source's overlap rows, and the candidates they make."""
    return ov.overlap_wallets(p.trades(spark, d), [3, 4, 5], 2).select("wallet_id", "n_tokens", F.lit("pending").alias("status"), F.lit("warehouse").alias("source"))


@query(vq._L + vq._E + "SELECT wallet_id, max(n_tokens) AS n_tokens, count(*) AS sources FROM (SELECT wallet_id, n_tokens FROM ol UNION ALL SELECT wallet_id, n_tokens FROM oe) GROUP BY 1")
def overlap_hybrid(spark: SparkSession, d: str) -> DataFrame:
    t = p.trades(spark, d)
    both = vq._local(spark, d).select("wallet_id", "n_tokens").unionByName(ov.overlap_wallets(t, [3, 4, 5], 2).select("wallet_id", "n_tokens"))
    return both.groupBy("wallet_id").agg(F.max("n_tokens").alias("n_tokens"), F.count("*").alias("sources"))


# ---- outcomes


@query(oq._S + "SELECT signal_id, label, max_upside_pct, max_drawdown_pct, roi_pct FROM ev2")
def bt_evaluate(spark: SparkSession, d: str) -> DataFrame:
    return oq._evaluated(spark, d).select("signal_id", "label", "max_upside_pct", "max_drawdown_pct", "roi_pct")


@query(oq._HZ + ", h7(horizon, lim) AS (VALUES ('M15', 15), ('H1', 60), ('H6', 360), ('H24', 1440), ('D3', 4320), ('D7', 10080)) SELECT s.signal_id, h.horizon, coalesce(roi_pct, 0) AS roi_pct, array_to_string(list_filter([CASE WHEN epoch_us(TIMESTAMP '2024-01-28') < epoch_us(fired_at) + CAST(lim AS BIGINT) * 60000000 THEN 'window_incomplete' END, CASE WHEN synthetic THEN 'synthetic_continuation' END], lambda x: x IS NOT NULL), ',') AS notes FROM signals s CROSS JOIN h7 h LEFT JOIN hz USING (signal_id, horizon) WHERE epoch_us(TIMESTAMP '2024-01-28') - epoch_us(fired_at) >= 900000000")
def bt_pass(spark: SparkSession, d: str) -> DataFrame:
    """Six rows a signal of 15 minutes or more, a missing return as 0, with notes."""
    now = F.unix_micros(_ntz("2024-01-28 00:00:00").cast("timestamp"))
    age = now - F.unix_micros(F.col("fired_at").cast("timestamp"))
    dim = F.explode(F.array(*[F.struct(F.lit(k).alias("horizon"), F.lit(v).cast("long").alias("lim")) for k, v in oc.HORIZONS.items()]))
    s = p.signals(spark, d).where(age >= 900_000_000).withColumn("h", dim).select("signal_id", "synthetic", "h.horizon", (age < F.col("h.lim") * 60_000_000).alias("early"))
    notes = F.concat_ws(",", F.when(F.col("early"), "window_incomplete"), F.when(F.col("synthetic"), "synthetic_continuation"))
    return s.join(oq.slices(spark, d).select("signal_id", "horizon", "roi_pct"), ["signal_id", "horizon"], "left").select("signal_id", "horizon", F.coalesce("roi_pct", F.lit(0.0)).alias("roi_pct"), notes.alias("notes"))


@query("""SELECT signal_id, coalesce(to_ts, TIMESTAMP '2024-01-28') AS to_ts, coalesce(from_ts, coalesce(to_ts, TIMESTAMP '2024-01-28') - INTERVAL 14 DAY) AS from_ts, coalesce(step, 30) AS step,
  CASE WHEN step <= 0 THEN 'step' WHEN coalesce(to_ts, TIMESTAMP '2024-01-28') < coalesce(from_ts, coalesce(to_ts, TIMESTAMP '2024-01-28') - INTERVAL 14 DAY) THEN 'backwards' WHEN epoch_us(coalesce(to_ts, TIMESTAMP '2024-01-28')) - epoch_us(coalesce(from_ts, coalesce(to_ts, TIMESTAMP '2024-01-28') - INTERVAL 14 DAY)) > 1209600000000 THEN 'too long' ELSE 'valid' END AS verdict
  FROM (SELECT signal_id, CASE WHEN signal_id % 3 <> 0 THEN fired_at END AS from_ts, CASE WHEN signal_id % 4 <> 0 THEN fired_at + to_hours(48 * (signal_id % 11) - 48) END AS to_ts, CASE WHEN signal_id % 5 <> 0 THEN signal_id % 7 * 15 END AS step FROM signals)""")
def bt_request(spark: SparkSession, d: str) -> DataFrame:
    """Requests to replay around each signal, some without an end, a start or a step: defaults filled in, and whether they hold.

    A window ends now and starts 14 days before its end unless told otherwise, isn't longer than that and not backwards;
    a step is above zero.
    """
    i = F.col("signal_id")
    raw = p.signals(spark, d).select("signal_id", F.when(i % 3 != 0, F.col("fired_at")).alias("a"), F.when(i % 4 != 0, F.col("fired_at") + F.make_dt_interval(hours=48 * (i % 11).cast("int") - 48)).alias("b"), F.when(i % 5 != 0, i % 7 * 15).alias("s"))
    to = F.coalesce("b", F.lit("2024-01-28 00:00:00").cast("timestamp_ntz"))
    full = raw.withColumn("to_ts", to).withColumn("from_ts", F.coalesce("a", F.col("to_ts") - F.expr("INTERVAL 14 DAYS"))).withColumn("step", F.coalesce("s", F.lit(30)))
    late = F.col("to_ts") > F.col("from_ts") + F.expr("INTERVAL 14 DAYS")
    return full.select("signal_id", "to_ts", "from_ts", "step", F.when(F.col("step") <= 0, "step").when(F.col("to_ts") < F.col("from_ts"), "backwards").when(late, "too long").otherwise("valid").alias("verdict"))


# ---- social, confluence, risks, alerts


@query("SELECT post_id, author, posted_at FROM posts ORDER BY posted_at DESC, post_id DESC LIMIT 50")
def soc_recent(spark: SparkSession, d: str) -> DataFrame:
    return p.posts(spark, d).orderBy(F.desc("posted_at"), F.desc("post_id")).limit(50).select("post_id", "author", "posted_at")


@query(sq._M + "SELECT post_id, kind, confidence FROM mn WHERE token = 'ABC'")
def soc_token(spark: SparkSession, d: str) -> DataFrame:
    return social.mentions(p.posts(spark, d)).where("token = 'ABC'").select("post_id", "kind", "confidence")


_SNAP = "SELECT token_id, ts, point_id, year(ts) || '-' || month(ts) || '-' || day(ts) || '-' || hour(ts) AS hour, round(CASE WHEN liquidity > 0 AND mcap > 0 THEN liquidity / mcap END, 8) AS ratio FROM market"


@query(f", s AS ({_SNAP}) SELECT 'local:risk:' || token_id || ':' || hour AS snapshot_key, ratio FROM s QUALIFY row_number() OVER (PARTITION BY token_id, hour ORDER BY ts DESC, point_id DESC) = 1")
def cf_pass(spark: SparkSession, d: str) -> DataFrame:
    """A risk row for each token and hour: the last of the hour stays."""
    from tideflow.functions import scalar as sc

    m = p.market(spark, d).withColumn("hour", sc.hour_bucket(F.col("ts")))
    last = tm.latest(m.select("token_id", "hour", "ts", "point_id", "mcap", "liquidity"), ["token_id", "hour"], "ts", "point_id")
    risk = social.liquidity_risk(last.withColumn("token_id", F.concat_ws(":", F.lit("local"), F.lit("risk"), F.col("token_id").cast("string"), "hour")))
    return risk.select(F.col("token_id").alias("snapshot_key"), "ratio")


@query(f", s AS ({_SNAP}) SELECT token_id, ratio FROM s QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY ts DESC, point_id DESC) = 1")
def cf_latest(spark: SparkSession, d: str) -> DataFrame:
    return social.liquidity_risk(tm.latest(p.market(spark, d), ["token_id"], "ts", "point_id")).select("token_id", "ratio")


@query(""", h AS (SELECT token_id, max(h) / sum(h) AS top1, sum(h) FILTER (n <= 5) / sum(h) AS top5 FROM (SELECT token_id, h, row_number() OVER (PARTITION BY token_id ORDER BY h DESC, wallet_id) AS n FROM (SELECT token_id, wallet_id, CAST(sum(qty) AS DOUBLE) AS h FROM trades WHERE action = 'BUY' GROUP BY ALL)) GROUP BY 1)
SELECT token_id, least(1.0, round(CASE WHEN top1 >= 0.3::DOUBLE THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN top5 >= 0.6::DOUBLE THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN token_id % 2 = 0 THEN 0.25::DOUBLE ELSE 0 END, 4)) AS penalty FROM h""")
def risk_solana(spark: SparkSession, d: str) -> DataFrame:
    h = p.trades(spark, d).where("action = 'BUY'").groupBy("token_id", "wallet_id").agg(F.sum("qty").cast("double").alias("h"))
    ranked = h.withColumn("n", F.row_number().over(Window.partitionBy("token_id").orderBy(F.desc("h"), "wallet_id")))
    g = ranked.groupBy("token_id").agg((F.max("h") / F.sum("h")).alias("top1"), (F.sum(F.when(F.col("n") <= 5, F.col("h"))) / F.sum("h")).alias("top5"))
    return g.select("token_id", cd.holder_risk(F.col("top1"), F.col("top5"), F.col("token_id") % 2 == 0, F.lit(False)).alias("penalty"))


@query("""SELECT event_id, least(1.0, round(CASE WHEN k % 9 = 0 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN k % 7 = 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN k / 100 >= 0.5 THEN 0.3::DOUBLE WHEN k / 100 > 0.1::DOUBLE THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN k / 200 > 0.1::DOUBLE THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN k % 3 = 1 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN k % 4 = 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN k / 150 >= 0.3::DOUBLE THEN 0.2::DOUBLE ELSE 0 END, 4)) AS penalty FROM ev""")
def risk_evm(spark: SparkSession, d: str) -> DataFrame:
    e = p.table(spark, d, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    k = F.col("k")
    return e.select("event_id", cd.contract_risk(k % 9 == 0, k % 7 == 0, k / 100, k / 200, F.when(k % 3 == 1, False).when(k % 3 == 2, True), k % 4 == 0, k / 150).alias("penalty"))


_COOL = ", a AS (SELECT *, lag(fired_at) OVER w AS before, lag(severity) OVER w AS was FROM signals WINDOW w AS (PARTITION BY token_id, rule ORDER BY fired_at, signal_id)), b AS (SELECT signal_id, token_id % 11 = 0 AS no_token, before IS NULL OR epoch_us(fired_at) - epoch_us(before) >= 1800000000 OR (severity = 'CRITICAL' AND was <> 'CRITICAL') AS go FROM a)"


@query(_COOL + " SELECT signal_id, CASE WHEN no_token THEN 'skipped_no_token' WHEN go THEN 'sent' ELSE 'skipped_cooldown' END AS status FROM b")
def alert_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """One alert a signal. A skipped one starts the cooldown anew, so the signal before decides."""
    by = Window.partitionBy("token_id", "rule").orderBy("fired_at", "signal_id")
    s = p.signals(spark, d).withColumn("before", F.lag("fired_at").over(by)).withColumn("was", F.lag("severity").over(by))
    gap = F.unix_micros(F.col("fired_at").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    go = F.col("before").isNull() | (gap >= 1_800_000_000) | ((F.col("severity") == "CRITICAL") & (F.col("was") != "CRITICAL"))
    return s.select("signal_id", F.when(F.col("token_id") % 11 == 0, "skipped_no_token").when(go, "sent").otherwise("skipped_cooldown").alias("status"))


@query("SELECT 'point' AS part, point_id AS id, price AS value FROM market WHERE token_id = 1 UNION ALL SELECT 'marker', signal_id, entry_price FROM signals WHERE token_id = 1 UNION ALL SELECT 'buyer', wallet_id, CAST(sum(usd) AS DOUBLE) FROM trades WHERE token_id = 1 AND action = 'BUY' GROUP BY wallet_id")
def token_detail(spark: SparkSession, d: str) -> DataFrame:
    """One token's series, markers and buyers."""
    one = F.col("token_id") == 1
    points = p.market(spark, d).where(one).select(F.lit("point").alias("part"), F.col("point_id").alias("id"), F.col("price").alias("value"))
    marks = p.signals(spark, d).where(one).select(F.lit("marker").alias("part"), F.col("signal_id").alias("id"), F.col("entry_price").alias("value"))
    buyers = p.trades(spark, d).where(one & ov.bought()).groupBy(F.col("wallet_id").alias("id")).agg(F.sum("usd").cast("double").alias("value")).select(F.lit("buyer").alias("part"), "id", "value")
    return points.unionByName(marks).unionByName(buyers)




@query("SELECT 'node' AS part, node AS a, CAST(NULL AS BIGINT) AS b FROM (SELECT node, min(depth) FROM (WITH RECURSIVE r AS (SELECT CAST(3 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM r JOIN (SELECT DISTINCT src, dst FROM (SELECT src, dst, sum(usd) AS usd FROM edges GROUP BY ALL) WHERE usd >= 100) e ON e.src = r.node WHERE depth < 2) SELECT * FROM r) GROUP BY 1) UNION ALL SELECT 'edge', src, dst FROM (SELECT src, dst, sum(usd) AS usd FROM edges GROUP BY ALL) WHERE usd >= 100 AND src IN (SELECT node FROM (WITH RECURSIVE r AS (SELECT CAST(3 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM r JOIN (SELECT DISTINCT src, dst FROM (SELECT src, dst, sum(usd) AS usd FROM edges GROUP BY ALL) WHERE usd >= 100) e ON e.src = r.node WHERE depth < 1) SELECT * FROM r))")
def graph_search(spark: SparkSession, d: str) -> DataFrame:
    """A search of two hops with its nodes and the edges of expanded nodes, written as the search's rows and read again."""
    from tideflow.sources.shared import shared_path

    e = fl.saved(p.edges(spark, d).groupBy("src", "dst").agg(F.sum("usd").alias("usd")).where("usd >= 100"))
    nodes = fl.frontier(e, 3, 2, 100.0)
    inner = nodes.where("depth < 2").select(F.col("node").alias("src"))
    rows = nodes.select(F.lit("node").alias("part"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(e.join(inner, "src").select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b")))
    path = shared_path(spark, "search")
    rows.write.partitionBy("part").parquet(path)
    return spark.read.parquet(path).select("part", "a", "b")
