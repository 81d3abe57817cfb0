"""Rotations through transfers and bridges: a pass's inputs, its chains, and those it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.operators import flows as fl
from tideflow.operators import pnl
from tideflow.operators import rotation as ro
from tideflow.plans import flows as fq
from tideflow.plans.registry import query
from tideflow.plans.replay import _kept
from tideflow.sources import projection as p

START, END, EVERY = "2024-01-03 00:00:00", "2024-01-31 00:00:00", 12
_SINCE = "ts >= TIMESTAMP '2024-01-10'"

_MOVES = fq._ROT + fq._GREEDY + """,
mo AS (SELECT edge_id AS move_id, edge_id AS receipt_id, src AS source, dst AS dest, CAST(usd AS DOUBLE) AS sent, ts AS move_ts, CAST(usd AS DOUBLE) AS got, ts AS got_ts, false AS bridged, NULL AS protocol FROM edges WHERE action = 'transfer'
  UNION ALL SELECT x.edge_id, y.edge_id, x.src, y.dst, CAST(x.usd AS DOUBLE), x.ts, CAST(y.usd AS DOUBLE), y.ts, true, x.protocol FROM gm JOIN edges x ON x.edge_id = dep_id JOIN edges y ON y.edge_id = wd_id),
mw AS (SELECT * FROM mo WHERE source IN (SELECT wallet_id FROM wallets) AND dest IN (SELECT wallet_id FROM wallets))
"""
# The limits are the rule's own, but for the profit and the delay of the buy, which are scaled to the tables.
_CHAINS = _MOVES + """,
rv AS (SELECT m.move_id, r.receipt_id, m.source, m.dest, m.sent, m.move_ts, r.got, r.got_ts, m.bridged, m.protocol FROM mw m JOIN mw r ON r.source = m.source AND r.dest = m.dest AND r.got_ts BETWEEN m.move_ts AND m.move_ts + INTERVAL 48 HOUR AND m.sent > 0 AND r.got / m.sent * 100 BETWEEN 80 AND 105
  QUALIFY row_number() OVER (PARTITION BY m.move_id ORDER BY r.got_ts, r.receipt_id <> m.receipt_id, r.receipt_id) = 1),
bo AS (SELECT rv.*, b.trade_id AS buy_id, b.token_id AS to_token, b.ts AS buy_ts, CAST(b.mcap AS DOUBLE) AS mcap FROM rv JOIN trades b ON b.wallet_id = rv.dest AND b.action = 'BUY' AND b.mcap <= 5000000 AND b.ts BETWEEN got_ts AND got_ts + INTERVAL 360 MINUTE
  QUALIFY row_number() OVER (PARTITION BY move_id ORDER BY b.ts, b.trade_id) = 1),
cn AS (SELECT x.trade_id AS exit_id, x.token_id AS from_token, x.ts AS exit_ts, profit, bo.*, (epoch_us(buy_ts) - epoch_us(x.ts)) / 60000000 AS gap_min,
  35 + CASE WHEN bridged THEN 30 ELSE 0 END + CASE WHEN got > 0 AND least(sent, got) / greatest(sent, got) >= 0.9 THEN 15 ELSE 0 END AS confidence
  FROM trades x JOIN xp USING (trade_id) JOIN bo ON bo.source = x.wallet_id AND move_ts BETWEEN x.ts AND x.ts + INTERVAL 24 HOUR WHERE x.action = 'SELL' AND profit >= 5)
"""
_PASSES = _CHAINS + f""",
sn AS (SELECT cn.*, t FROM cn JOIN (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL {EVERY} HOUR)) AS t) ON t >= buy_ts AND t <= exit_ts + INTERVAL 48 HOUR),
ro AS (SELECT DISTINCT source, dest, to_token, t FROM sn)""" + _kept("ro", "source, dest, to_token", "kp", ">")


def _moves(spark: SparkSession, d: str) -> DataFrame:
    """Bridge legs are matched once over all edges, not anew in each pass."""
    e = p.edges(spark, d)
    return fl.saved(ro.moves(e, p.wallets(spark, d), fl.greedy_match(fq._bridge(spark, d))))


def _chains(spark: SparkSession, d: str) -> DataFrame:
    t = p.trades(spark, d)
    exits = pnl.profit_at_exit(pnl.fifo_sells(t))
    return ro.chains(exits, fl.saved(ro.received(_moves(spark, d))), t.where("action = 'BUY'"), min_profit=5.0, buy_minutes=360)


@query(_MOVES + f"""SELECT 'exit' AS kind, trade_id AS id, wallet_id AS source, NULL AS dest, false AS bridged, round(profit, 6) AS usd FROM xp JOIN trades USING (trade_id) WHERE {_SINCE}
UNION ALL SELECT 'transfer', move_id, source, dest, bridged, sent FROM mw WHERE move_{_SINCE} UNION ALL SELECT 'receipt', receipt_id, source, dest, bridged, got FROM mw WHERE got_{_SINCE}
UNION ALL SELECT 'buy', trade_id, wallet_id, NULL, false, CAST(usd AS DOUBLE) FROM trades WHERE action = 'BUY' AND mcap IS NOT NULL AND {_SINCE}""")  # fmt: skip
def rotation_inputs(spark: SparkSession, d: str) -> DataFrame:
    """What a rotation pass reads in its window: exits with the profit up to them, transfers, bridged ones too, receipts and buys."""
    t, m, none = p.trades(spark, d), _moves(spark, d), F.lit(None).cast("long")
    since = lambda c: F.col(c) >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    row = lambda kind, id, source, dest, bridged, usd: [F.lit(kind).alias("kind"), F.col(id).alias("id"), F.col(source).alias("source"), dest.alias("dest"), bridged.alias("bridged"), usd.alias("usd")]
    exits = pnl.profit_at_exit(pnl.fifo_sells(t)).where(since("ts")).select(*row("exit", "trade_id", "wallet_id", none, F.lit(False), F.round("profit", 6)))
    sent = m.where(since("move_ts")).select(*row("transfer", "move_id", "source", F.col("dest"), F.col("bridged"), F.col("sent")))
    got = m.where(since("got_ts")).select(*row("receipt", "receipt_id", "source", F.col("dest"), F.col("bridged"), F.col("got")))
    buys = t.where((F.col("action") == "BUY") & F.col("mcap").isNotNull() & since("ts")).select(*row("buy", "trade_id", "wallet_id", none, F.lit(False), F.col("usd").cast("double")))
    return exits.unionByName(sent).unionByName(got).unionByName(buys)


@query(_CHAINS + "SELECT exit_id, move_id, receipt_id, buy_id, source, dest, from_token, to_token, bridged, round(gap_min, 4) AS gap_min, confidence FROM cn")
def rotation_chains(spark: SparkSession, d: str) -> DataFrame:
    """All rotations, from exit through transfer and receipt to the buy, bridged ones too."""
    return _chains(spark, d).select("exit_id", "move_id", "receipt_id", "buy_id", "source", "dest", "from_token", "to_token", "bridged", F.round("gap_min", 4).alias("gap_min"), "confidence")


@query(_PASSES + """SELECT exit_id, move_id, receipt_id, buy_id, t AS detected_at, bridged, confidence, round(CASE WHEN mcap > 0 AND now IS NOT NULL THEN (now / mcap - 1) * 100 ELSE 0 END, 4) + 0.0::DOUBLE AS perf_pct
FROM (SELECT *, (SELECT arg_max(m.mcap, (m.ts, m.point_id)) FROM market m WHERE m.token_id = to_token AND m.ts <= k.t AND m.mcap IS NOT NULL) AS now FROM (SELECT * FROM sn JOIN kp USING (source, dest, to_token, t) QUALIFY row_number() OVER (PARTITION BY source, dest, to_token, t ORDER BY move_ts, exit_ts, exit_id, move_id) = 1) k)""")  # fmt: skip
def rotation_persist(spark: SparkSession, d: str) -> DataFrame:
    """Rotations that passes every twelve hours keep, each looking back two days: one a route, unless kept in the day before."""
    out = ro.kept(_chains(spark, d), p.market(spark, d), START, END, EVERY)
    return out.select("exit_id", "move_id", "receipt_id", "buy_id", "detected_at", "bridged", "confidence", (F.round("perf_pct", 4) + 0.0).alias("perf_pct"))
