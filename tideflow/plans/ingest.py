"""Queries over sources, sinks and write forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.operators import temporal as tm
from tideflow.operators import writes as wr
from tideflow.plans.registry import query
from tideflow.sources import chains, formats
from tideflow.sources import projection as p
from tideflow.sources.shared import shared_path


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# ---- scans


@query("SELECT trade_id, wallet_id, CAST(usd AS DOUBLE) AS usd, ts FROM trades WHERE token_id = 3 AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts, trade_id LIMIT 100")
def src_table_scan(spark: SparkSession, d: str) -> DataFrame:
    t = p.trades(spark, d).where((F.col("token_id") == 3) & (F.col("ts") >= _ntz("2024-01-10 00:00:00")))
    return t.select("trade_id", "wallet_id", F.col("usd").cast("double").alias("usd"), "ts").orderBy("ts", "trade_id").limit(100)


@query("SELECT e.edge_id, r.category FROM edges e JOIN registry r ON r.address = e.dst AND r.chain = 'SOLANA'")
def src_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A look-up by a unique key for every edge at once."""
    r = p.registry(spark, d).where("chain = 'SOLANA'").select(F.col("address").alias("dst"), "category")
    return p.edges(spark, d).join(r, "dst").select("edge_id", "category")


@query("SELECT post_id, author, content, posted_at FROM posts WHERE posted_at > TIMESTAMP '2024-01-15' ORDER BY posted_at, post_id LIMIT 200")
def src_social_posts(spark: SparkSession, d: str) -> DataFrame:
    return p.posts(spark, d).where(F.col("posted_at") > _ntz("2024-01-15 00:00:00")).orderBy("posted_at", "post_id").limit(200)


@query("SELECT token_id, mcap, CASE WHEN ts < TIMESTAMP '2024-01-29' THEN 'STALE' WHEN mcap IS NULL THEN 'EMPTY' ELSE 'OK' END AS status FROM market QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY ts DESC, point_id DESC) = 1")
def src_confluence(spark: SparkSession, d: str) -> DataFrame:
    """Each token's latest snapshot with a status."""
    m = tm.latest(p.market(spark, d).select("token_id", "ts", "point_id", "mcap"), ["token_id"], "ts", "point_id")
    status = F.when(F.col("ts") < _ntz("2024-01-29 00:00:00"), "STALE").when(F.col("mcap").isNull(), "EMPTY").otherwise("OK")
    return m.select("token_id", "mcap", status.alias("status"))


# ---- CSV and JSON

_WALLETS_CSV = """,
w AS (SELECT event_id AS i, k, CASE k % 11 WHEN 0 THEN ' ' WHEN 1 THEN 'So1anaToken' || repeat('O', 24) ELSE ' So1anaToken' || repeat(CAST(k % 9 + 1 AS VARCHAR), 24) || ' ' END AS wallet_address, CASE WHEN k % 13 = 0 THEN 'ETH' WHEN k % 2 = 0 THEN 'solana' ELSE ' SOLANA' END AS chain,
  CASE WHEN k % 17 = 0 THEN 'x1' ELSE CAST(k * 10 AS VARCHAR) END AS pnl_30d, CAST(k AS VARCHAR) AS realized_pnl_30d, CASE WHEN k % 19 = 0 THEN '' ELSE '-' || k || '.5' END AS unrealized_pnl_30d, CASE WHEN k % 23 = 0 THEN '1.5' ELSE '0.' || k END AS win_rate,
  CASE WHEN k % 29 = 0 THEN '2.5' ELSE CAST(k % 40 AS VARCHAR) END AS trade_count_30d, CASE WHEN k % 31 = 0 THEN '-1' ELSE '75' END AS avg_trade_size_usd, CASE WHEN k % 3 = 0 THEN 'sniper| human_like |' ELSE 'other' END AS tags, CASE k % 4 WHEN 0 THEN 'CSV' WHEN 1 THEN '' ELSE 'list "' || (k % 5) || '", b' END AS source FROM ev),
v AS (SELECT *, trim(wallet_address) AS address, upper(trim(chain)) AS of_chain FROM w),
x AS (SELECT *, CASE WHEN address = '' THEN 'missing wallet_address' WHEN of_chain NOT IN ('SOLANA', 'BSC') THEN 'invalid chain: ' || chain WHEN NOT regexp_matches(address, '^[1-9A-HJ-NP-Za-km-z]{32,44}$') THEN 'malformed address: ' || address
  WHEN TRY_CAST(pnl_30d AS DOUBLE) IS NULL THEN 'invalid pnl_30d: ' || pnl_30d WHEN TRY_CAST(realized_pnl_30d AS DOUBLE) IS NULL THEN 'invalid realized_pnl_30d: ' || realized_pnl_30d WHEN unrealized_pnl_30d = '' THEN 'invalid unrealized_pnl_30d: ' WHEN CAST(win_rate AS DOUBLE) > 1 THEN 'invalid win_rate: ' || win_rate
  WHEN CAST(trade_count_30d AS DOUBLE) <> floor(CAST(trade_count_30d AS DOUBLE)) THEN 'invalid trade_count_30d: ' || trade_count_30d WHEN CAST(avg_trade_size_usd AS DOUBLE) < 0 THEN 'invalid avg_trade_size_usd: ' || avg_trade_size_usd END AS error,
  CASE WHEN trim(source) <> '' AND lower(trim(source)) <> 'csv' THEN 'source: ' || trim(source) END AS note FROM v)
"""


def _wallet_rows(spark: SparkSession, d: str) -> DataFrame:
    """i and a wallet list's columns as text, some of them at fault."""
    e = p.table(spark, d, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    k, n = F.col("k"), _text("k")
    token = F.concat(F.lit("So1anaToken"), F.repeat((k % 9 + 1).cast("string"), 24))
    return e.select(
        F.col("event_id").alias("i"),
        F.when(k % 11 == 0, " ").when(k % 11 == 1, "So1anaToken" + "O" * 24).otherwise(F.concat(F.lit(" "), token, F.lit(" "))).alias("wallet_address"),
        F.when(k % 13 == 0, "ETH").when(k % 2 == 0, "solana").otherwise(" SOLANA").alias("chain"),
        F.when(k % 17 == 0, "x1").otherwise((k * 10).cast("string")).alias("pnl_30d"),
        n.alias("realized_pnl_30d"),
        F.when(k % 19 == 0, "").otherwise(F.concat(F.lit("-"), n, F.lit(".5"))).alias("unrealized_pnl_30d"),
        F.when(k % 23 == 0, "1.5").otherwise(F.concat(F.lit("0."), n)).alias("win_rate"),
        F.when(k % 29 == 0, "2.5").otherwise((k % 40).cast("string")).alias("trade_count_30d"),
        F.when(k % 31 == 0, "-1").otherwise("75").alias("avg_trade_size_usd"),
        F.when(k % 3 == 0, "sniper| human_like |").otherwise("other").alias("tags"),
        F.when(k % 4 == 0, "CSV").when(k % 4 == 1, "").otherwise(F.concat(F.lit('list "'), (k % 5).cast("string"), F.lit('", b'))).alias("source"),
    )


@query(_WALLETS_CSV + "SELECT i, wallet_address, chain, source FROM (SELECT CAST(i AS VARCHAR) AS i, wallet_address, chain, nullif(source, '') AS source FROM w)")
def src_csv_parse(spark: SparkSession, d: str) -> DataFrame:
    """A list written with quotes, doubled quotes and CR LF, and read again."""
    path = shared_path(spark, "wallets")
    rows = _wallet_rows(spark, d).select("i", "wallet_address", "chain", "source")
    formats.write_csv(rows.select(*[_text(c).alias(c) for c in rows.columns]), path)
    return formats.read_csv(spark, path, tuple(rows.columns))


@query(_WALLETS_CSV + "SELECT i, error FROM x")
def src_csv_validate(spark: SparkSession, d: str) -> DataFrame:
    return formats.validated_wallets(_wallet_rows(spark, d)).select("i", "error")


@query(_WALLETS_CSV + """, g AS (SELECT * FROM x WHERE error IS NULL), o AS (SELECT address, min(i) AS first_row, count(*) AS stats FROM g GROUP BY 1),
n AS (SELECT address, string_agg(note, chr(10) ORDER BY f) AS notes FROM (SELECT address, note, min(i) AS f FROM g WHERE note IS NOT NULL GROUP BY ALL) GROUP BY 1),
t AS (SELECT address, count(DISTINCT tag) AS labels FROM (SELECT address, trim(unnest(string_split(tags, '|'))) AS tag FROM g) WHERE tag IN ('sniper', 'human_like', 'smart_money', 'possible_bot', 'mev') GROUP BY 1)
SELECT address, first_row, stats, notes, coalesce(labels, 0) AS labels, (SELECT count(*) FROM x WHERE error IS NOT NULL) AS bad_rows FROM o LEFT JOIN n USING (address) LEFT JOIN t USING (address)""")  # fmt: skip
def src_csv_import(spark: SparkSession, d: str) -> DataFrame:
    """What a list's good rows leave: a watched wallet each, its snapshots, notes once each and known labels; and the bad rows' number."""
    rows = formats.validated_wallets(_wallet_rows(spark, d))
    good = rows.where("error is null")
    known = F.filter("tag_list", lambda t: t.isin("sniper", "human_like", "smart_money", "possible_bot", "mev"))
    wallets = good.groupBy("address").agg(F.min("i").alias("first_row"), F.count("*").alias("stats"))
    notes = good.where("note is not null").groupBy("address", "note").agg(F.min("i").alias("f")).groupBy("address").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "note"))), lambda x: x["note"]), "\n").alias("notes"))
    labels = good.select("address", F.explode(known).alias("tag")).groupBy("address").agg(F.count_distinct("tag").alias("labels"))
    bad = rows.agg(F.count_if(F.col("error").isNotNull()).alias("bad_rows"))  # one row
    return wallets.join(notes, "address", "left").join(labels, "address", "left").join(F.broadcast(bad)).select("address", "first_row", "stats", "notes", F.coalesce("labels", F.lit(0)).alias("labels"), "bad_rows")


@query("SELECT CAST(wallet_id AS VARCHAR) || ',' || CASE WHEN wallet_id % 3 = 0 THEN '\"a, \"\"' || wallet_id || '\"\"\"' ELSE 'plain' END || ',' || CAST(wallet_id * 2 AS VARCHAR) AS line FROM wallets")
def sink_csv(spark: SparkSession, d: str) -> DataFrame:
    """The lines that the writer leaves, without the header."""
    path, w = shared_path(spark, "sink"), F.col("wallet_id")
    cell = F.when(w % 3 == 0, F.concat(F.lit('a, "'), w.cast("string"), F.lit('"'))).otherwise("plain")
    formats.write_csv(p.wallets(spark, d).select(w.alias("id"), cell.alias("cell"), (w * 2).alias("twice")), path)
    return spark.read.text(path, lineSep="\r\n").select(F.col("value").alias("line")).where("line <> 'id,cell,twice'")


@query("""SELECT 'edge' AS part, '{"source":' || src || ',"dest":' || dst || ',"txs":' || count(*) || '}' AS line FROM edges GROUP BY src, dst
  UNION ALL SELECT 'node', '{"address":' || a || ',"type":"' || CASE category WHEN 'CEX' THEN 'exchange' ELSE 'wallet' END || '"}' FROM (SELECT src AS a FROM edges UNION SELECT dst FROM edges) LEFT JOIN registry ON address = a""")
def sink_graph_export(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges as JSON lines, written and read again."""
    e = p.edges(spark, d)
    path = shared_path(spark, "graph")
    edges = e.groupBy("src", "dst").agg(F.count("*").alias("txs")).select(F.lit("edge").alias("part"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("dest"), "txs")).alias("line"))
    ids = e.select(F.explode(F.array("src", "dst")).alias("address")).distinct().join(p.registry(spark, d).select("address", "category"), "address", "left")
    nodes = ids.select(F.lit("node").alias("part"), F.to_json(F.struct("address", F.when(F.col("category") == "CEX", "exchange").otherwise("wallet").alias("type"))).alias("line"))
    nodes.unionByName(edges).write.partitionBy("part").text(path)
    return spark.read.text(path).select("part", F.col("value").alias("line"))


_JSON = """, j AS (SELECT event_id, CASE k % 5 WHEN 0 THEN '{"wallet": "w' || user_id || '", "count": ' || k || '}' WHEN 1 THEN '{"wallet": "w' || user_id || '"}' WHEN 2 THEN '{"count": 3}' WHEN 3 THEN 'oops{' ELSE '{"wallet": "w' || user_id || '", "count": ' || k || ', "pnl": ' || k || '.25}' END AS raw FROM ev),
r AS (SELECT *, CASE WHEN NOT json_valid(raw) THEN 'not json' WHEN json_extract_string(CASE WHEN json_valid(raw) THEN raw END, '$.wallet') IS NULL THEN 'no wallet' WHEN json_extract_string(CASE WHEN json_valid(raw) THEN raw END, '$.count') IS NULL THEN 'no count' END AS reason FROM j)
"""


def _json(spark: SparkSession, d: str) -> DataFrame:
    e = p.table(spark, d, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    k, n, w = F.col("k") % 5, _text("k"), F.concat(F.lit('{"wallet": "w'), _text("user_id"), F.lit('"'))
    raw = F.when(k == 0, F.concat(w, F.lit(', "count": '), n, F.lit("}"))).when(k == 1, F.concat(w, F.lit("}"))).when(k == 2, '{"count": 3}').when(k == 3, "oops{").otherwise(F.concat(w, F.lit(', "count": '), n, F.lit(', "pnl": '), n, F.lit(".25}")))
    return formats.json_rows(e.select("event_id", raw.alias("raw")), "raw", "wallet string, count long, pnl double", ("wallet", "count"))


@query(_JSON + "SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM r GROUP BY 1")
def src_json_rows(spark: SparkSession, d: str) -> DataFrame:
    return _json(spark, d).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(_JSON + "SELECT event_id, json_extract_string(raw, '$.wallet') AS wallet, CAST(json_extract_string(raw, '$.count') AS BIGINT) AS claimed_trades, CAST(json_extract_string(raw, '$.pnl') AS DOUBLE) AS claimed_pnl, 'leaderboard' AS source FROM (SELECT * FROM r WHERE reason IS NULL)")
def src_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _json(spark, d).where("reason is null").select("event_id", "j.wallet", F.col("j.count").alias("claimed_trades"), F.col("j.pnl").alias("claimed_pnl"), F.lit("leaderboard").alias("source"))


# ---- chains


@query(""", x AS (SELECT event_id, CASE WHEN k % 10 = 0 THEN 'x' || k ELSE CASE WHEN k % 3 = 0 THEN '-' ELSE '' END || (CAST(event_id AS HUGEINT) * 1000000007 * (k % 7) * 1000) END AS raw, CAST(event_id AS HUGEINT) * 1000000007 * (k % 7) * 1000 AS n, k % 3 = 0 AS neg, k % 10 = 0 AS bad, k % 19 AS dec FROM ev),
y AS (SELECT *, n // CAST(pow(10, dec) AS HUGEINT) AS whole, rtrim(lpad(CAST(n % CAST(pow(10, dec) AS HUGEINT) AS VARCHAR), dec, '0'), '0') AS rest FROM x)
SELECT event_id, CASE WHEN bad THEN '0' WHEN n = 0 THEN '0' ELSE CASE WHEN neg THEN '-' ELSE '' END || whole || CASE WHEN dec > 0 AND rest <> '' THEN '.' || rest ELSE '' END END AS amount FROM y""")  # fmt: skip
def src_decimal_shift(spark: SparkSession, d: str) -> DataFrame:
    from tideflow.functions import scalar as sc

    e = p.table(spark, d, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    k = F.col("k")
    number = (F.col("event_id").cast("decimal(20,0)") * F.lit(1000000007).cast("decimal(10,0)") * (k % 7 * 1000).cast("decimal(5,0)")).cast("decimal(38,0)").cast("string")
    raw = F.when(k % 10 == 0, F.concat(F.lit("x"), _text("k"))).otherwise(F.concat(F.when(k % 3 == 0, "-").otherwise(""), number))
    return e.select("event_id", sc.decimal_shift(raw, k % 19).alias("amount"))


_SOL = """,
tx AS (SELECT event_id AS tx, user_id AS w, k, ts, CASE WHEN k % 4 = 0 THEN 'WORMHOLE' ELSE 'SYSTEM' END AS source FROM ev WHERE k % 6 < 5),
lg AS (SELECT tx, w, 0 AS ord, 0 AS j, 'swap_leg' AS kind, CAST(w AS VARCHAR) AS src, '' AS dst, NULL AS asset, k / 10.0 AS amount FROM tx WHERE k % 6 = 0
  UNION ALL SELECT tx, w, 3, j, 'swap_leg', '', CAST(w AS VARCHAR), 'mint' || (k % 8), (k + j) / 100.0 FROM tx, (VALUES (0), (1)) v(j) WHERE k % 6 = 0
  UNION ALL SELECT tx, w, 4, 0, CASE WHEN source = 'WORMHOLE' THEN 'bridge_deposit' ELSE 'native_transfer' END, CAST(w AS VARCHAR), CAST(w + 1 AS VARCHAR), NULL, k / 1000.0 FROM tx WHERE k % 6 IN (1, 2)
  UNION ALL SELECT tx, w, 5, 0, CASE WHEN source = 'WORMHOLE' THEN 'bridge_withdrawal' ELSE 'token_transfer' END, CAST(w + 2 AS VARCHAR), CAST(w AS VARCHAR), 'mint' || (k % 8), k FROM tx WHERE k % 6 IN (2, 3)),
nl AS (SELECT * FROM lg UNION ALL SELECT tx, w, 9, 0, 'contract_interaction', CAST(w AS VARCHAR), CAST(w AS VARCHAR), NULL, 0 FROM tx WHERE k % 6 = 4),
il AS (SELECT *, CAST(row_number() OVER (PARTITION BY tx ORDER BY ord, j) - 1 AS INTEGER) AS i FROM nl)
"""


def _solana(spark: SparkSession, d: str) -> DataFrame:
    """Raw transactions of every sixth kind, and their legs."""
    e = p.table(spark, d, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int")).where("k % 6 < 5")
    k, kind, w = F.col("k"), F.col("k") % 6, _text("user_id")
    mint = F.concat(F.lit("mint"), (k % 8).cast("string"))
    token = lambda j: F.struct(w.alias("account"), mint.alias("mint"), (k + j).cast("string").alias("raw"), F.lit(2).alias("decimals"))
    raw = e.select(
        F.col("event_id").alias("tx"),
        w.alias("wallet"),
        F.expr("event_id div 3").alias("slot"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"),
        w.alias("fee_payer"),
        F.when(k % 4 == 0, "WORMHOLE").otherwise("SYSTEM").alias("source"),
        F.when(kind == 0, F.struct(w.alias("account"), (k.cast("long") * 100_000_000).alias("amount"))).alias("native_in"),
        F.lit(None).cast("struct<account:string,amount:bigint>").alias("native_out"),
        F.lit(None).cast("array<struct<account:string,mint:string,raw:string,decimals:int>>").alias("token_in"),
        F.when(kind == 0, F.array(token(0), token(1))).alias("token_out"),
        F.when(kind.isin(1, 2), F.array(F.struct(w.alias("source"), (F.col("user_id") + 1).cast("string").alias("dest"), (k.cast("long") * 1_000_000).alias("amount")))).alias("native"),
        F.when(kind.isin(2, 3), F.array(F.struct((F.col("user_id") + 2).cast("string").alias("source"), w.alias("dest"), mint.alias("mint"), _text("k").alias("amount")))).alias("tokens"),
    )
    return chains.solana_legs(raw)


@query(_SOL + "SELECT tx, i, kind, src AS source, dst AS dest, asset, CAST(amount AS DOUBLE) AS amount FROM il")
def src_normalize_solana(spark: SparkSession, d: str) -> DataFrame:
    return _solana(spark, d).select("tx", "i", "kind", "source", "dest", "asset", F.col("amount").cast("double").alias("amount"))


@query(_SOL + """SELECT 'trade' AS part, tx, CASE WHEN kind = 'swap_leg' THEN CASE WHEN dst = CAST(w AS VARCHAR) THEN 'BUY' ELSE 'SELL' END WHEN dst = CAST(w AS VARCHAR) THEN 'TRANSFER_IN' ELSE 'TRANSFER_OUT' END AS action, CAST(amount AS DOUBLE) AS amount FROM il WHERE asset IS NOT NULL AND kind IN ('swap_leg', 'token_transfer')
    QUALIFY row_number() OVER (PARTITION BY tx, asset, action ORDER BY i) = 1
  UNION ALL SELECT 'edge', tx, CASE WHEN kind LIKE 'bridge%' THEN kind ELSE 'transfer' END AS action, CAST(amount AS DOUBLE) FROM il WHERE kind NOT IN ('swap_leg', 'contract_interaction') QUALIFY row_number() OVER (PARTITION BY tx, src, dst, action ORDER BY i) = 1""")  # fmt: skip
def src_tx_ingest(spark: SparkSession, d: str) -> DataFrame:
    """What a batch of transactions leaves, given twice: natural keys make the second time harmless."""
    legs = _solana(spark, d).withColumn("given", F.explode(F.array(F.lit(1), F.lit(2)))).drop("given")
    return chains.trades_of(legs).select(F.lit("trade").alias("part"), "tx", "action", "amount").unionByName(chains.edges_of(legs).select(F.lit("edge").alias("part"), "tx", "action", "amount"))


@query(""", c AS (SELECT event_id, user_id, k FROM ev WHERE k % 3 < 2), t AS (SELECT event_id, user_id, k FROM ev WHERE k % 3 > 0)
SELECT event_id AS tx, CASE WHEN k % 4 = 0 THEN 'native_transfer' ELSE 'contract_interaction' END AS kind, '0xa' || user_id AS source, NULL AS asset, CASE WHEN k % 4 = 0 THEN CAST((k + 1) / 10.0 AS DOUBLE) ELSE 0.0 END AS amount FROM c WHERE k % 5 > 0 AND (k % 4 = 0 OR k % 4 = 1)
UNION ALL SELECT event_id, 'token_transfer', '0xa' || user_id, '0xc' || (k % 8), CASE WHEN k % 7 = 0 THEN k ELSE k / 100.0 END FROM t""")
def src_normalize_evm(spark: SparkSession, d: str) -> DataFrame:
    e = p.table(spark, d, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    k, seconds = F.col("k"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds")
    ends = [F.col("event_id").alias("tx"), F.expr("event_id div 3").alias("block"), seconds, F.concat(F.lit("0xA"), _text("user_id")).alias("source"), F.lit("0xB").alias("dest")]
    value = F.when(k % 4 == 0, F.concat((k + 1).cast("string"), F.lit("0" * 17))).otherwise("0")
    calls = e.where("k % 3 < 2").select(*ends, value.alias("value"), F.when(k % 4 == 1, "0xabcd").otherwise("0x").alias("input"), (k % 5 == 0).alias("failed"))
    moves = e.where("k % 3 > 0").select(*ends, F.concat(F.lit("0xC"), (k % 8).cast("string")).alias("contract"), F.lit("T").alias("symbol"), F.when(k % 7 == 0, "?").otherwise("2").alias("decimals"), _text("k").alias("value"))
    return chains.evm_legs(calls, moves).select("tx", "kind", "source", "asset", F.col("amount").cast("double").alias("amount"))


@query("SELECT token_id, point_id AS pair, price, liquidity FROM (SELECT *, CASE WHEN point_id % 3 = 0 THEN 'bsc' ELSE 'solana' END AS chain FROM market) WHERE chain = 'solana' QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY coalesce(liquidity, 0) DESC, price DESC, point_id) = 1")
def src_market_map(spark: SparkSession, d: str) -> DataFrame:
    """Each token's pair of one chain with most liquidity, then most volume (the price stands for it)."""
    m = p.market(spark, d).where("point_id % 3 <> 0")
    return tm.nth_by(m, ["token_id"], [F.coalesce("liquidity", F.lit(0.0)).desc(), F.desc("price"), "point_id"]).select("token_id", F.col("point_id").alias("pair"), "price", "liquidity")


@query(", s AS (SELECT signal_id, token_id, fired_at, CAST(signal_id * 37 % 101 AS DOUBLE) AS score FROM signals), l AS (SELECT token_id, arg_max(score, (fired_at, signal_id)) AS score FROM s GROUP BY 1) SELECT m.token_id, CASE WHEN coalesce(score, 0) >= 50 THEN 'hot' ELSE 'normal' END AS pass, count(*) AS points FROM market m LEFT JOIN l ON l.token_id = m.token_id GROUP BY ALL")
def src_market_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Market points by the pass that takes them: tokens with a latest score of 50 or more are hot."""
    s = p.signals(spark, d).select("token_id", "fired_at", "signal_id", (F.col("signal_id") * 37 % 101).cast("double").alias("score"))
    latest = tm.latest(s, ["token_id"], "fired_at", "signal_id").select("token_id", "score")
    m = p.market(spark, d).join(latest, "token_id", "left")
    return m.groupBy("token_id", F.when(F.coalesce("score", F.lit(0.0)) >= 50, "hot").otherwise("normal").alias("pass")).agg(F.count("*").alias("points"))


# ---- write forms: a table of earlier trades by wallet and token, and what comes later

_OLD_NEW = """,
old AS (SELECT wallet_id, token_id, min(ts) AS first_seen, max(ts) AS last_active, CAST(sum(usd) AS DOUBLE) AS usd, CASE WHEN wallet_id % 2 = 0 THEN 'watched' ELSE 'pending' END AS status FROM trades WHERE ts < TIMESTAMP '2024-01-12' GROUP BY 1, 2),
new AS (SELECT wallet_id, token_id, min(ts) AS first_seen, max(ts) AS last_active, CAST(sum(usd) AS DOUBLE) AS usd, 'new' AS status FROM trades WHERE ts >= TIMESTAMP '2024-01-12' GROUP BY 1, 2)
"""
_KEY = ["wallet_id", "token_id"]


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t, cut = p.trades(spark, d), _ntz("2024-01-12 00:00:00")

    def table(rows: DataFrame, status: Column) -> DataFrame:
        return rows.groupBy(*_KEY).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_active"), F.sum("usd").cast("double").alias("usd")).withColumn("status", status)

    return table(t.where(F.col("ts") < cut), F.when(F.col("wallet_id") % 2 == 0, "watched").otherwise("pending")), table(t.where(F.col("ts") >= cut), F.lit("new"))


@query(_OLD_NEW + "SELECT * FROM old UNION ALL SELECT * FROM new WHERE (wallet_id, token_id) NOT IN (SELECT (wallet_id, token_id) FROM old)")
def wr_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    return wr.insert_ignore(*_old_new(spark, d), _KEY)


@query(_OLD_NEW + "SELECT wallet_id, token_id, coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(n.last_active, o.last_active) AS last_active, coalesce(o.usd, n.usd) AS usd, coalesce(o.status, n.status) AS status FROM old o FULL JOIN new n USING (wallet_id, token_id)")
def wr_upsert_partial(spark: SparkSession, d: str) -> DataFrame:
    """Only the last activity is replaced; first sight, sum and status stay."""
    return wr.upsert(*_old_new(spark, d), _KEY, ["last_active"])


@query(_OLD_NEW + "SELECT wallet_id, token_id, coalesce(n.first_seen, o.first_seen) AS first_seen, coalesce(n.last_active, o.last_active) AS last_active, coalesce(n.usd, o.usd) AS usd, coalesce(n.status, o.status) AS status FROM old o FULL JOIN new n USING (wallet_id, token_id)")
def wr_upsert_result(spark: SparkSession, d: str) -> DataFrame:
    return wr.upsert(*_old_new(spark, d), _KEY, ["first_seen", "last_active", "usd", "status"])


@query("SELECT wallet_id, token_id, action, block, min(trade_id) AS trade_id FROM trades GROUP BY ALL")
def wr_unique_swallow(spark: SparkSession, d: str) -> DataFrame:
    t = p.trades(spark, d).select("wallet_id", "token_id", "action", "block", "trade_id")
    return wr.once(t, ["wallet_id", "token_id", "action", "block"], "trade_id")


_NULLS = ", o AS (SELECT CASE WHEN token_id < 6 THEN token_id END AS token_id, sum(n) AS n FROM (SELECT token_id, count(*) AS n FROM trades WHERE ts < TIMESTAMP '2024-01-12' GROUP BY 1) GROUP BY 1), n AS (SELECT CASE WHEN token_id < 6 THEN token_id END AS token_id, sum(n) AS n FROM (SELECT token_id, count(*) AS n FROM trades WHERE ts >= TIMESTAMP '2024-01-12' AND token_id <> 2 GROUP BY 1) GROUP BY 1)"


@query(_NULLS + " SELECT coalesce(o.token_id, n.token_id) AS token_id, CAST(coalesce(n.n, o.n) AS BIGINT) AS n FROM o FULL JOIN n ON o.token_id IS NOT DISTINCT FROM n.token_id")
def wr_null_key_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A key that may be null is found as any other."""
    key = F.when(F.col("token_id") < 6, F.col("token_id")).alias("token_id")
    t, cut = p.trades(spark, d), _ntz("2024-01-12 00:00:00")
    old = t.where(F.col("ts") < cut).groupBy(key).agg(F.count("*").alias("n"))
    new = t.where((F.col("ts") >= cut) & (F.col("token_id") != 2)).groupBy(key).agg(F.count("*").alias("n"))
    return wr.upsert(old, new, ["token_id"], ["n"], safe=True)


@query(_OLD_NEW + "SELECT wallet_id, token_id, usd FROM new")
def wr_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """A table written, then overwritten as a whole, and read."""
    path = shared_path(spark, "rebuilt")
    old, new = _old_new(spark, d)
    for rows in (old, new):
        rows.select("wallet_id", "token_id", "usd").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query(_OLD_NEW + "SELECT wallet_id, token_id, usd FROM old WHERE token_id NOT IN (1, 2) UNION ALL SELECT wallet_id, token_id, usd FROM new WHERE token_id IN (1, 2)")
def wr_replace_scope(spark: SparkSession, d: str) -> DataFrame:
    """Two tokens' rows are replaced, the others stay."""
    old, new = _old_new(spark, d)
    keep = ("wallet_id", "token_id", "usd")
    return wr.replace_scope(old.select(*keep), new.where("token_id in (1, 2)").select(*keep), "token_id")


@query(_OLD_NEW + "SELECT wallet_id, token_id, CASE WHEN status <> 'pending' THEN status WHEN usd >= 500 THEN 'promoted' WHEN usd < 50 THEN 'rejected' ELSE 'pending' END AS status FROM old")
def wr_status_transition(spark: SparkSession, d: str) -> DataFrame:
    """Pending rows are promoted, rejected or left; others don't move."""
    s, usd = F.col("status"), F.col("usd")
    return _old_new(spark, d)[0].select("wallet_id", "token_id", F.when(s != "pending", s).when(usd >= 500, "promoted").when(usd < 50, "rejected").otherwise("pending").alias("status"))


@query("SELECT token_id, point_id, CASE WHEN row_number() OVER (PARTITION BY token_id ORDER BY ts DESC, point_id DESC) = 1 AND token_id % 2 = 0 THEN 'rotation' ELSE 'none' END AS status FROM market")
def wr_latest_patch(spark: SparkSession, d: str) -> DataFrame:
    m = p.market(spark, d).select("token_id", "point_id", "ts", F.lit("none").alias("status"))
    patch = m.select("token_id").distinct().where("token_id % 2 = 0").withColumn("value", F.lit("rotation"))
    return wr.latest_patched(m, patch, "token_id", [F.desc("ts"), F.desc("point_id")], "status").select("token_id", "point_id", "status")


@query(", r AS (SELECT user_id AS source, event_id AS seq, event_type <> 'error' AS ok, k AS scanned FROM ev), g AS (SELECT source, max(seq) FILTER (ok) AS last FROM r GROUP BY 1) SELECT source, count(*) AS runs, count(*) FILTER (NOT ok AND (last IS NULL OR seq > last)) AS fails, CAST(sum(scanned) AS BIGINT) AS scanned FROM r JOIN g USING (source) GROUP BY 1")
def wr_counter(spark: SparkSession, d: str) -> DataFrame:
    e = p.table(spark, d, "events")
    runs = e.select(F.col("user_id").alias("source"), F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("ok"), F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("scanned"))
    return wr.counters(runs, "source")


@query(_OLD_NEW + "SELECT wallet_id, token_id, arg_max(usd, pass) AS usd, count(*) AS snapshots FROM (SELECT 1 AS pass, * FROM old UNION ALL SELECT 2, * FROM new) GROUP BY ALL")
def wr_append_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Two passes append; readers take the latest."""
    path = shared_path(spark, "snapshots")
    for n, rows in enumerate(_old_new(spark, d), 1):
        rows.select("wallet_id", "token_id", "usd", F.lit(n).alias("pass")).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy(*_KEY).agg(F.max_by("usd", "pass").alias("usd"), F.count("*").alias("snapshots"))
