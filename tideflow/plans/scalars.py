"""Queries over the scalar functions: each applied to whole tables, beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.functions import scalar as sc
from tideflow.operators import social
from tideflow.plans.registry import query
from tideflow.sources import projection as p

NOW = "2024-02-01 00:00:00"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, user_id, ts, event_type, k, v (value as a double), d (value less 250: of either sign)."""
    e = p.table(spark, d, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    return e.select("event_id", "user_id", "ts", "event_type", "k", "props", F.col("value").alias("v"), (F.col("value") - 250).alias("d"))


_E = """,
e AS (SELECT event_id, user_id, ts, event_type, k, props, value AS v, value - 250 AS d FROM ev)
"""


def _each(spark: SparkSession, d: str, **columns: Column) -> DataFrame:
    return _events(spark, d).select("event_id", *[c.alias(k) for k, c in columns.items()])


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


# ---- numbers


@query(_E + "SELECT event_id, least(greatest(v / 100, 0.0), 1.0) AS unit, least(greatest(d, -50.0), 50.0) AS near FROM e")
def fn_clamp(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, unit=sc.clamp(F.col("v") / 100), near=sc.clamp(F.col("d"), -50.0, 50.0))


@query(_E + "SELECT event_id, floor(d * 10 + 0.5) / 10 AS x FROM e")
def fn_round1(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, x=sc.round1(F.col("d")))


@query(_E + "SELECT event_id, CAST(floor(d + 0.5) AS BIGINT) AS x FROM e")
def fn_round_int(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, x=sc.round_int(F.col("d")).cast("long"))


@query(_E + "SELECT event_id, round(least(greatest(16 + sqrt(v / 600) * 44, 16.0), 60.0), 9) AS size, round(CASE WHEN d <= 0 THEN 1.0 ELSE least(greatest(log10(d), 1.0), 8.0) END, 9) AS width FROM e")
def fn_graph_scale(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, size=F.round(sc.node_size(F.col("v"), F.lit(600.0)), 9), width=F.round(sc.edge_width(F.col("d")), 9))


@query(_E + "SELECT event_id, CAST(ceil(k / 2) AS BIGINT) AS half FROM e")
def fn_ceil(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, half=F.ceil(F.col("k") / 2))


@query(_E + "SELECT event_id, CASE WHEN k % 3 > 0 THEN v / (k % 3) END AS or_null, CASE WHEN d > 0 THEN v / d ELSE 999 END AS or_mark FROM e")
def fn_safe_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, or_null=sc.safe_ratio(F.col("v"), F.col("k") % 3), or_mark=sc.safe_ratio(F.col("v"), F.col("d"), 999.0))


@query(_E + "SELECT event_id, CASE WHEN greatest(v, k) > 0 THEN least(v, k) / greatest(v, k) ELSE 0.0 END AS alike FROM e")
def fn_min_max_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, alike=sc.min_max_ratio(F.col("v"), F.col("k").cast("double")))


@query(_E + ", x AS (SELECT event_id, CASE k % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'infinity'::DOUBLE WHEN 2 THEN NULL ELSE d END AS x FROM e) SELECT event_id, coalesce(NOT isnan(x) AND NOT isinf(x) AND x > 0, false) AS fine FROM x")
def fn_finite_positive(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("k") % 5 == 0, F.lit(float("nan"))).when(F.col("k") % 5 == 1, F.lit(float("inf"))).when(F.col("k") % 5 > 2, F.col("d"))
    return _each(spark, d, fine=sc.finite_positive(x))


# ---- times


@query(_E + f"SELECT event_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0 AS days FROM e")
def fn_age_days(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, days=sc.days_between(F.col("ts"), _now()))


@query(_E + f"SELECT event_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 60000000.0 AS minutes FROM e")
def fn_minutes_between(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, minutes=sc.minutes_between(F.col("ts"), _now()))


@query(_E + "SELECT event_id, year(ts) || '-' || month(ts) || '-' || day(ts) || '-' || hour(ts) AS hour FROM e")
def fn_hour_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, hour=sc.hour_bucket(F.col("ts")))


@query(_E + "SELECT event_id, make_timestamp((1700000000 + event_id * 61) * 1000000) AS ts FROM e")
def fn_epoch_to_ts(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, ts=F.timestamp_seconds(1700000000 + F.col("event_id") * 61).cast("timestamp_ntz"))


@query(_E + """, s AS (SELECT event_id, CAST(event_id * event_id * 7 % 400000 AS BIGINT) AS s FROM e)
SELECT event_id, CASE WHEN s < 1 THEN 'just now' WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS age FROM s""")  # fmt: skip
def fn_format_age(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, age=sc.age(F.col("event_id") * F.col("event_id") * 7 % 400000))


@query(_E + "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' AS minute FROM e")
def fn_iso_minute(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, minute=sc.iso_minute(F.col("ts")))


@query(_E + "SELECT event_id, epoch_us(TIMESTAMP '2024-01-28') >= epoch_us(ts) + CAST(1440 AS BIGINT) * 60000000 AS elapsed FROM e")
def fn_horizon_elapsed(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, elapsed=sc.horizon_elapsed(F.col("ts"), 1440, F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")))


@query(_E + "SELECT user_id, count(DISTINCT date_trunc('day', ts)) AS active_days FROM e GROUP BY 1")
def fn_date_trunc_day(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("user_id").agg(F.count_distinct(F.date_trunc("day", "ts")).alias("active_days"))


# ---- texts

_FIXED1 = "CAST(floor({x} * 10 + 0.5) AS BIGINT) // 10 || '.' || CAST(floor({x} * 10 + 0.5) AS BIGINT) % 10"
_FIXED = "CAST(floor({x} * {m} + 0.5) AS BIGINT) // {m} || '.' || lpad(CAST(CAST(floor({x} * {m} + 0.5) AS BIGINT) % {m} AS VARCHAR), {n}, '0')"


@query(_E + f""", x AS (SELECT event_id, d * pow(10, k % 9 - 3) AS x, abs(d * pow(10, k % 9 - 3)) AS a FROM e)
SELECT event_id, CASE WHEN a = 0 THEN '$0.00' ELSE CASE WHEN x < 0 THEN '-' ELSE '' END || '$' || CASE WHEN a >= 1e9 THEN {_FIXED1.format(x="(a / 1e9)")} || 'B' WHEN a >= 1e6 THEN {_FIXED1.format(x="(a / 1e6)")} || 'M' WHEN a >= 1e3 THEN {_FIXED1.format(x="(a / 1e3)")} || 'k'
  WHEN a >= 1 THEN {_FIXED.format(x="a", m=100, n=2)} WHEN a >= 0.00005 THEN {_FIXED.format(x="a", m=10000, n=4)} ELSE {_FIXED.format(x="a", m=1000000, n=6)} END END AS usd FROM x""")
def fn_fmt_usd(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, usd=sc.fmt_usd(F.col("d") * F.pow(F.lit(10.0), F.col("k") % 9 - 3)))


@query(_E + f"SELECT event_id, CASE WHEN d < 0 THEN '-' ELSE '+' END || {_FIXED1.format(x='abs(d)')} || '%' AS pct FROM e")
def fn_fmt_pct(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, pct=sc.fmt_pct(F.col("d")))


@query(_E + "SELECT event_id, CASE WHEN length(s) <= 10 THEN s ELSE left(s, 4) || '…' || right(s, 4) END AS id FROM (SELECT event_id, event_type || repeat('x', k % 3) || event_id AS s FROM e)")
def fn_short_id(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, id=sc.short_id(F.concat("event_type", F.repeat(F.lit("x"), F.col("k") % 3), F.col("event_id").cast("string"))))


_HTML = "'<b>' || event_type || '</b> & \"' || k || '\", ' || chr(10) || 'x'"


def _html() -> Column:
    return F.concat(F.lit("<b>"), "event_type", F.lit('</b> & "'), F.col("k").cast("string"), F.lit('", \nx'))


@query(_E + f"SELECT event_id, replace(replace(replace({_HTML}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM e")
def fn_escape_html(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, html=sc.escape_html(_html()))


@query(_E + "SELECT event_id, replace('https://x.test/{address}/of/{address}', '{address}', CAST(user_id AS VARCHAR)) AS url FROM e")
def fn_fill_template(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, url=sc.fill_template(F.lit("https://x.test/{address}/of/{address}"), F.col("user_id").cast("string")))


@query(_E + f"SELECT event_id, CASE WHEN regexp_matches(s, '[,\"\\r\\n]') THEN '\"' || replace(s, '\"', '\"\"') || '\"' ELSE s END AS cell FROM (SELECT event_id, CASE WHEN k % 2 = 0 THEN {_HTML} ELSE event_type END AS s FROM e)")
def fn_csv_escape(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, cell=sc.csv_escape(F.when(F.col("k") % 2 == 0, _html()).otherwise(F.col("event_type"))))





@query(""",
s AS (SELECT post_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(content), 'https?://\\S+', ' ', 'g'), '@\\w+', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), 1, 280) AS s FROM posts),
u AS (SELECT DISTINCT s FROM s), c AS (SELECT s, list_transform(list_filter(string_split(s, ''), lambda x: x <> ''), lambda x: CAST(ascii(x) AS BIGINT)) AS c FROM u),
h AS (SELECT s, list_reduce(list_prepend(3735928559::BIGINT, c), lambda h, x: CAST((xor(h, x)::HUGEINT * 2654435761) % 4294967296 AS BIGINT)) AS a, list_reduce(list_prepend(1103547991::BIGINT, c), lambda h, x: CAST((xor(h, x)::HUGEINT * 1597334677) % 4294967296 AS BIGINT)) AS b FROM c),
i AS (SELECT s, b, xor(CAST((xor(a, a >> 16)::HUGEINT * 2246822507) % 4294967296 AS BIGINT), CAST((xor(b, b >> 13)::HUGEINT * 3266489909) % 4294967296 AS BIGINT)) AS a FROM h),
j AS (SELECT s, a, xor(CAST((xor(b, b >> 16)::HUGEINT * 2246822507) % 4294967296 AS BIGINT), CAST((xor(a, a >> 13)::HUGEINT * 3266489909) % 4294967296 AS BIGINT)) AS b FROM i)
SELECT post_id, lower(to_base(4294967296 * (b & 2097151) + a, 36)) AS hash FROM s JOIN j USING (s)""")  # fmt: skip
def fn_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return p.posts(spark, d).select("post_id", sc.content_hash(social.snippet(F.col("content"))).alias("hash"))


_TAGS = "CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN ' a | b||' || event_type WHEN 2 THEN '' ELSE event_type || '|x' END"


def _tags() -> Column:
    k = F.col("k") % 4
    return F.when(k == 1, F.concat(F.lit(" a | b||"), "event_type")).when(k == 2, "").when(k == 3, F.concat("event_type", F.lit("|x")))


@query(_E + f"SELECT event_id, array_to_string(list_filter(list_transform(string_split(coalesce({_TAGS}, ''), '|'), lambda t: trim(t)), lambda t: t <> ''), '/') AS tags FROM e")
def fn_split_tags(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, tags=F.array_join(sc.split_tags(_tags()), "/"))


@query(_E + """, n AS (SELECT event_id, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'first' || chr(10) || 'source: ' || event_type ELSE 'other' END AS notes, CASE WHEN k % 7 > 0 THEN 'source: ' || event_type END AS line FROM e),
l AS (SELECT *, list_filter(string_split(coalesce(notes, ''), chr(10)), lambda t: t <> '') AS ls FROM n) SELECT event_id, CASE WHEN line IS NULL OR list_contains(ls, line) THEN notes ELSE array_to_string(list_append(ls, line), chr(10)) END AS notes FROM l""")
def fn_note_append(spark: SparkSession, d: str) -> DataFrame:
    k, line = F.col("k"), F.concat(F.lit("source: "), "event_type")
    notes = F.when(k % 3 == 1, F.concat(F.lit("first\n"), line)).when(k % 3 == 2, "other")
    return _each(spark, d, notes=sc.note_append(notes, F.when(k % 7 > 0, line)))


@query(_E + "SELECT event_id, list_contains(list_transform(string_split(coalesce(CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'late, window_incomplete' ELSE 'window_incomplete_not' END, ''), ','), lambda t: trim(t)), 'window_incomplete') AS has FROM e")
def fn_has_note(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k") % 3
    return _each(spark, d, has=sc.has_note(F.when(k == 1, "late, window_incomplete").when(k == 2, "window_incomplete_not"), "window_incomplete"))


@query(_E + "SELECT event_id, event_id || '::' || k AS mention_key, 'local:risk:' || user_id || ':' || year(ts) || '-' || month(ts) || '-' || day(ts) || '-' || hour(ts) AS snapshot_key FROM e")
def fn_dedupe_key(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, mention_key=F.concat_ws("::", F.col("event_id").cast("string"), F.col("k").cast("string")), snapshot_key=F.concat_ws(":", F.lit("local"), F.lit("risk"), F.col("user_id").cast("string"), sc.hour_bucket(F.col("ts"))))


def _mentions(spark: SparkSession, d: str, kind: str) -> DataFrame:
    m = social.mentions(p.posts(spark, d)).where(F.col("kind") == kind)
    return m.select("post_id", "token", "confidence")


# The address alphabet and link hosts are fixed values.
@query("SELECT post_id, unnest(list_distinct(regexp_extract_all(content, '(?i:https?://(?:www\\.)?(?:dexscreener\\.com/solana/|birdeye\\.so/token/|solscan\\.io/token/|jup\\.ag/(?:tokens|swap)/[A-Za-z0-9]*-?|pump\\.fun/(?:coin/)?))([1-9A-HJ-NP-Za-km-z]{32,44})', 1))) AS token, 85 AS confidence FROM posts".replace("|jup\\.ag/(?:tokens|swap)/[A-Za-z0-9]*-?", ""))
def fn_extract_url(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d, "url")


@query("SELECT post_id, unnest(list_distinct(regexp_extract_all(regexp_replace(content, '(?i)\\bhttps?://\\S+', ' ', 'g'), '[1-9A-HJ-NP-Za-km-z]{32,44}'))) AS token, 90 AS confidence FROM posts")
def fn_extract_address(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d, "address")


@query("SELECT post_id, unnest(list_distinct(list_transform(regexp_extract_all(content, '\\$([A-Za-z][A-Za-z0-9]{1,9})\\b', 1), lambda t: upper(t)))) AS token, 40 AS confidence FROM posts")
def fn_extract_cashtag(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d, "ticker")


@query("SELECT post_id, length(regexp_replace(lower(content), '[^a-z0-9]', '', 'g')) AS n FROM posts")
def fn_alnum_length(spark: SparkSession, d: str) -> DataFrame:
    return p.posts(spark, d).select("post_id", sc.alnum_length(F.lower("content")).cast("long").alias("n"))


@query(_E + "SELECT event_id, lower('0xAB' || upper(event_type) || k) AS address FROM e")
def fn_address_lower(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, address=F.lower(F.concat(F.lit("0xAB"), F.upper("event_type"), F.col("k").cast("string"))))


_ADDRESSES = """, a AS (SELECT event_id, CASE WHEN k % 2 = 0 THEN 'SOLANA' ELSE 'BSC' END AS chain, CASE k % 6 WHEN 0 THEN 'So1anaToken' || repeat(CAST(k % 9 + 1 AS VARCHAR), 24) WHEN 1 THEN '0x' || repeat('a1', 20) WHEN 2 THEN repeat('O0', 20) WHEN 3 THEN '0x' || repeat('A1', 20) WHEN 4 THEN 'short' ELSE repeat('z', 45) END AS address FROM e)"""


@query(_E + _ADDRESSES + "SELECT event_id, CASE WHEN chain = 'SOLANA' THEN regexp_matches(address, '^[1-9A-HJ-NP-Za-km-z]{32,44}$') ELSE regexp_matches(address, '^0x[0-9a-f]{40}$') END AS valid FROM a")
def flt_address_valid(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k") % 6
    chain = F.when(F.col("k") % 2 == 0, "SOLANA").otherwise("BSC")
    address = F.when(k == 0, F.concat(F.lit("So1anaToken"), F.repeat((F.col("k") % 9 + 1).cast("string"), 24))).when(k == 1, "0x" + "a1" * 20).when(k == 2, "O0" * 20).when(k == 3, "0x" + "A1" * 20).when(k == 4, "short").otherwise("z" * 45)
    return _each(spark, d, valid=sc.address_valid(address, chain))


# ---- arrays and JSON


@query("SELECT wallet_id, list_contains(labels, 'sniper') AS sniper, list_has_any(labels, ['human_like', 'smart_money']) AS offset_ FROM wallets")
def fn_array_contains(spark: SparkSession, d: str) -> DataFrame:
    return p.wallets(spark, d).select("wallet_id", F.array_contains("labels", "sniper").alias("sniper"), F.arrays_overlap("labels", F.array(F.lit("human_like"), F.lit("smart_money"))).alias("offset_"))


@query("SELECT wallet_id, array_to_string(list_slice(list_distinct_in_order, 1, 3), ',') AS first FROM (SELECT wallet_id, list(token_id ORDER BY f) AS list_distinct_in_order FROM (SELECT wallet_id, token_id, min((ts, trade_id)) AS f FROM trades GROUP BY ALL) GROUP BY 1)")
def fn_array_slice_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Each wallet's first three tokens in order of arrival: reduced to one row a token before they are listed."""
    one = p.trades(spark, d).groupBy("wallet_id", "token_id").agg(F.min(F.struct("ts", "trade_id")).alias("f"))
    listed = one.groupBy("wallet_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "token_id"))), lambda x: x["token_id"].cast("string")).alias("x"))
    return listed.select("wallet_id", F.array_join(sc.first_distinct(F.col("x"), 3), ",").alias("first"))


@query("SELECT wallet_id, string_agg(token_id, '|' ORDER BY token_id) AS token_set FROM (SELECT DISTINCT wallet_id, CAST(token_id AS VARCHAR) AS token_id FROM trades WHERE action = 'BUY') GROUP BY 1")
def fn_array_sort_join(spark: SparkSession, d: str) -> DataFrame:
    return p.trades(spark, d).where("action = 'BUY'").groupBy("wallet_id").agg(F.collect_set(F.col("token_id").cast("string")).alias("x")).select("wallet_id", sc.sort_join(F.col("x")).alias("token_set"))


@query("SELECT edge_id, unnest([src, dst]) AS address FROM edges")
def fn_flatmap(spark: SparkSession, d: str) -> DataFrame:
    return p.edges(spark, d).select("edge_id", F.explode(F.array("src", "dst")).alias("address"))


@query("SELECT token_id, block, count(*) AS buyers FROM (SELECT DISTINCT token_id, block, wallet_id FROM trades WHERE action = 'BUY') GROUP BY ALL")
def fn_map_counts(spark: SparkSession, d: str) -> DataFrame:
    return p.trades(spark, d).where("action = 'BUY'").select("token_id", "block", "wallet_id").distinct().groupBy("token_id", "block").agg(F.count("*").alias("buyers"))


_METRIC = """, m AS (SELECT event_id, CASE k % 6 WHEN 0 THEN '{"x": ' || k || '}' WHEN 1 THEN '{"x": "' || k || '"}' WHEN 2 THEN '{"x": true}' WHEN 3 THEN '{"y": 1}' WHEN 4 THEN '{"x": ' || k || '.5}' ELSE '{"x": [1]}' END AS m FROM e),
g AS (SELECT event_id, m, CASE WHEN json_type(m, '$.x') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN json_type(m, '$.x') = 'VARCHAR' THEN 'string' WHEN json_type(m, '$.x') = 'BOOLEAN' THEN 'boolean' WHEN json_type(m, '$.x') IS NULL THEN NULL ELSE 'other' END AS kind FROM m)
"""


def _metric() -> Column:
    k, n = F.col("k") % 6, F.col("k").cast("string")
    return F.when(k == 0, F.concat(F.lit('{"x": '), n, F.lit("}"))).when(k == 1, F.concat(F.lit('{"x": "'), n, F.lit('"}'))).when(k == 2, '{"x": true}').when(k == 3, '{"y": 1}').when(k == 4, F.concat(F.lit('{"x": '), n, F.lit(".5}"))).otherwise('{"x": [1]}')


@query(_E + _METRIC + "SELECT event_id, CASE WHEN kind = 'number' THEN CAST(json_extract_string(m, '$.x') AS DOUBLE) ELSE -1.0 END AS x FROM g")
def fn_json_path(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, x=sc.json_number(_metric(), "$.x", -1.0))


@query(_E + _METRIC + "SELECT event_id, kind FROM g")
def fn_type_guard(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, kind=sc.json_kind(_metric(), "$.x"))


@query(_E + """, m AS (SELECT event_id, json_merge_patch('{"rules": {"A": {"n": 20, "on": true}, "B": {"n": 4}}, "name": "x"}', '{"rules": {"' || CASE WHEN k % 2 = 0 THEN 'A' ELSE 'C' END || '": {"n": ' || k || '}}}') AS j FROM e)
SELECT event_id, path, json_extract_string(j, '$.' || path) AS value FROM m, (SELECT unnest(['rules.A.n', 'rules.A.on', 'rules.B.n', 'rules.C.n', 'name']) AS path) WHERE json_extract_string(j, '$.' || path) IS NOT NULL""")
def fn_deep_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each event's overrides merged into the base settings, by leaf: a leaf of the override stands for the base's."""
    base = F.from_json(F.lit('{"rules.A.n": "20", "rules.A.on": "true", "rules.B.n": "4", "name": "x"}'), "map<string,string>")
    name = F.concat(F.lit("rules."), F.when(F.col("k") % 2 == 0, "A").otherwise("C"), F.lit(".n"))
    merged = sc.merged_leaves(base, F.create_map(name, F.col("k").cast("string")))
    return _each(spark, d, m=merged).select("event_id", F.explode("m").alias("path", "value"))


# ---- bands


@query(_E + "SELECT event_id, CASE WHEN k <= 30 THEN 'weak' WHEN k <= 60 THEN 'possible' WHEN k <= 80 THEN 'probable' ELSE 'strong' END AS band FROM e")
def fn_band(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, band=sc.link_band(F.col("k")))


@query(_E + "SELECT event_id, CASE WHEN k < 1 THEN NULL WHEN k <= 4 THEN '1-4' WHEN k <= 14 THEN '5-14' ELSE '15+' END AS entities, CASE WHEN k % 11 = 0 THEN 'unknown' WHEN v * 10000 < 100000 THEN '<100k' WHEN v * 10000 < 1000000 THEN '100k-1M' WHEN v * 10000 < 5000000 THEN '1M-5M' ELSE '>5M' END AS mcap FROM e")
def fn_bucket(spark: SparkSession, d: str) -> DataFrame:
    from tideflow.operators.outcomes import mcap_bucket

    return _each(spark, d, entities=sc.entity_bucket(F.col("k")), mcap=mcap_bucket(F.when(F.col("k") % 11 != 0, F.col("v") * 10000)))


@query(_E + "SELECT event_id, CASE WHEN k % 7 = 0 THEN 'unknown' WHEN k / 100 >= 0.66::DOUBLE THEN 'high' WHEN k / 100 >= 0.33::DOUBLE THEN 'medium' ELSE 'low' END AS band FROM e")
def fn_concentration_band(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, band=sc.concentration_band(F.when(F.col("k") % 7 != 0, F.col("k") / 100)))
