"""Token mentions in posts, spam scores, mention velocity, and liquidity risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideflow.operators.temporal import running

#: The address alphabet and the hosts whose links hold an address.
ADDRESS = "[1-9A-HJ-NP-Za-km-z]{32,44}"
LINKS = r"(?i:https?://(?:www\.)?(?:dexscreener\.com/solana/|birdeye\.so/token/|solscan\.io/token/|jup\.ag/(?:tokens|swap)/(?:[A-Za-z0-9]+-)?|pump\.fun/(?:coin/)?))"
CASHTAG = r"\$([A-Za-z][A-Za-z0-9]{1,9})\b"
CONFIDENCE = {"address": 90, "url": 85, "ticker": 40}
VELOCITY_MINUTES = (60, 360, 1440)


def mentions(posts: DataFrame) -> DataFrame:
    """post_id, kind, token, confidence: each token once a post, its link before its bare address; and each cashtag once."""
    text = F.col("content")
    linked = F.array_distinct(F.regexp_extract_all(text, F.lit(f"{LINKS}({ADDRESS})"), F.lit(1)))
    bare = F.array_distinct(F.filter(F.regexp_extract_all(F.regexp_replace(text, r"(?i)\bhttps?://\S+", " "), F.lit(f"({ADDRESS})"), F.lit(1)), lambda a: a.rlike("[1-9]")))
    tags = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CASHTAG), F.lit(1)), F.upper))

    def named(tokens: Column, kind: str) -> Column:
        return F.transform(tokens, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token"), F.lit(CONFIDENCE[kind]).alias("confidence")))

    every = F.concat(named(linked, "url"), named(F.array_except(bare, linked), "address"), named(tags, "ticker"))
    return posts.where(text.isNotNull()).select("post_id", "author", "posted_at", F.explode(every).alias("m")).select("post_id", "author", "posted_at", "m.kind", "m.token", "m.confidence")


def snippet(text: Column) -> Column:
    """Lower case without links, mentions and punctuation, spaces collapsed, 280 characters at most."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"https?://\S+", " "), r"@\w+", " ")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9 ]", " "), " +", " ")), 1, 280)


def _authors(posts: DataFrame, micros: int) -> DataFrame:
    """s, t, n: where the number of authors seen with a text within so many microseconds changes, and by how much.

    An author counts from a post on for that long. Posts of one author and text in one pane of that width are one visit with
    a first and a last time, and visits that touch are one, so an author never counts twice.
    """
    pane = F.col("t") - F.pmod("t", F.lit(micros))
    seen = posts.where("author is not null and t is not null").groupBy("s", "author", pane.alias("pane")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    by = Window.partitionBy("s", "author").orderBy("pane")
    seen = seen.select("s", "first", "last", F.lag("last").over(by).alias("before"), F.lead("first").over(by).alias("next"))
    come = seen.where(F.col("before").isNull() | (F.col("first") - F.col("before") > micros)).select("s", F.col("first").alias("t"), F.lit(1).cast("long").alias("n"))
    go = seen.where(F.col("next").isNull() | (F.col("next") - F.col("last") > micros)).select("s", (F.col("last") + micros + 1).alias("t"), F.lit(-1).cast("long").alias("n"))
    return come.unionByName(go)


def spam(posts: DataFrame, minutes: int = 360, authors: int = 3, repeats: int = 5, least: int = 12) -> DataFrame:
    """post_id, spam_score, spam_reason: copied texts, authors that repeat, or little content, within the minutes before.

    Both counts are running sums of changes, one as an author or post enters the minutes and one as it leaves them, dealt
    out by time, so that neither a common text nor a busy author is one task's work. Posts of one time see each other; posts
    without an author count for no author; posts without a time are seen by none and see none.
    """
    micros = minutes * 60_000_000
    p = posts.select("post_id", "author", snippet(F.col("content")).alias("s"), F.unix_micros(F.col("posted_at").cast("timestamp")).alias("t"))
    signed = p.where("author is not null and t is not null")
    told = signed.select("author", "t", F.lit(1).cast("long").alias("b")).unionByName(signed.select("author", (F.col("t") + micros + 1).alias("t"), F.lit(-1).cast("long").alias("b")))
    counted = running(told, running(_authors(p, micros), p, ["s"], "t", "n"), ["author"], "t", "b")
    n, posts_by, short = F.col("n"), F.col("b"), F.length(F.regexp_replace("s", "[^a-z0-9]", "")) < least
    reason = F.when(n >= authors, "copypasta").when(posts_by >= repeats, "repeat_author").when(short, "low_content")
    score = F.when(n >= authors, 80).when(posts_by >= repeats, 60).when(short, 50).otherwise(0)
    return counted.select("post_id", score.alias("spam_score"), reason.alias("spam_reason"))


def ingest(posts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Mentions by their natural key, with the spam score of their post and the token that an address stands for.

    posts: post_id, source, author, content, posted_at; a post that comes twice leaves its mentions once. tokens: address,
    token_id, unique by address. Only posts with a mention are looked back at; a mention of an unknown address or of a ticker
    stays, without a token. Posts with spam stay, too, with their score.
    """
    p = posts.dropDuplicates(["post_id"])
    found = mentions(p)
    with_any = p.join(found.select("post_id").distinct(), "post_id", "left_semi")
    # Both sides by address; the tokens are a dimension that AQE may broadcast by its measured size.
    linked = found.join(tokens.select(F.col("address").alias("token"), "token_id"), "token", "left")
    key = F.concat_ws("::", F.col("post_id").cast("string"), F.when(F.col("kind") == "ticker", F.concat(F.lit("$"), "token")).otherwise(F.col("token")))
    return linked.join(with_any.select("post_id", "source"), "post_id").join(spam(with_any), "post_id").select("source", key.alias("dedupe_key"), "post_id", "kind", "token", "token_id", "confidence", "spam_score", "spam_reason")


def velocity(found: DataFrame, now: str) -> DataFrame:
    """token, posts and distinct authors in nested windows that end at now, and the short rate by the long rate."""
    out = []
    for m in VELOCITY_MINUTES:
        inside = F.expr(f"posted_at between TIMESTAMP_NTZ '{now}' - INTERVAL {m} MINUTES and TIMESTAMP_NTZ '{now}'")
        out += [F.count_if(inside).alias(f"n_{m}"), F.count_distinct(F.when(inside, F.col("author"))).alias(f"authors_{m}")]
    short, long = VELOCITY_MINUTES[0], VELOCITY_MINUTES[-1]
    accel = F.when(F.col(f"n_{long}") > 0, (F.col(f"n_{short}") / short) / (F.col(f"n_{long}") / long)).otherwise(0.0)
    return found.groupBy("token").agg(*out).withColumn("accel", F.round(accel, 6))


def liquidity_risk(rows: DataFrame, position: float = 1000.0) -> DataFrame:
    """Ratio, float, overhang, slippage and depth estimates with bands; null where market data is missing or not positive."""
    liquid, cap = F.when(F.col("liquidity") > 0, F.col("liquidity")), F.when(F.col("mcap") > 0, F.col("mcap"))
    r = liquid / cap
    return rows.select(
        "token_id",
        F.round(r, 8).alias("ratio"),
        F.round(r / 2, 8).alias("float_fraction"),
        F.round(2 / r - 1, 6).alias("overhang"),
        F.round(200 * position / liquid, 6).alias("slippage_pct"),
        F.round(0.207 * liquid, 6).alias("dump_to_halve"),
        F.round(0.01 * liquid, 6).alias("size_for_2pct"),
        F.when(liquid.isNull(), "unknown").when(liquid < 10_000, "critical").when(liquid < 50_000, "low").when(liquid < 250_000, "medium").otherwise("high").alias("liquidity_band"),
        F.when(r.isNull(), "unknown").when(r < 0.02, "critical").when(r < 0.05, "fragile").when(r < 0.15, "moderate").otherwise("healthy").alias("ratio_band"),
        F.when(r.isNull(), "low").otherwise("medium").alias("confidence"),
        F.concat_ws("; ", F.when(liquid.isNull(), "no liquidity"), F.when(cap.isNull(), "no market cap"), F.when(r > 1, "liquidity above market cap")).alias("caveats"),
    )
