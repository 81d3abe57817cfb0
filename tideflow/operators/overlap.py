"""Wallets that meet in several tokens: overlap rows and groups, traders of a token, pairs that trade together."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.sources.shared import saved

#: Pairs of trades that a block of two groups of wallets forms, trades of a group, and pairs given at once.
BLOCK_PAIRS = 1 << 23
GROUP_TRADES = 1 << 20
CHUNK = 1 << 17
#: Pairs of wallets up to which a block marks them in a table instead of sorting them.
DENSE = 1 << 25
#: Groups in a partition; a task meets those of two.
TOGETHER = 4


def bought() -> Column:
    return F.col("action") == "BUY"


def sold() -> Column:
    return F.col("action") == "SELL"


def side_sum(side: Column) -> Column:
    """Money of one side, 0 where there is none."""
    return F.coalesce(F.sum(F.when(side, F.col("usd"))), F.lit(0)).cast("double")


def overlap_wallets(trades: DataFrame, tokens: list[int], least: int) -> DataFrame:
    """wallet_id, n_tokens (distinct ones bought), buy_usd, sell_usd, pnl (null without sells), trades, first_buy."""
    g = trades.where(F.col("token_id").isin(*tokens)).groupBy("wallet_id")
    out = g.agg(F.count_distinct(F.when(bought(), F.col("token_id"))).alias("n_tokens"), side_sum(bought()).alias("buy_usd"), side_sum(sold()).alias("sell_usd"), F.count("*").alias("trades"), F.min(F.when(bought(), F.col("ts"))).alias("first_buy"))
    return out.where(F.col("n_tokens") >= least).withColumn("pnl", F.when(F.col("sell_usd") > 0, F.round(F.col("sell_usd") - F.col("buy_usd"), 4)))


def overlap_groups(trades: DataFrame, tokens: list[int]) -> DataFrame:
    """token_set, size, first_wallet: wallets that bought the same tokens, two or more. A set has at most all tokens."""
    sets = trades.where(bought() & F.col("token_id").isin(*tokens)).groupBy("wallet_id").agg(F.array_join(F.array_sort(F.collect_set("token_id")), "|").alias("token_set"))
    return sets.groupBy("token_set").agg(F.count("*").alias("size"), F.min("wallet_id").alias("first_wallet")).where("size >= 2")


def merged(local: DataFrame, other: DataFrame) -> DataFrame:
    """For each wallet the row that counts more tokens; local's on a tie."""
    both = local.withColumn("own", F.lit(1)).unionByName(other.withColumn("own", F.lit(0)))
    best = both.groupBy("wallet_id").agg(F.max_by(F.struct("n_tokens", "buy_usd", "own"), F.struct("n_tokens", "own")).alias("m"))
    return best.select("wallet_id", "m.n_tokens", "m.buy_usd", (F.col("m.own") == 1).alias("is_local"))


def cotraders(trades: DataFrame, seconds: int = 3600, least: int = 2) -> DataFrame:
    """a, b, n_tokens: pairs of wallets that traded the same token within so many seconds, in `least` tokens or more.

    Wallets are dealt into groups, and each group's trades are packed into one row, once. A block is a pair of such rows: a
    pair's meetings all lie in one block, so pairs are formed, told apart and counted where they are. Blocks come from a
    cartesian product, whose tasks read the rows of two partitions again, so what is written grows with the trades alone.
    The number of groups follows the pairs that hours and tokens can hold, so that a block forms about BLOCK_PAIRS.

    Of a wallet's trades of a token in the same stretch of `seconds` the first and the last do: they are less than `seconds`
    apart, so whoever is near one between them is near one of them, and of two stretches that overlap an end of one lies in
    the other, near both its ends.
    """
    reach = seconds * 1_000_000
    t = trades.where("token_id is not null and wallet_id is not null and ts is not null").select("token_id", F.col("wallet_id").cast("long").alias("w"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    t = t.withColumn("b", F.expr(f"us - pmod(us, {reach}L)"))
    n = F.least("n", F.lit(2.0 * trades.agg(F.approx_count_distinct("wallet_id")).first()[0]))  # at most two ends a wallet
    count, most = t.groupBy("token_id", "b").agg(F.count("*").cast("double").alias("n")).agg(F.sum(n), F.sum(n * n)).first()  # one row
    groups = max(1, math.ceil(math.sqrt(3 * (most or 0.0) / BLOCK_PAIRS)), math.ceil((count or 0.0) / GROUP_TRADES))
    parts = math.ceil(groups / min(TOGETHER, 1 + groups // 16))
    ends = t.groupBy(F.col("token_id").cast("string").alias("token"), "w", "b").agg(F.min("us").alias("since"), F.max("us").alias("until"))
    dealt = ends.withColumn("g", F.pmod(F.xxhash64("w"), F.lit(groups)).cast("int"))
    packs = dealt.groupBy("g").applyInArrow(_packed, "g int, wallets binary, tokens array<string>, ends binary, who binary, us binary")
    packs = saved(packs.repartitionById(parts, F.col("g") % parts))
    side = lambda s: packs.select([F.col(c).alias(f"{s}_{c}") for c in packs.columns])
    # Of two groups the one that is at most half a round behind the other is the left one, so that all tasks have as much to do.
    ahead = F.pmod(F.col("y_g") - F.col("x_g"), F.lit(groups)) * 2
    once = (ahead < groups) | ((ahead == groups) & (F.col("x_g") < F.col("y_g")))
    lists = side("x").join(side("y").hint("shuffle_replicate_nl"), once).mapInArrow(_block_pairs(reach, least), "w long, others array<long>, n array<int>")
    each = lists.select("w", "n", F.posexplode("others").alias("i", "other"))
    return each.select(F.least("w", "other").alias("a"), F.greatest("w", "other").alias("b"), F.get("n", "i").cast("long").alias("n_tokens"))


def _packed(key: tuple, rows: pa.Table) -> pa.Table:
    """One row of a group: its wallets in order, and by token and time the place of each trade's wallet and its time."""
    codes = rows.column("token").combine_chunks().dictionary_encode()
    token = codes.indices.to_numpy()
    wallets, who = np.unique(rows.column("w").to_numpy(), return_inverse=True)
    since, until = rows.column("since").to_numpy(), rows.column("until").to_numpy()
    two = until > since
    token, who, us = (np.concatenate([x, y[two]]) for x, y in ((token, token), (who, who), (since, until)))
    order = np.lexsort((us, token))
    ends = np.cumsum(np.bincount(token, minlength=len(codes.dictionary)))
    row = {"g": [key[0].as_py()], "wallets": [wallets.astype(np.int64).tobytes()], "tokens": [codes.dictionary.to_pylist()], "ends": [ends.astype(np.int64).tobytes()], "who": [who[order].astype(np.int32).tobytes()], "us": [us[order].astype(np.int64).tobytes()]}
    return pa.table(row, schema=pa.schema([("g", pa.int32()), ("wallets", pa.binary()), ("tokens", pa.list_(pa.string())), ("ends", pa.binary()), ("who", pa.binary()), ("us", pa.binary())]))


def _near(t: np.ndarray, u: np.ndarray, reach: int, order: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Stretches of t's places in this order, how many of u's times lie within reach of each, and their places; some CHUNK at once."""
    lo, hi = np.searchsorted(u, t - reach, "left")[order], np.searchsorted(u, t + reach, "right")[order]
    n = hi - lo
    done = np.cumsum(n)
    shift = lo - (done - n)
    at = 0
    while at < len(t):
        before = int(done[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(done, before + CHUNK, "right")))
        yield slice(at, to), n[at:to], np.arange(before, int(done[to - 1])) + np.repeat(shift[at:to], n[at:to])
        at = to


def _block_pairs(reach: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of blocks, each two groups' packed trades, rows of a wallet, those it pairs with and their numbers of tokens."""

    def unpacked(block: dict, side: str) -> tuple[np.ndarray, dict[str, slice], np.ndarray, np.ndarray]:
        ends = np.frombuffer(block[f"{side}_ends"], np.int64).tolist()
        at = {k: slice(i, j) for k, i, j in zip(block[f"{side}_tokens"], [0, *ends], ends)}
        return np.frombuffer(block[f"{side}_wallets"], np.int64), at, np.frombuffer(block[f"{side}_who"], np.int32), np.frombuffer(block[f"{side}_us"], np.int64)

    def counted(block: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of the pairs' wallets in both groups, by the first, and their numbers of tokens."""
        (wa, at_a, who_a, us_a), (wb, at_b, who_b, us_b) = unpacked(block, "x"), unpacked(block, "y")
        size, wide = len(wa) * len(wb), len(wb)
        both = [k for k in at_a if k in at_b]
        dense = size <= DENSE
        met, counts = np.zeros(size if dense else 0, bool), np.zeros(size if dense else 0, np.uint8 if len(both) < 256 else np.int32)
        found = []
        for k in both:
            ia, ib = who_a[at_a[k]].astype(np.int64) * wide, who_b[at_b[k]].astype(np.int64)
            # By wallet, so that marks of neighbours lie near each other.
            order = np.argsort(who_a[at_a[k]], kind="stable")
            ia = ia[order]
            near = (np.repeat(ia[some], n) + ib[j] for some, n, j in _near(us_a[at_a[k]], us_b[at_b[k]], reach, order))
            if dense:
                for code in near:
                    met[code] = True
                counts += met
                met[:] = False
            elif codes := [np.unique(code) for code in near]:
                found.append(np.unique(np.concatenate(codes)))
        if dense:
            for begin in range(0, len(wa), max(1, CHUNK // max(1, wide))):
                part = counts[begin * wide : (begin + max(1, CHUNK // wide)) * wide].reshape(-1, wide)
                keep = part >= least
                i = np.repeat(np.arange(len(part)), np.count_nonzero(keep, axis=1))
                keys = np.flatnonzero(keep)
                yield i + begin, keys - i * wide, part.ravel()[keys]
        elif found:
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            keys, n = keys[n >= least], n[n >= least]
            for begin in range(0, len(keys), CHUNK):
                part = keys[begin : begin + CHUNK]
                yield part // wide, part % wide, n[begin : begin + CHUNK]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                wa, wb = (np.frombuffer(block[c], np.int64) for c in ("x_wallets", "y_wallets"))
                same = block["x_g"] == block["y_g"]
                for i, j, n in counted(block):
                    if same:  # meetings are found from both sides
                        one = i < j
                        i, j, n = i[one], j[one], n[one]
                    first = np.flatnonzero(np.diff(i, prepend=-1))
                    ends = pa.array(np.append(first, len(i)).astype(np.int32))
                    yield pa.record_batch([pa.array(wa[i[first]]), pa.ListArray.from_arrays(ends, pa.array(wb[j])), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))], names=["w", "others", "n"])

    return pairs


def early_buyers(trades: DataFrame, hours: int = 24, least: int = 2) -> DataFrame:
    """wallet_id, n_tokens: wallets that bought within so many hours of a token's first trade, in `least` tokens or more."""
    launch = trades.groupBy("token_id").agg(F.min("ts").alias("launch"))  # one row a token
    early = trades.where(bought()).join(launch, "token_id").where(F.col("ts") <= F.col("launch") + F.expr(f"INTERVAL {hours} HOURS"))
    return early.groupBy("wallet_id").agg(F.count_distinct("token_id").alias("n_tokens")).where(F.col("n_tokens") >= least)
