"""Raw chain transactions as legs, and legs as trades and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.functions import scalar as sc

LEG = "struct<kind:string,source:string,dest:string,asset:string,symbol:string,amount:string>"
# Native units.
SOL_DECIMALS, EVM_DECIMALS = 9, 18


def leg(kind: Column | str, source: Column, dest: Column, asset: Column, symbol: Column, amount: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), source.alias("source"), dest.alias("dest"), asset.cast("string").alias("asset"), symbol.alias("symbol"), amount.alias("amount"))


def solana_legs(txs: DataFrame) -> DataFrame:
    """tx, wallet, slot, ts, i, and the leg's columns: swaps, then native and token transfers; one contract leg if there are none.

    txs has tx, wallet, slot, seconds, fee_payer, source, native_in and native_out (account, amount), token_in and token_out
    (arrays of account, mint, raw, decimals), native (array of source, dest, amount) and tokens (array of source, dest, mint, amount).
    A transfer of a bridge's transaction is a deposit if it leaves the wallet, a withdrawal if it reaches it.
    """
    none, empty = F.lit(None).cast("string"), F.lit("")
    lamports = lambda x: sc.decimal_shift(x.cast("string"), F.lit(SOL_DECIMALS))

    def moved(source: Column, dest: Column, other: str) -> Column:
        bridge = F.col("source") == "WORMHOLE"
        return F.when(bridge & (source == F.col("wallet")), "bridge_deposit").when(bridge & (dest == F.col("wallet")), "bridge_withdrawal").otherwise(other)

    def side(account: str, given: bool) -> Column:
        a = F.col(account)
        return F.when(a.isNotNull(), F.array(leg("swap_leg", a["account"] if given else empty, empty if given else a["account"], none, F.lit("SOL"), lamports(a["amount"]))))

    def tokens(column: str, given: bool) -> Column:
        return F.transform(column, lambda t: leg("swap_leg", t["account"] if given else empty, empty if given else t["account"], t["mint"], F.left(t["mint"], F.lit(4)), sc.decimal_shift(t["raw"], t["decimals"])))

    native = F.transform("native", lambda t: leg(moved(t["source"], t["dest"], "native_transfer"), t["source"], t["dest"], none, F.lit("SOL"), lamports(t["amount"])))
    token = F.transform("tokens", lambda t: leg(moved(t["source"], t["dest"], "token_transfer"), t["source"], t["dest"], t["mint"], F.left(t["mint"], F.lit(4)), t["amount"]))
    parts = [side("native_in", True), tokens("token_in", True), side("native_out", False), tokens("token_out", False), native, token]
    every = F.flatten(F.array(*[F.coalesce(x, F.array().cast(f"array<{LEG}>")).cast(f"array<{LEG}>") for x in parts]))
    contract = F.array(leg("contract_interaction", F.col("fee_payer"), F.col("fee_payer"), none, F.lit("SOL"), F.lit("0"))).cast(f"array<{LEG}>")
    legs = txs.withColumn("legs", every).withColumn("legs", F.when(F.size("legs") > 0, F.col("legs")).otherwise(contract))
    return legs.select("tx", "wallet", "slot", F.timestamp_seconds("seconds").cast("timestamp_ntz").alias("ts"), F.posexplode("legs").alias("i", "l")).select("tx", "wallet", "slot", "ts", "i", "l.*")


def evm_legs(calls: DataFrame, transfers: DataFrame) -> DataFrame:
    """tx, block, ts, kind, source, dest, asset, symbol, amount: both feeds as legs of one transaction each; failed and empty calls go.

    calls has tx, block, seconds, source, dest, value, input, failed; transfers has tx, block, seconds, source, dest, contract, symbol, decimals, value.
    """
    paid, called = F.col("value").rlike("^0*[1-9][0-9]*$"), ~F.coalesce("input", F.lit("")).isin("", "0x")
    kind = F.when(paid, "native_transfer").when(called, "contract_interaction")
    when = F.timestamp_seconds("seconds").cast("timestamp_ntz").alias("ts")
    amount = F.when(paid, sc.decimal_shift(F.col("value"), F.lit(EVM_DECIMALS))).otherwise("0")
    a = calls.where(~F.coalesce("failed", F.lit(False))).select("tx", "block", when, kind.alias("kind"), F.lower("source").alias("source"), F.lower("dest").alias("dest"), F.lit(None).cast("string").alias("asset"), F.lit("BNB").alias("symbol"), amount.alias("amount"))
    decimals = F.coalesce(F.col("decimals").try_cast("int"), F.lit(0))
    b = transfers.select("tx", "block", when, F.lit("token_transfer").alias("kind"), F.lower("source").alias("source"), F.lower("dest").alias("dest"), F.lower("contract").alias("asset"), "symbol", sc.decimal_shift(F.col("value"), decimals).alias("amount"))
    return a.where("kind is not null").unionByName(b)


def _first(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Of each natural key the first leg's amount, ts and more: an aggregate, so that legs given again go before the shuffle.

    Amounts are numbers before they are compared, so that rows are combined in a hash table instead of being sorted.
    """
    of = lambda c: F.min_by(c, "i").alias(c)
    return rows.withColumn("amount", F.col("amount").cast("double")).groupBy(*keys).agg(*[of(c) for c in ("amount", "ts", *more)])


def trades_of(legs: DataFrame) -> DataFrame:
    """tx, wallet, asset, action, amount, ts: swaps and token transfers that touch the wallet, one row a natural key."""
    into, out = F.col("dest") == F.col("wallet"), F.col("source") == F.col("wallet")
    swap = F.col("kind") == "swap_leg"
    action = F.when(swap & into, "BUY").when(swap & out, "SELL").when((F.col("kind") == "token_transfer") & into, "TRANSFER_IN").when((F.col("kind") == "token_transfer") & out, "TRANSFER_OUT")
    rows = legs.where("asset is not null").withColumn("action", action).where("action is not null")
    return _first(rows, ["tx", "wallet", "asset", "action"]).select("tx", "wallet", "asset", "action", "amount", "ts")


def edges_of(legs: DataFrame) -> DataFrame:
    """tx, source, dest, action, symbol, amount, ts: transfers and bridge legs, one a transaction, ends and family."""
    action = F.when(F.col("kind").isin("native_transfer", "token_transfer"), "transfer").when(F.col("kind").isin("bridge_deposit", "bridge_withdrawal"), F.col("kind"))
    rows = legs.withColumn("action", action).where("action is not null")
    return _first(rows, ["tx", "source", "dest", "action"], "symbol").select("tx", "source", "dest", "action", "symbol", "amount", "ts")
