"""Candidate wallets: verdicts on computed evidence, and risk scores of tokens."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideflow.functions import scalar as sc
from tideflow.settings import DEFAULTS

# Service categories that are no candidates, labels, and confidences.
SERVICES = ("CEX", "ROUTER", "POOL", "BRIDGE", "MIXER")
BOT_LABELS, OFFSET_LABELS = ("possible_bot", "mev"), ("human_like", "smart_money")
REJECT_CONFIDENCE = 85
# The penalties of token risks.
TOP1, TOP5 = (0.30, 0.3), (0.60, 0.15)
HONEYPOT, CANNOT_SELL, TAX_HIGH, TAX_SOME, CLOSED, MINTABLE, TOP_HOLDER = 0.5, 0.3, (0.5, 0.3), (0.1, 0.15), 0.15, 0.15, (0.3, 0.2)


def bot_dominant(labels: Column) -> Column:
    """A bot's label, or a sniper's without a human's or smart one's beside it."""
    any_of = lambda names: F.arrays_overlap(labels, F.array(*[F.lit(x) for x in names]))
    return F.coalesce(any_of(BOT_LABELS) | (F.array_contains(labels, "sniper") & ~any_of(OFFSET_LABELS)), F.lit(False))


def agreement(claims: list[tuple[Column, Column]]) -> Column:
    """The part of the claims (claimed, computed) within half and twice what was computed; 1 where none can be compared."""
    usable = [c.isNotNull() & (v > 0) for c, v in claims]
    n = sum((F.when(F.coalesce(u, F.lit(False)), 1).otherwise(0) for u in usable), F.lit(0))
    good = sum((F.when(F.coalesce(u & (c / v).between(0.5, 2.0), F.lit(False)), 1).otherwise(0) for u, (c, v) in zip(usable, claims)), F.lit(0))
    return F.when(n > 0, good / n).otherwise(1.0)


def verdict(category: Column, labels: Column, claims: list[tuple[Column, Column]], cfg: dict[str, Any] | None = None) -> Column:
    """A struct of verdict, confidence and reason: service, bot, no evidence, thresholds, in this order.

    Reads pnl, trade_count, win_rate, realized, avg_trade_size and confidence (null: no evidence).
    """
    t = (cfg or DEFAULTS)["profitable_wallet"]
    limits = {"pnl": t["pnl_30d"], "trade_count": t["min_trades"], "win_rate": t["min_win_rate"], "realized": t["min_realized"], "avg_trade_size": t["min_avg_trade_size"]}
    failing = F.array_compact(F.array(*[F.when(F.col(k) < v, k) for k, v in limits.items()]))
    confidence = sc.clamp(sc.round_int(F.col("confidence") * (0.7 + 0.3 * agreement(claims))).cast("double"), 0.0, 100.0).cast("int")
    told = lambda v, c, r: F.struct(F.lit(v).alias("verdict"), (F.lit(c) if isinstance(c, int) else c).alias("confidence"), r.alias("reason"))
    return (
        F.when(F.coalesce(category.isin(*SERVICES), F.lit(False)), told("reject", REJECT_CONFIDENCE, F.concat(F.lit("service "), category)))
        .when(bot_dominant(labels), told("reject", REJECT_CONFIDENCE, F.lit("bot")))
        .when(F.col("confidence").isNull(), told("insufficient", 0, F.lit("no evidence")))
        .when(F.size(failing) > 0, told("reject", confidence, F.concat(F.lit("below "), F.array_join(failing, ", "))))
        .otherwise(told("promote", confidence, F.lit("clears all")))
    )


def holder_risk(top1: Column, top5: Column, mint_active: Column, freeze_active: Column, authority: float = 0.25) -> Column:
    """The penalty of concentrated holders and of live authorities, 1 at most."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    total = F.when(yes(top1 >= TOP1[0]), TOP1[1]).otherwise(0.0) + F.when(yes(top5 >= TOP5[0]), TOP5[1]).otherwise(0.0) + F.when(yes(mint_active), authority).otherwise(0.0) + F.when(yes(freeze_active), authority).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(total, 4))


def contract_risk(honeypot: Column, cannot_sell: Column, buy_tax: Column, sell_tax: Column, open_source: Column, mintable: Column, top_holder: Column) -> Column:
    """The penalty of a contract's traits, 1 at most; an unknown trait costs nothing."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    tax = lambda x: F.when(yes(x >= TAX_HIGH[0]), TAX_HIGH[1]).when(yes(x > TAX_SOME[0]), TAX_SOME[1]).otherwise(0.0)
    cost = lambda c, v: F.when(yes(c), v).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(cost(honeypot, HONEYPOT) + cost(cannot_sell, CANNOT_SELL) + tax(buy_tax) + tax(sell_tax) + cost(~open_source, CLOSED) + cost(mintable, MINTABLE) + cost(top_holder >= TOP_HOLDER[0], TOP_HOLDER[1]), 4))
