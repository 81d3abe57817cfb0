"""Why a signal fired, what would invalidate it, what changed since the check before, and a cautious reading."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideflow.functions import scalar as sc
from tideflow.operators.temporal import asof
from tideflow.settings import DEFAULTS

#: The window, in minutes, whose figures explain each rule; a rotation is explained by its chain.
WINDOW_OF = {"A": 30, "B": 1440, "C": 30, "D": 30, "E": 30, "F": 30, "G": 1440}
ACCUMULATION = ("A", "B", "C", "D", "E")


def _text(*parts: Any) -> Column:
    return F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])


def _usd(x: Column) -> Column:
    return F.regexp_replace(sc.fmt_usd(x), r"\.0([kMB])$", "$1")


def _signed(x: Column) -> Column:
    return _text(F.when(x > 0, "+").otherwise(""), _usd(x))


def _whole(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long").cast("string")


def figures(windows: DataFrame) -> DataFrame:
    """token_id, minutes, t and the figures of a window at each step, with those of the step before (null at the first).

    windows: of stepped windows. A growth that isn't known counts as none, an unknown liquidity as 0.
    """
    before = Window.partitionBy("token_id", "minutes").orderBy("k")
    now = windows.select("token_id", "minutes", "k", "t", "smart", "entities", "net_usd", "sold_pct", (F.coalesce("expansion", F.lit(0.0)) + 1).alias("multiple"), F.coalesce("liquidity", F.lit(0.0)).alias("liquidity"))
    return now.withColumns({"was_smart": F.lag("smart").over(before), "was_net": F.lag("net_usd").over(before)}).drop("k")


def with_chains(fires: DataFrame, chains: DataFrame) -> DataFrame:
    """Fires with chain: the last rotation into the token that was known at the fire, for rule F; null elsewhere.

    fires: token_id, rule, t. chains: to_token, from_token, buy_ts, buy_id, sent, got, bridged, protocol, gap_min, confidence.
    """
    told = chains.select(F.col("to_token").alias("token_id"), "buy_ts", "buy_id", F.struct("from_token", "sent", "got", "bridged", "protocol", "gap_min", "confidence").alias("chain"))
    # Of one buy's chains the surest.
    told = told.groupBy("token_id", "buy_ts", "buy_id").agg(F.max_by("chain", F.struct("chain.confidence", -F.col("chain.gap_min"), -F.col("chain.from_token"))).alias("chain"))
    out = asof(fires, told, ["token_id"], "t", "buy_ts", "buy_id", ["chain"])
    return out.withColumn("chain", F.when(F.col("rule") == "F", F.col("chain")))


def explained(fires: DataFrame, found: DataFrame, cfg: dict[str, Any] | None = None) -> DataFrame:
    """fires with headline, why and invalidates (lists of sentences), changed (null at a token's first step), conclusion.

    fires: token_id, rule, t, severity, symbol, chain (with_chains). found: figures. Thresholds in sentences are cfg's. A
    fire of rule F without a chain is told by its figures, and its reading stays open.
    """
    r = (cfg or DEFAULTS)["rules"]
    minutes = F.create_map(*[F.lit(x) for pair in WINDOW_OF.items() for x in pair])[F.col("rule")]
    f = fires.withColumn("minutes", minutes).join(found, ["token_id", "minutes", "t"])
    rule, name, chain = F.col("rule"), _text("$", F.col("symbol")), F.col("chain")
    rotation, leaving = (rule == "F") & chain.isNotNull(), rule == "G"
    source = _text("$T", chain["from_token"].cast("string"))
    band = sc.link_band(chain["confidence"])
    share, net, liquidity, multiple = F.col("sold_pct"), F.col("net_usd"), F.col("liquidity"), F.col("multiple")
    pressure = F.when(share < 20, "low").when(share < 40, "moderate").otherwise("high")

    gathered = F.array(
        _text(F.col("smart").cast("string"), " tracked smart wallets bought ", name, ", but entity clustering estimates ", F.col("entities").cast("string"), " unique entities."),
        _text("Net smart flow is ", _signed(net), ", sell pressure is ", pressure, " (", _whole(share), "% of buyers have sold), and market cap expanded only ", sc.fixed(multiple, 1), "x from average smart entry."),
    )
    left = F.array(
        _text(F.col("smart").cast("string"), " previously-tracked smart wallets are showing distribution on ", name, " — ", _whole(share), "% of buyers have sold their position."),
        _text("Net smart flow has turned to ", _signed(net), ", and liquidity stands at ", _usd(liquidity), "."),
    )
    through = F.when(chain["bridged"], _text(", bridged funds through ", F.coalesce(chain["protocol"], F.lit("a cross-chain bridge")), ",")).otherwise(",")
    rotated = F.array(
        _text("Wallet group realized profit on ", source, through, " and a linked wallet bought ", name, " ", _whole(chain["gap_min"]), " minutes later."),
        _text("Amount match: ", _whole(chain["got"] / chain["sent"] * 100), "%. Confidence: ", band, "."),
    )
    against = lambda *sentences: F.array(*[F.lit(s) for s in sentences])
    still = against(f"Sell pressure rising above {r['A']['max_sold_pct']:g}% of buyers", f"Market cap expanding beyond {r['B']['max_expansion']:g}× average smart entry", "Net smart flow turning negative")
    back = against(f"Exited smart-wallet share dropping back below {r['G']['min_exited_pct']:g}%", f"Liquidity stabilizing (no further drop beyond {r['G']['liquidity_drop_pct']:g}%)", "Net smart flow turning positive with new smart buyers returning")
    broken = against(f"Amount match falling outside the {r['F']['min_match_pct']:g}-{r['F']['max_match_pct']:g}% band", f"Re-buy landing beyond the {r['F']['buy_min']:g}-minute window", "No further linked wallets repeating the pattern")

    more, flow = F.col("smart") - F.col("was_smart"), net - F.col("was_net")
    changed = _text(F.when(more >= 0, "+").otherwise(""), more.cast("string"), " smart wallet", F.when(F.abs(more) == 1, "").otherwise("s"), " and ", _signed(flow), " net flow since the last check.")
    reading = (
        F.when(rotation, _text("This looks like a ", band, " profit rotation from ", source, " into ", name, ", not a coincidental buy."))
        .when(leaving, "This looks like an exit warning — smart money distribution, not fresh accumulation.")
        .when(rule.isin(*ACCUMULATION) & (multiple < 1.5), "This looks like accumulation, not late chase.")
        .when(rule.isin(*ACCUMULATION) & (multiple > 2), "This looks like expansion already underway — late-entry risk.")
        .when(rule.isin(*ACCUMULATION), "This sits between early accumulation and a confirmed chase — worth continued watching, not yet a clear read.")
        .otherwise("No clear read yet — insufficient signal to characterize this move.")
    )
    head = (
        F.when(rotation, _text(source, " → ", name, ": probable profit rotation"))
        .when(leaving, _text(name, ": exit warning (", F.lower("severity"), ")"))
        .otherwise(_text(name, ": ", F.lower("severity"), " signal (rule ", rule, ")"))
    )
    pick = lambda a, b, c: F.when(rotation, a).when(leaving, b).otherwise(c)
    return f.select(*fires.columns, head.alias("headline"), pick(rotated, left, gathered).alias("why"), pick(broken, back, still).alias("invalidates"), changed.alias("changed"), reading.alias("conclusion"))
