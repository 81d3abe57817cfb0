"""Rules replayed over time: what each token's windows hold at every step of a grid, without copying trades to steps.

At step T a token's window ends at its last trade up to T and reaches back `minutes`. As T moves on, a trade enters the
window at one step, leaves it at a later one and then leaves the window before it, so a wallet's state only changes at
those steps. Trades that change state at the same steps are added up first (a pane), which bounds a wallet's rows by the
number of steps, however often it trades. Running sums over a wallet's changes give its states as intervals of steps; what
a state adds to the token's totals is counted at the step at which it begins and taken off where it ends. The work
grows with trades plus tokens by steps, not with trades by steps.

What isn't a sum over wallets (the fullest block, the largest cluster, the largest holders) comes from intervals of steps
in which a value holds: each is laid on the O(log steps) nodes of a binary tree that cover it, nodes keep their best
values, and a step takes the best of the nodes above it.

A step sees nothing later than itself: not trades or market points, not the buy of a funding, not a chain of moves before
its last buy. Wallets' classes and clusters are taken as they are for all steps. Several windows share one scan. Times are
microseconds; a null time, token or wallet takes no part; a null amount counts as a trade of no value; an empty table has
no steps.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideflow.operators import temporal as tm
from tideflow.operators import token_window as tw
from tideflow.settings import DEFAULTS
from tideflow.sources.shared import saved, small_or_shuffled

# The rules that read each window, and the severities of rules with one.
RULES_OF = {30: ("A", "C", "D"), 1440: ("B", "G")}
SEVERITY = {"B": "WATCH", "C": "WATCH", "D": "HIGH", "E": "HIGH", "F": "HIGH", "G": "CRITICAL"}
_BY_WALLET = ["token_id", "wallet_id", "minutes"]
_MONEY = "decimal(28,4)"
#: Sums over trades.
AMOUNTS = ("buy_sum", "sell_sum", "weight_sum", "mcap_sum", "trailing_sum")


def _us(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


@dataclass(frozen=True)
class Grid:
    """Steps from start on, every `minutes`, and one at end; both ends belong to it. Times are texts."""

    start: str
    end: str
    minutes: int

    def _at(self, t: str) -> Column:
        return _us(F.lit(t).cast("timestamp_ntz"))

    def steps(self, spark: Any) -> int:
        """The index of the last step."""
        lo, hi = spark.range(1).select(self._at(self.start), self._at(self.end)).first()
        return max(0, -(-(hi - lo) // (self.minutes * 60_000_000)))

    def time(self, k: Column, last: int) -> Column:
        return F.when(k == last, self._at(self.end)).otherwise(self._at(self.start) + k.cast("long") * (self.minutes * 60_000_000))

    def reaching(self, us: Column, last: int) -> Column:
        """The first step at or after a time; last + 1 beyond the end."""
        step = self.minutes * 60_000_000
        own = F.ceil((us - self._at(self.start)) / step)
        return F.when(us > self._at(self.end), last + 1).otherwise(F.least(F.greatest(own, F.lit(0)), F.lit(last))).cast("int")


def anchors(trades: DataFrame, grid: Grid, last: int) -> DataFrame:
    """token_id, ends and changes: by step, the window's end (null before the first trade) and the next step with a later one."""
    seen = trades.where("token_id is not null and ts is not null").select("token_id", _us("ts").alias("us")).withColumn("k", grid.reaching(F.col("us"), last)).where(F.col("k") <= last)
    seen = seen.groupBy("token_id", "k").agg(F.max("us").alias("us"))
    # At most last + 1 entries a token.
    own = seen.groupBy("token_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "us"))).alias("m"))
    steps = F.sequence(F.lit(0), F.lit(last))
    carried = F.aggregate(steps, F.array().cast("array<bigint>"), lambda a, k: F.concat(a, F.array(F.coalesce(F.element_at("m", k), F.get(a, k - 1)))))
    back = F.aggregate(F.reverse(steps), F.array(F.lit(last + 1)), lambda a, k: F.concat(a, F.array(F.when(F.map_contains_key("m", k), k).otherwise(F.get(a, F.lit(last) - k)))))
    # back holds, from the end, the first step at or after k with a new trade; changes[k] is that of k + 1.
    return own.select("token_id", carried.alias("ends"), F.reverse(F.slice(back, 1, last + 1)).alias("changes"))


def placed(trades: DataFrame, ends: DataFrame, grid: Grid, last: int, windows: tuple[int, ...]) -> DataFrame:
    """Trades with the steps at which they enter, pass the middle of, leave and have left each window."""
    t = trades.where("wallet_id is not null and ts is not null").withColumn("us", _us("ts")).join(small_or_shuffled(ends, 4_000_000 // (last + 1)), "token_id")
    t = t.withColumn("enter", grid.reaching(F.col("us"), last)).where(F.col("enter") <= last)

    # Each end has columns of its own for its time and step, so that no expression is told and computed twice.
    half_minutes = {"half": 1, "leave": 2, "gone": 4}
    t = t.select("token_id", "wallet_id", "us", "trade_id", "block", "action", "usd", "mcap", "enter", "ends", "changes", F.explode(F.array(*[F.lit(m) for m in windows])).alias("minutes"))
    t = t.withColumns({f"{c}_us": F.col("us") + F.col("minutes").cast("long") * (n * 30_000_000) for c, n in half_minutes.items()})
    t = t.withColumns({f"{c}_k": grid.reaching(F.col(f"{c}_us") + 1, last) for c in half_minutes})

    def past(c: str) -> Column:
        """The first step whose window ends later than the time."""
        k = F.col(f"{c}_k")
        return F.when(k > last, last + 1).when(F.get("ends", k) > F.col(f"{c}_us"), k).otherwise(F.get("changes", k)).cast("int").alias(c)

    return t.select("token_id", "wallet_id", "us", "trade_id", "block", "action", F.coalesce("usd", F.lit(0)).cast("decimal(20,4)").alias("usd"), "mcap", "enter", "minutes", *[past(c) for c in half_minutes])


def _money(c: Column, x: str | Column) -> Column:
    return F.coalesce(F.sum(F.when(c, F.col(x) if isinstance(x, str) else x)), F.lit(0)).cast(_MONEY)


def amounts(rows: DataFrame, wallets: DataFrame, last: int) -> DataFrame:
    """By token, window and step, what the wallets that are known have traded in the window, and bought in the one before.

    These are sums over trades, so they need no wallet's state: a trade adds to them at one step and is taken off at another.
    """
    known = wallets.where("is_watched is not null").select("wallet_id")
    buy, priced = F.col("action") == "BUY", (F.col("action") == "BUY") & F.col("mcap").isNotNull()
    weight = F.sum(F.when(priced, F.col("usd").cast("decimal(14,4)") * F.col("mcap").cast("decimal(18,4)")))
    sums = [_money(buy, "usd").alias("buy_sum"), _money(~buy, "usd").alias("sell_sum"), F.coalesce(weight, F.lit(0)).cast("decimal(38,8)").alias("weight_sum"), _money(priced, "usd").alias("mcap_sum")]
    # What enters and is gone at one step adds nothing.
    rows = rows.where(F.col("enter") < F.col("gone"))
    added = rows.join(known, "wallet_id", "left_semi").groupBy("token_id", "minutes", "enter", "leave", "gone").agg(*sums)
    inside, kinds = ("buy_sum", "sell_sum", "weight_sum", "mcap_sum"), dict(added.dtypes)

    def event(k: str, sign: int, trailing: int) -> Column:
        return F.struct(F.col(k).alias("k"), *[(F.col(c) * sign).cast(kinds[c]).alias(c) for c in inside], (F.col("buy_sum") * trailing).cast(_MONEY).alias("trailing_sum"))

    events = added.select("token_id", "minutes", F.explode(F.array(event("enter", 1, 0), event("leave", -1, 1), event("gone", 0, -1))).alias("e"))
    return _running(events.select("token_id", "minutes", "e.*").where(F.col("k") <= last), ["token_id", "minutes"], list(AMOUNTS))


def panes(rows: DataFrame, whale_usd: float) -> DataFrame:
    """Placed trades of a wallet added up by the steps at which they change its state."""
    buy = F.col("action") == "BUY"
    # A trade that is in no window has no middle to pass.
    rows = rows.withColumn("half", F.when(F.col("enter") < F.col("leave"), F.col("half")).otherwise(F.col("leave")))
    return rows.groupBy(*_BY_WALLET, "enter", "half", "leave").agg(
        _money(buy, "usd").alias("buy"),
        _money(~buy, "usd").alias("sell"),
        F.count_if(buy).alias("n_buy"),
        F.count_if(buy & (F.col("usd") >= F.lit(whale_usd).cast("decimal(20,4)"))).alias("n_whale"),
        F.min(F.when(buy, F.struct("us", "trade_id", "block"))).alias("first"),
        F.min("us").alias("begun"),
    )


def states(rows: DataFrame, last: int) -> DataFrame:
    """What each wallet has in and before each window, from each step k at which that changes on, up to the step until.

    first: of the first buy in the window the block, the step at which it passes the middle, and whether the wallet had not
    traded the token before. Panes enter, pass the middle and leave in one order, so a pane's buy is the first from the step
    on at which it has entered and all buys before it have left.
    """
    order = Window.partitionBy(*_BY_WALLET).orderBy("enter", "half", "leave")
    bought, inside = F.col("n_buy") > 0, F.col("enter") < F.col("leave")
    left = F.max(F.when(bought, F.col("leave"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = F.min("begun").over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.when(bought & inside, F.struct(F.col("first.block").alias("block"), "half", (F.col("first.us") == begun).alias("new")))
    rows = rows.select(*_BY_WALLET, "enter", "leave", "buy", "sell", "n_buy", "n_whale", F.greatest("enter", F.coalesce(left, F.lit(0))).alias("since"), first.alias("first"))
    sums, kinds = ("buy", "sell", "n_buy", "n_whale"), dict(rows.dtypes)
    zero = {c: F.lit(0).cast(kinds[c]) for c in sums}

    def event(k: str, own: dict[str, Column], held: Column, first: Column) -> Column:
        return F.struct(F.col(k).alias("k"), *[own[c].alias(c) for c in sums], held.cast(_MONEY).alias("held"), first.alias("first"))

    none, starts = F.lit(None).cast(kinds["first"]), F.col("since") == F.col("enter")
    events = F.array(
        F.when(inside, event("enter", {c: F.col(c) for c in sums}, F.lit(0), F.when(starts, F.col("first")))),
        F.when(F.col("first").isNotNull() & ~starts & (F.col("since") < F.col("leave")), event("since", zero, F.lit(0), F.col("first"))),
        event("leave", {c: F.when(inside, -F.col(c)).otherwise(zero[c]) for c in sums}, F.col("buy") - F.col("sell"), none),
    )
    e = rows.select(*_BY_WALLET, F.explode(F.array_compact(events)).alias("e")).select(*_BY_WALLET, "e.*").where(F.col("k") <= last)
    by_step = Window.partitionBy(*_BY_WALLET).orderBy("k")
    along = by_step.rowsBetween(Window.unboundedPreceding, 0)
    until = F.coalesce(F.lead("k").over(by_step), F.lit(last + 1)).alias("until")
    run = [F.sum(c).over(along).alias(c) for c in (*sums, "held")]
    # Of several changes at one step the last has them all.
    return e.select(*_BY_WALLET, "k", until, *run, F.last("first", ignorenulls=True).over(along).alias("first")).where(F.col("k") < F.col("until"))


def _running(deltas: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums of deltas by keys and step, added up along the steps."""
    summed = deltas.groupBy(*keys, "k").agg(*[F.sum(v).alias(v) for v in values])
    along = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return summed.select(*keys, "k", *[F.sum(v).over(along).alias(v) for v in values])


def _node(h: int, i: Column) -> Column:
    """Place i on level h as one number, which is cheap to sort and group by."""
    return i.cast("long") + F.lit(h << 40)


def _nodes(begin: Column, end: Column, last: int) -> Column:
    """The nodes of a binary tree over steps that cover begin..end - 1: at most two a level."""
    parts = []
    for h in range((last + 1).bit_length() + 1):
        lo, hi = F.shiftright(begin + ((1 << h) - 1), h), F.shiftright(end, h)
        for odd, i in ((lo, lo), (hi, hi - 1)):
            parts.append(F.when((lo < hi) & (odd % 2 == 1), _node(h, i)))
    return F.array_compact(F.array(*parts))


def _above(last: int) -> Column:
    return F.array(*[_node(h, F.shiftright("k", h)) for h in range((last + 1).bit_length() + 1)])


def _intervals(states_: DataFrame, keys: list[str], last: int) -> DataFrame:
    """Rows with the step `until` before which they hold."""
    return states_.withColumn("until", F.coalesce(F.lead("k").over(Window.partitionBy(*keys).orderBy("k")), F.lit(last + 1)))


def _most(counts: DataFrame, key: str, steps: DataFrame, last: int, name: str) -> DataFrame:
    """token_id, minutes, k and the largest of the keys' counts n at each step; counts of one are left out."""
    held = _intervals(counts, ["token_id", "minutes", key], last).where("n > 1")
    nodes = held.select("token_id", "minutes", "n", F.explode(_nodes(F.col("k"), F.col("until"), last)).alias("at")).groupBy("token_id", "minutes", "at").agg(F.max("n").alias("n"))
    return steps.select("token_id", "minutes", "k", F.explode(_above(last)).alias("at")).join(nodes, ["token_id", "minutes", "at"]).groupBy("token_id", "minutes", "k").agg(F.max("n").alias(name))


def _largest(holders: DataFrame, steps: DataFrame, last: int, top: int) -> DataFrame:
    """The largest holders at each step, with their place r."""
    # Doubles keep the order of decimals and are cheaper to compare; where they are equal, decimals decide.
    order = [F.desc("size"), F.desc("held"), "wallet_id"]
    nodes = holders.select("token_id", "minutes", "wallet_id", "size", "held", "out", F.explode(_nodes(F.col("k"), F.col("until"), last)).alias("at"))
    nodes = nodes.withColumn("r", F.row_number().over(Window.partitionBy("token_id", "minutes", "at").orderBy(*order))).where(F.col("r") <= top).drop("r")
    met = steps.select("token_id", "minutes", "k", F.explode(_above(last)).alias("at")).join(nodes, ["token_id", "minutes", "at"])
    return met.withColumn("r", F.row_number().over(Window.partitionBy("token_id", "minutes", "k").orderBy(*order))).where(F.col("r") <= top)


def _top_exits(holders: DataFrame, steps: DataFrame, last: int, top: int = tw.TOP_HOLDERS) -> DataFrame:
    """token_id, minutes, k, top_exits: of the largest holders before the window those that sold out in it.

    The largest of those that begin at each step are found first. At any step the last place among them is a floor, and who
    is below the floors of all its steps is among the largest at none, so few holders are laid on the tree.
    """
    holders = holders.withColumn("size", F.col("held").cast("double"))
    begin = Window.partitionBy("token_id", "minutes", "k").orderBy(F.desc("size"))
    some = holders.withColumn("r", F.row_number().over(begin)).where(F.col("r") <= top).drop("r")
    floors = _largest(some, steps, last, top).where(F.col("r") == top).groupBy("token_id", "minutes").agg(F.map_from_entries(F.collect_list(F.struct("k", "size"))).alias("m"))
    floor = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda k: F.coalesce(F.element_at("m", k), F.lit(float("-inf"))))
    floors = small_or_shuffled(saved(floors.select("token_id", "minutes", floor.alias("floors"))), 4_000_000 // (last + 1))
    lowest = F.array_min(F.slice("floors", F.col("k") + 1, F.col("until") - F.col("k")))
    left = saved(holders.join(floors, ["token_id", "minutes"], "left").where(F.col("floors").isNull() | (F.col("size") >= lowest)).drop("floors"))
    return _largest(left, steps, last, top).groupBy("token_id", "minutes", "k").agg(F.count_if("out").alias("top_exits"))


def stepped_windows(trades: DataFrame, wallets: DataFrame, market: DataFrame, grid: Grid, windows: tuple[int, ...] = (30, 1440), whale_usd: float = 10000.0, spike_mult: float = 3.0) -> DataFrame:
    """One row a token, window length and step from its first trade on: the columns that rules read, with k, t and to_ts.

    trades: trade_id, wallet_id, token_id, action, usd, ts, block, mcap. wallets: wallet_id, is_watched, meets_profitable,
    score, labels, cluster_id. market: point_id, token_id, ts, mcap, liquidity.
    """
    spark = trades.sparkSession
    last = grid.steps(spark)
    ends = saved(anchors(trades, grid, last))
    rows = placed(trades, ends, grid, last, windows)
    label = lambda *names: F.coalesce(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in names])), F.lit(False))
    smart = F.coalesce(F.col("is_watched") | F.col("meets_profitable"), F.lit(False))
    told = {"is_smart": smart, "is_human": label("human_like"), "is_human_or_smart": label("human_like", "smart_money"), "is_bot": label("possible_bot")}
    people = small_or_shuffled(saved(wallets.select("wallet_id", "is_watched", F.coalesce("score", F.lit(0.0)).cast("decimal(20,6)").alias("score"), "cluster_id", *[v.alias(c) for c, v in told.items()])))
    buyer, holder = F.col("n_buy") > 0, F.col("held") > 0
    share = lambda of: F.coalesce(F.col("sell").cast("double") / F.when(F.col(of) > 0, F.col(of).cast("double")) * 100 >= tw.EXITED, F.lit(False))
    s = states(panes(rows, whale_usd), last).where(buyer | holder).join(people.drop("is_watched"), "wallet_id", "left")
    # Of a buyer, first holds; of others it is left over from an earlier buy.
    s = s.select(
        *_BY_WALLET, "k", "until", "held", F.when(buyer, F.col("first")).alias("first"), buyer.alias("buyer"), holder.alias("holder"), share("held").alias("out"), (buyer & (F.col("sell") > 0)).alias("sold"), (F.col("n_whale") > 0).alias("whale"),
        (buyer & ~holder & share("buy")).alias("new_out"), *[F.coalesce(c, F.lit(False)).alias(c) for c in told], F.when(buyer, F.col("score")).alias("score"), F.when(buyer & F.col("is_smart"), F.col("cluster_id")).alias("of_cluster"),
    )
    s = saved(s.withColumn("of_block", F.col("first.block")))
    buyer, holder, smart, out = F.col("buyer"), F.col("holder"), F.col("is_smart"), F.col("out")
    adds = {
        "buyers": buyer,
        "sold_buyers": F.col("sold"),
        "smart": buyer & smart,
        "human": buyer & F.col("is_human"),
        "human_or_smart": buyer & F.col("is_human_or_smart"),
        "bots": buyer & F.col("is_bot"),
        "whales": F.col("whale"),
        "unclustered": buyer & smart & F.col("of_cluster").isNull(),
        "smart_holders": smart & holder,
        "smart_holders_out": smart & holder & out,
        "smart_new": smart & buyer & ~holder,
        "smart_new_out": smart & F.col("new_out"),
        "new_smart": buyer & smart & F.col("first.new"),
        "in_blocks": F.col("of_block").isNotNull(),
    }

    steps = ends.select("token_id", F.posexplode("ends").alias("k", "to_us")).where("to_us is not null")
    steps = steps.select("*", F.explode(F.array(*[F.lit(m) for m in windows])).alias("minutes"))
    steps = saved(steps.withColumn("to_ts", F.timestamp_micros("to_us").cast("timestamp_ntz")).withColumn("from_ts", F.timestamp_micros(F.col("to_us") - F.col("minutes") * F.lit(60_000_000).cast("long")).cast("timestamp_ntz")))
    half = F.col("first.half")

    def changes(at: str, sign: int) -> DataFrame:
        """What states add at the step at which they begin, or take off (sign -1) where they end."""
        early = half <= F.col(at) if sign > 0 else half < F.col(at)
        told = {c: F.count_if(v) for c, v in adds.items()} | {"early_buyers": F.count_if(early), "score_sum": F.sum("score")}
        of = s.where(buyer | smart).where(F.col(at) <= last).groupBy("token_id", "minutes", F.col(at).alias("k"))
        return of.agg(*[(v if sign > 0 else -v).alias(c) for c, v in told.items()])

    middle = s.where((half > F.col("k")) & (half < F.col("until"))).groupBy("token_id", "minutes", half.alias("k")).agg(F.count("*").alias("early_buyers"))
    totals = changes("k", 1).unionByName(changes("until", -1)).unionByName(middle, allowMissingColumns=True)
    adds = (*adds, "early_buyers", "score_sum")
    totals = _running(totals, ["token_id", "minutes"], list(adds))

    def counted(key: str) -> DataFrame:
        """How many wallets have each value of a column, from each step at which that changes on."""
        both = F.array(F.struct("k", F.lit(1).alias("n")), F.struct(F.col("until").alias("k"), F.lit(-1).alias("n")))
        moved = s.where(F.col(key).isNotNull()).select("token_id", "minutes", key, F.explode(both).alias("e"))
        return _running(moved.select("token_id", "minutes", key, "e.*").where(F.col("k") <= last), ["token_id", "minutes", key], ["n"])

    clusters = counted("of_cluster")
    there = F.when(F.col("n") > 0, 1).otherwise(0)
    by_cluster = Window.partitionBy("token_id", "minutes", "of_cluster").orderBy("k")
    distinct = _running(clusters.select("token_id", "minutes", "k", (there - F.coalesce(F.lag(there).over(by_cluster), F.lit(0))).alias("clusters")), ["token_id", "minutes"], ["clusters"])
    dense = steps.join(totals, ["token_id", "minutes", "k"], "left").join(amounts(rows, people, last), ["token_id", "minutes", "k"], "left").join(distinct, ["token_id", "minutes", "k"], "left")
    along = Window.partitionBy("token_id", "minutes").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    dense = dense.select("token_id", "minutes", "k", "to_ts", "from_ts", *[F.coalesce(F.last(c, ignorenulls=True).over(along), F.lit(0)).alias(c) for c in (*adds, *AMOUNTS, "clusters")])
    for part in (_most(counted("of_block"), "of_block", steps, last, "block_buyers"), _most(clusters, "of_cluster", steps, last, "largest_cluster"), _top_exits(s.where(holder).select(*_BY_WALLET, "k", "until", "held", "out"), steps, last)):
        dense = dense.join(part, ["token_id", "minutes", "k"], "left")

    dense = saved(dense)
    end = tm.asof(dense, market.withColumns({"current_mcap": F.col("mcap"), "end_liquidity": F.col("liquidity")}), ["token_id"], "to_ts", "ts", "point_id", ["current_mcap", "end_liquidity"])
    both = tm.asof(end, market.withColumn("start_liquidity", F.col("liquidity")), ["token_id"], "from_ts", "ts", "point_id", ["start_liquidity"])
    began = market.groupBy("token_id").agg(F.min(_us("ts")).alias("began"))
    out = both.join(began, "token_id", "left").withColumn("t_us", grid.time(F.col("k"), last))
    b, sold = F.col("buy_sum").cast("double"), F.col("sell_sum").cast("double")
    entry = F.when(F.col("mcap_sum") > 0, F.round(F.col("weight_sum").cast("double") / F.col("mcap_sum").cast("double"), 4))
    exited, buyers = F.col("smart_holders") + F.col("smart_new"), F.col("buyers")
    start, liquidity = F.col("start_liquidity"), F.col("end_liquidity")
    pct = lambda n: F.round(F.when(buyers > 0, n * 100.0 / buyers).otherwise(0.0), 6)
    trailing = F.col("trailing_sum")
    at_least = lambda c, there: F.greatest(F.coalesce(c, F.lit(0)), F.when(there > 0, 1).otherwise(0))
    return out.select(
        "token_id", "minutes", "k", F.timestamp_micros("t_us").cast("timestamp_ntz").alias("t"), "to_ts", "buyers", b.alias("buy_usd"), sold.alias("sell_usd"), (F.col("buy_sum") - F.col("sell_sum")).cast("double").alias("net_usd"),
        F.round(F.when(sold > 0, b / sold).when(b > 0, 999.0).otherwise(0.0), 6).alias("buy_sell_ratio"),
        "smart", "human", "human_or_smart", "bots", "whales",
        (F.col("clusters") + F.col("unclustered")).alias("entities"), at_least("largest_cluster", F.col("clusters")).alias("largest_cluster"),
        entry.alias("avg_entry_mcap"), "current_mcap", F.round(F.when(entry > 0, F.col("current_mcap") / entry - 1), 6).alias("expansion"),
        liquidity.alias("liquidity"), F.round(F.when(start > 0, (liquidity - start) / start * 100), 6).alias("liquidity_change_pct"),
        F.when(F.col("began") <= F.col("t_us"), F.round((_us("to_ts") - F.col("began")) / 86_400_000_000.0, 6)).alias("age_days"),
        trailing.cast("double").alias("trailing_usd"), ((trailing > 0) & (b >= spike_mult * trailing.cast("double"))).alias("spike"),
        F.round(F.when(exited > 0, (F.col("smart_holders_out") + F.col("smart_new_out")) * 100.0 / exited).otherwise(0.0), 6).alias("exited_smart_pct"),
        F.coalesce("top_exits", F.lit(0)).alias("top_exits"), "new_smart", "early_buyers",
        pct(F.col("sold_buyers")).alias("sold_pct"), pct(at_least("block_buyers", F.col("in_blocks"))).alias("block_pct"),
        F.round(F.when(buyers > 0, F.col("score_sum").cast("double") / buyers).otherwise(0.0), 6).alias("avg_score"),
    )


def stepped_rules(windows: DataFrame, funded: DataFrame, rotated: DataFrame, cfg: dict[str, Any] | None = None) -> DataFrame:
    """token_id, k, t, rule, fired, severity: all seven rules at each step, each on its own window.

    windows: of stepped_windows, on 30 and 1440 minutes. funded, rotated: token_id and seen_ts, the time from which a
    funding with its buy, or a chain with its last buy, is known; the conditions on them are the caller's.
    """
    fired = tw.rules(cfg)
    severity = {k: F.lit(v) for k, v in SEVERITY.items()} | {"A": tw.severity_a(cfg)}
    said = [F.when(F.col("minutes") == m, F.array(*[F.struct(F.lit(r).alias("rule"), fired[r].alias("fired"), severity[r].alias("severity")) for r in rules])) for m, rules in RULES_OF.items()]
    own = windows.select("token_id", "k", "t", F.explode(F.coalesce(*said)).alias("r")).select("token_id", "k", "t", "r.*")
    first = lambda df, c: df.groupBy("token_id").agg(F.min("seen_ts").alias(c))
    steps = windows.where(F.col("minutes") == 30).select("token_id", "k", "t")
    steps = steps.join(first(funded, "e"), "token_id", "left").join(first(rotated, "f"), "token_id", "left")
    known = lambda c: F.coalesce(F.col(c) <= F.col("t"), F.lit(False))
    chains = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), known(c).alias("fired"), F.lit(SEVERITY[r]).alias("severity")) for r, c in (("E", "e"), ("F", "f"))]))
    both = own.unionByName(steps.select("token_id", "k", "t", chains.alias("r")).select("token_id", "k", "t", "r.*"))
    return both.withColumn("severity", F.when(F.col("fired"), F.col("severity")).otherwise("INFO"))


def replayed_fires(rules: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """token_id, rule, t, severity (and keys) of fires that no kept fire of the last day suppresses."""
    fired = saved(rules.where("fired"))  # read twice
    kept = tm.kept_fires(fired.select(*keys, "token_id", "rule", "t"), [*keys, "token_id", "rule"], "t")
    return kept.join(fired, [*keys, "token_id", "rule", "t"]).select(*keys, "token_id", "rule", "t", "severity")


# The grid that is tried one value at a time, and where each value goes (None: a filter on rule A's fires).
TUNED: dict[str, tuple[tuple[float, ...], tuple[str, str] | None]] = {
    "minWallets": ((10, 15, 20, 30), ("A", "min_wallets")),
    "minEntities": ((1, 5, 10), None),
    "minNetFlow": ((0, 10_000, 25_000, 50_000), None),
    "maxSoldPct": ((20, 30, 50), ("A", "max_sold_pct")),
    "maxMcapExpansion": ((1.5, 2, 3), ("B", "max_expansion")),
    "minLiquidity": ((10_000, 20_000, 50_000), ("A", "min_liquidity")),
}
FILTERED = {"minEntities": "entities", "minNetFlow": "net_usd"}
LEAST_SAMPLE = 5


def tuned_rules(rules: DataFrame, windows: DataFrame, grid: dict | None = None, cfg: dict[str, Any] | None = None) -> DataFrame:
    """dimension, value, token_id, rule, t, severity: the kept fires of each setting, from one evaluation of the windows.

    A setting differs from cfg in one value, so it is a row of thresholds that the windows' columns are held against: rule A
    fires by its floor alone whatever its other limits say (they decide its severity), rule B anew under its expansion
    limit, and the filters drop fires of rule A after the day's dedupe. All other rules fire as they do under cfg.
    """
    grid, base = grid or TUNED, (cfg or DEFAULTS)["rules"]
    settings = [("base", 0.0)] + [(d, float(v)) for d, (values, _) in grid.items() for v in values]
    named = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("value")) for d, v in settings])).alias("s")
    of_b = windows.where(F.col("minutes") == 1440).select("token_id", "k", *[c for c in ("early_buyers", "smart", "expansion", "buy_usd", "sell_usd")])
    most = F.when(F.col("s.dimension") == "maxMcapExpansion", F.col("s.value")).otherwise(float(base["B"]["max_expansion"]))
    ratio = F.when(F.col("buy_usd") > 0, F.col("sell_usd") / F.col("buy_usd") * 100).otherwise(0.0)
    again = (F.col("early_buyers") >= base["B"]["base_wallets"]) & (F.col("smart") >= base["B"]["target_wallets"]) & F.coalesce(F.col("expansion") + 1 <= most, F.lit(False)) & (ratio <= base["B"]["max_sell_to_buy_pct"])
    b = rules.where("rule = 'B'").select("token_id", "k", "t", "rule").join(of_b, ["token_id", "k"]).select("*", named).where(again).select("s.dimension", "s.value", "token_id", "rule", "t")
    others = rules.where("rule <> 'B' and fired").select("token_id", "rule", "t", named).select("s.dimension", "s.value", "token_id", "rule", "t")
    kept = tm.kept_fires(b.unionByName(others), ["dimension", "value", "token_id", "rule"], "t")
    of_a = windows.where(F.col("minutes") == 30).select("token_id", "t", "entities", "net_usd")
    kept = kept.join(of_a, ["token_id", "t"], "left")
    passes = F.lit(True)
    for d, c in FILTERED.items():
        passes = passes & ((F.col("rule") != "A") | (F.col("dimension") != d) | F.coalesce(F.col(c) >= F.col("value"), F.lit(False)))
    return kept.where(passes).select("dimension", "value", "token_id", "rule", "t")


def tuned_scores(fires: DataFrame, grid: dict | None = None) -> DataFrame:
    """dimension, value, i (order), signals, hits, hit_rate, score, few: of fires of rules A and F with whether they doubled (hit)."""
    settings = [("base", 0.0)] + [(d, float(v)) for d, (values, _) in (grid or TUNED).items() for v in values]
    every = fires.sparkSession.createDataFrame([(d, v, i) for i, (d, v) in enumerate(settings)], "dimension string, value double, i int")
    g = fires.where("rule in ('A', 'F')").groupBy("dimension", "value").agg(F.count("*").alias("signals"), F.count_if("hit").alias("hits"))
    g = F.broadcast(every).join(g, ["dimension", "value"], "left").na.fill(0, ["signals", "hits"])
    rate = F.round(F.when(F.col("signals") > 0, F.col("hits") / F.col("signals")).otherwise(0.0), 6)
    few = F.col("signals") < LEAST_SAMPLE
    return g.select("dimension", "value", "i", "signals", "hits", rate.alias("hit_rate"), F.when(few, 0.0).otherwise(rate).alias("score"), few.alias("few"))
