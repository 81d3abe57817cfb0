"""Signal outcomes from an index over market points: highest and lowest price, last price and lowest liquidity by block.

A token's points are numbered in order of time, and blocks of 16, 256, 4096 ... of them keep their extremes. A signal's
days after its fire are a range of numbers, and the range between one horizon and the next is a few blocks of each size,
so a signal reads blocks by the logarithm of its points instead of the points. The first time at which a multiple reaches
a mark lies in the first block whose extreme reaches it, and is found by going down that block's parts.

Numbers are counted within hours first and moved by the hours before, and times are turned into numbers the same way, so
no token's history is one task. A block's extreme tells exactly whether a point in it reaches a mark, as dividing by one
entry price keeps the order of prices. Points without a price count for liquidity alone; a signal without an entry price,
or with one of 0, has no multiples; one without points has no row; points at one time are in order of point_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideflow.operators import outcomes as oc
from tideflow.sources.shared import saved, small_or_shuffled

#: Blocks of a size that make up one of the next, as a power of two.
FAN_BITS = 4
HOUR_US = 3_600_000_000

#: What is looked for first: name, and the marks on multiples from above and below.
RISES = {"small": oc.PLUS_50, "good": oc.GOOD, "major": oc.MAJOR, "ten": oc.TEN}
FALLS = {"fall": oc.SMALL_DROP, "deep": oc.MAJOR_DROP}
MARKS = (*RISES, *FALLS, "gone")


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def numbered(market: DataFrame, times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token_id, n, us, price, liquidity) of points, and times (token_id, us, strict, ...) with n: points at or before us.

    strict: points before us alone.
    """
    m = market.where("token_id is not null and ts is not null").select("token_id", _us("ts").alias("us"), "point_id", "price", "liquidity")
    hour = F.floor(F.col("us") / HOUR_US).alias("hour")
    m, q = m.withColumn("hour", hour), times.withColumn("hour", hour)
    counts = m.groupBy("token_id", "hour").agg(F.count("*").alias("c")).unionByName(q.select("token_id", "hour").distinct().withColumn("c", F.lit(0).cast("long")))
    counts = counts.groupBy("token_id", "hour").agg(F.sum("c").alias("c"))
    before = Window.partitionBy("token_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    moved = saved(counts.select("token_id", "hour", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("moved")))
    own = Window.partitionBy("token_id", "hour").orderBy("us", "point_id")
    points = m.withColumn("n", F.row_number().over(own) - 1).join(moved, ["token_id", "hour"]).select("token_id", (F.col("n") + F.col("moved")).alias("n"), "us", "price", "liquidity")
    rest = F.struct(*[c for c in times.columns if c not in ("token_id", "us", "strict")]).alias("rest")
    side = F.when(F.col("strict"), 0).otherwise(2).alias("side")
    empty = F.lit(None).cast(q.select(rest).schema["rest"].dataType).alias("rest")
    both = q.select("token_id", "hour", "us", side, rest).unionByName(m.select("token_id", "hour", "us", F.lit(1).alias("side"), empty))
    along = Window.partitionBy("token_id", "hour").orderBy("us", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("c", F.count_if(F.col("side") == 1).over(along)).where("side <> 1").join(moved, ["token_id", "hour"])
    return points, both.select("token_id", (F.col("c") + F.col("moved")).alias("n"), "rest.*")


def index(points: DataFrame) -> tuple[DataFrame, int]:
    """(token_id, level, node, hi, lo, last, liquidity, us) of points and all blocks over them, and the highest level.

    last: the number of the last point with a price; us: a point's time. All columns are plain numbers, so that sums over
    blocks are hash aggregates.
    """
    base = saved(points.select("token_id", F.col("n").alias("node"), F.col("price").alias("hi"), F.col("price").alias("lo"), F.when(F.col("price").isNotNull(), F.col("n")).alias("last"), "liquidity", "us"))
    most = base.agg(F.max("node")).first()[0] or 0
    top = max(0, -(-int(most).bit_length() // FAN_BITS))
    levels = [base]
    for _ in range(top):
        up = levels[-1].groupBy("token_id", F.shiftright("node", FAN_BITS).alias("node")).agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.max("last").alias("last"), F.min("liquidity").alias("liquidity"), F.lit(None).cast("long").alias("us"))
        levels.append(saved(up))
    out = levels[0].withColumn("level", F.lit(0))
    for h, level in enumerate(levels[1:], 1):
        out = out.unionByName(level.withColumn("level", F.lit(h)))
    return out, top


def _blocks(begin: Column, end: Column, top: int) -> Column:
    """The blocks (level, node) that cover numbers begin..end - 1."""
    parts, none = [], F.array().cast("array<bigint>")
    bounds = [(F.shiftright(begin + ((1 << h * FAN_BITS) - 1), h * FAN_BITS), F.shiftright(end, h * FAN_BITS)) for h in range(top + 1)]
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    for h, (lo, hi) in enumerate(bounds):
        if h < top:
            up_lo, up_hi = (F.shiftleft(x, FAN_BITS) for x in bounds[h + 1])
            nodes = F.when(up_lo < up_hi, F.concat(span(lo, up_lo), span(up_hi, hi))).otherwise(span(lo, hi))
        else:
            nodes = span(lo, hi)
        level = F.lit(h).alias("level")
        parts.append(F.transform(nodes, lambda x: F.struct(level, x.cast("long").alias("node"))))  # noqa: B023
    return F.concat(*parts)


def _reached() -> dict[str, Column]:
    """By mark, whether a block or point holds one that reaches it."""
    entry, liquidity = F.when(F.col("entry_price") > 0, F.col("entry_price")), F.col("liquidity")
    said = {k: F.col("hi") / entry >= x for k, x in RISES.items()} | {k: F.col("lo") / entry <= x for k, x in FALLS.items()}
    said["gone"] = ((F.col("entry_liquidity") > 0) & (liquidity <= F.col("entry_liquidity") * oc.LIQUIDITY_LEFT)) | (liquidity < oc.LEAST_LIQUIDITY)
    return {k: F.coalesce(v, F.lit(False)) for k, v in said.items()}


def _place() -> Column:
    """A block's first number and level in one number, which orders blocks by where they start."""
    return F.expr(f"shiftleft(shiftleft(node, level * {FAN_BITS}), 6) + level")


def _block(place: str) -> list[Column]:
    """The level and node of a place."""
    level = F.col(place) % 64
    return [level.cast("int").alias("level"), F.expr(f"shiftright({place}, cast(6 + {place} % 64 * {FAN_BITS} AS int))").alias("node")]


def _segments(signals: DataFrame, market: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(id, seg, token_id, entry_price, entry_liquidity, begin, end): ranges between horizons; and the index with its height."""
    ends = F.array(F.struct(F.lit(-1).alias("seg"), F.lit(0).cast("long").alias("after")), *[F.struct(F.lit(i).alias("seg"), F.lit(v * 60_000_000).cast("long").alias("after")) for i, v in enumerate(oc.HORIZONS.values())])
    s = signals.where("token_id is not null and fired_at is not null").select("signal_id", "token_id", "fired_at", "entry_price", _us("fired_at").alias("fired"))
    times = s.select("token_id", "signal_id", "fired", "entry_price", F.explode(ends).alias("e")).select("token_id", (F.col("fired") + F.col("e.after")).alias("us"), (F.col("e.seg") < 0).alias("strict"), "signal_id", "fired", "entry_price", "e.seg")
    points, counted = numbered(market, times)
    nodes, top = index(points)
    nodes = small_or_shuffled(nodes)
    own = Window.partitionBy("signal_id").orderBy("seg")
    ranges = counted.withColumn("begin", F.lag("n").over(own)).withColumn("start", F.first("n").over(own)).where("seg >= 0").withColumnRenamed("n", "end")
    first = nodes.where("level = 0").select("token_id", F.col("node").alias("start"), F.col("liquidity").alias("entry_liquidity"))
    return saved(ranges.join(first, ["token_id", "start"])), nodes, top


def _looked(ranges: DataFrame, nodes: DataFrame, top: int, *more: str) -> DataFrame:
    """Rows of ranges, each with the blocks that cover it."""
    blocks = ranges.where("begin < end").select("signal_id", "seg", "token_id", "entry_price", "entry_liquidity", *more, F.explode(_blocks(F.col("begin"), F.col("end"), top)).alias("b")).select("*", "b.level", "b.node").drop("b")
    return blocks.join(nodes.drop("us"), ["token_id", "level", "node"])


def _gathered(ranges: DataFrame, nodes: DataFrame, top: int, marks: bool = True) -> DataFrame:
    """By signal and segment: extremes, the last point with a price, and by mark the first block that reaches it."""
    firsts = [F.min(F.when(v, _place())).alias(k) for k, v in _reached().items()] if marks else []
    return _looked(ranges, nodes, top).groupBy("signal_id", "seg").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.max("last").alias("last"), *firsts)


def _last_price(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows (token_id, last) with the price of the point that last numbers."""
    price = nodes.where("level = 0").select("token_id", F.col("node").alias("last"), F.col("lo").alias("last_price"))
    return rows.join(price, ["token_id", "last"], "left")


def _found(firsts: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    """signal_id, mark, n, us: the first point that reaches each mark, from the place of a block that holds it."""
    keep = ("signal_id", "mark", "token_id", "entry_price", "entry_liquidity", "best")
    here = firsts.select(*keep, *_block("place"))
    for level in range(top, 0, -1):
        at, rest = here.where(F.col("level") == level), here.where(F.col("level") < level)
        parts = at.select(*keep, F.explode(F.sequence(F.shiftleft("node", FAN_BITS), F.shiftleft("node", FAN_BITS) + ((1 << FAN_BITS) - 1))).alias("child"))
        below = nodes.where(F.col("level") == level - 1).select("token_id", F.col("node").alias("child"), "hi", "lo", "liquidity")
        holds = (F.col("mark") == "peak") & (F.col("hi") == F.col("best"))
        for k, v in _reached().items():
            holds = holds | ((F.col("mark") == k) & v)
        down = parts.join(below, ["token_id", "child"]).where(holds).groupBy("signal_id", "mark").agg(F.min("child").alias("node"), *[F.first(c).alias(c) for c in keep[2:]])
        here = rest.unionByName(down.withColumn("level", F.lit(level - 1)))
    base = nodes.where("level = 0").select("token_id", "node", "us")
    return here.join(base, ["token_id", "node"]).select("signal_id", "mark", F.col("node").alias("n"), "us")


def judged(signals: DataFrame, market: DataFrame) -> DataFrame:
    """signal_id, label, max_upside_pct, max_drawdown_pct, roi_pct, to_peak, to_2x, to_5x, to_10x over seven days.

    signals: signal_id, token_id, fired_at, entry_price; the entry's liquidity is that of the first point at or after the
    fire. market: token_id, ts, point_id, price, liquidity.
    """
    ranges, nodes, top = _segments(signals, market)
    by_range = saved(_gathered(ranges, nodes, top))
    of = ranges.groupBy("signal_id").agg(*[F.first(c).alias(c) for c in ("token_id", "fired", "entry_price", "entry_liquidity")])
    g = saved(by_range.groupBy("signal_id").agg(F.max("hi").alias("best"), F.min("lo").alias("lo"), F.max("last").alias("last"), *[F.min(k).alias(k) for k in MARKS]).join(of, "signal_id"))
    # The first block that holds the best price, in the first range that does.
    peak = by_range.join(g.select("signal_id", "best"), "signal_id").where("hi = best").groupBy("signal_id", "best").agg(F.min("seg").alias("seg"))
    peak = _looked(ranges.join(peak, ["signal_id", "seg"]), nodes, top, "best").where("hi = best").groupBy("signal_id").agg(F.min(_place()).alias("peak"))
    places = F.explode(F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("mark"), F.col(k).alias("place"))) for k in (*MARKS, "peak")]))).alias("m")
    firsts = g.join(peak, "signal_id", "left").select("signal_id", "token_id", "entry_price", "entry_liquidity", "best", places).select("*", "m.*")
    at = lambda k, c: F.min(F.when(F.col("mark") == k, F.col(c)))
    found = _found(firsts, nodes, top).groupBy("signal_id").agg(*[at(k, "n").alias(f"{k}_at") for k in MARKS], *[at(k, "us").alias(f"{k}_us") for k in ("good", "major", "ten", "peak")])
    out = _last_price(g, nodes).join(found, "signal_id", "left")
    # a comes before b, or b doesn't come: equal places are one point, which neither spoils nor is spoiled.
    free = lambda a, b: F.col(f"{a}_at").isNotNull() & (F.col(f"{b}_at").isNull() | (F.col(f"{a}_at") <= F.col(f"{b}_at")))
    label = F.when(free("gone", "good"), "hard_failure").when(free("major", "deep"), "major_win").when(free("good", "fall"), "good_win").when(free("small", "fall"), "small_win").when(free("deep", "good"), "failure").otherwise("neutral_pending")
    entry = F.when(F.col("entry_price") > 0, F.col("entry_price"))
    minutes = lambda us: F.round((us - F.col("fired")) / 60_000_000.0, 6)
    pct = lambda x: F.round((x / entry - 1) * 100, 6)
    return out.select(
        "signal_id", label.alias("label"), pct(F.col("best")).alias("max_upside_pct"), pct(F.col("lo")).alias("max_drawdown_pct"), pct(F.col("last_price")).alias("roi_pct"),
        F.when(entry.isNotNull(), minutes(F.col("peak_us"))).alias("to_peak"), *[minutes(F.col(f"{k}_us")).alias(name) for k, name in (("good", "to_2x"), ("major", "to_5x"), ("ten", "to_10x"))],
    )


def horizon_slices(signals: DataFrame, market: DataFrame) -> DataFrame:
    """signal_id, horizon, max_upside_pct, max_drawdown_pct, roi_pct, for each horizon up to which a signal has a multiple."""
    ranges, nodes, top = _segments(signals, market)
    of = ranges.groupBy("signal_id").agg(*[F.first(c).alias(c) for c in ("token_id", "entry_price")]).where("entry_price > 0")
    # A horizon holds the ranges up to its own: at most six rows a signal.
    upto = F.explode(F.sequence("seg", F.lit(len(oc.HORIZONS) - 1))).alias("h")
    g = _gathered(ranges, nodes, top, marks=False).select("signal_id", "hi", "lo", "last", upto).groupBy("signal_id", "h").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.max("last").alias("last")).where("hi is not null")
    pct = lambda x: F.round((x / F.col("entry_price") - 1) * 100, 6)
    name = F.element_at(F.array(*[F.lit(k) for k in oc.HORIZONS]), F.col("h") + 1)
    return _last_price(g.join(of, "signal_id"), nodes).select("signal_id", name.alias("horizon"), pct(F.col("hi")).alias("max_upside_pct"), pct(F.col("lo")).alias("max_drawdown_pct"), pct(F.col("last_price")).alias("roi_pct"))
