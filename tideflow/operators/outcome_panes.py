"""Signal outcomes from panes of market points: what a signal sees lies in the pane of its fire, whole panes, and an end's pane.

Points lie in panes of a token and a width of time that holds some PANE_POINTS of them. A signal visits the pane of its fire;
then the extremes of all panes in between, which are rows of a few numbers dealt out by spans of panes; then the panes in
which a horizon ends. The first time at which a multiple reaches a mark lies in the first part that reaches it, and where
that is a whole pane, the signal visits it, too. So points are shuffled by pane alone, a signal is a row a visit, and no
rows are made of a signal's points or of blocks over them. Inside a visit ranges are looked up in doubling tables.

A pane's extreme tells exactly whether a point in it reaches a mark, as dividing by one entry price keeps the order of
prices. Points without a price count for liquidity alone; a signal without an entry price, or with one of 0, has no
multiples; one without points has no row; points at one time are in order of point_id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.operators import outcomes as oc

#: Points that a pane holds on the average, and the widths that it keeps within, in microseconds.
PANE_POINTS = 2048
NARROWEST, WIDEST = 60_000_000, 48 * 3_600_000_000
#: Spans that a reach of seven days covers, about: a pane's extremes go to that many.
SPANS = 8
REACH = max(oc.HORIZONS.values()) * 60_000_000

#: What is looked for first: name, and the marks on multiples from above and below.
RISES = {"small": oc.PLUS_50, "good": oc.GOOD, "major": oc.MAJOR, "ten": oc.TEN}
FALLS = {"fall": oc.SMALL_DROP, "deep": oc.MAJOR_DROP}
MARKS = (*RISES, *FALLS, "gone")
#: Marks whose time is told; peak: the first point of the highest price.
TIMED = ("good", "major", "ten", "peak")
_PANE = "pane long, hi double, lo double, last double, liquidity double, first_liquidity double"


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


class _Series:
    """Values in order of time, for the best of a range and the first place in a range that reaches something."""

    def __init__(self, values: np.ndarray, best: np.ufunc, none: float) -> None:
        v = np.where(np.isnan(values), none, values)
        self.best, self.none, self.tables = best, none, [v]
        h = 1
        while 2 * h <= len(v):
            t = self.tables[-1]
            self.tables.append(best(t[:-h], t[h:]))
            h *= 2

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The best of each range begin..end - 1; none where that is empty."""
        out = np.full(len(begin), self.none)
        n = end - begin
        size = np.frexp(np.maximum(n, 1).astype(float))[1] - 1
        for h, t in enumerate(self.tables):
            at = np.flatnonzero((n > 0) & (size == h))
            out[at] = self.best(t[begin[at]], t[end[at] - (1 << h)])
        return out

    def first(self, begin: np.ndarray, end: np.ndarray, reached: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The first place in each range whose value reaches, -1 where none does. reached takes a value for each range."""
        at = begin.copy()
        for h in range(len(self.tables) - 1, -1, -1):
            t, to = self.tables[h], at + (1 << h)
            inside = to <= end
            value = np.full(len(at), self.none)
            value[inside] = t[at[inside]]
            at = np.where(inside & ~reached(value), to, at)
        return np.where(at < end, at, -1)


class _Points:
    """Points, or panes of them, in order: highest, lowest, last price and least liquidity of ranges."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, last: np.ndarray, liquidity: np.ndarray) -> None:
        self.hi, self.lo, self.low = _Series(hi, np.maximum, -np.inf), _Series(lo, np.minimum, np.inf), _Series(liquidity, np.minimum, np.inf)
        self.last = np.append(last, np.nan)
        # The place of the last price at or before each place.
        self.told = np.maximum.accumulate(np.where(np.isnan(last), -1, np.arange(len(last))))

    def extremes(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Highest, lowest and last price of each range, nan where it has none."""
        hi, lo = self.hi.of(begin, end), self.lo.of(begin, end)
        some = end > begin
        at = np.full(len(begin), -1)
        at[some] = self.told[end[some] - 1]
        at = np.where(at >= begin, at, -1)
        return np.where(np.isinf(hi), np.nan, hi), np.where(np.isinf(lo), np.nan, lo), self.last[at]

    def marks(self, begin: np.ndarray, end: np.ndarray, entry: np.ndarray, liquidity: np.ndarray) -> dict[str, np.ndarray]:
        """By mark the first place in each range that reaches it, else -1. entry, liquidity: a signal's own, nan if unknown."""
        entry = np.where(entry > 0, entry, np.nan)
        out = {k: self.hi.first(begin, end, lambda v, x=x: v / entry >= x) for k, x in RISES.items()}
        out |= {k: self.lo.first(begin, end, lambda v, x=x: v / entry <= x) for k, x in FALLS.items()}
        left = np.where(liquidity > 0, liquidity * oc.LIQUIDITY_LEFT, -np.inf)
        out["gone"] = self.low.first(begin, end, lambda v: ((v <= left) & np.isfinite(v)) | (v < oc.LEAST_LIQUIDITY))
        return out

    def peak(self, begin: np.ndarray, end: np.ndarray, best: np.ndarray) -> np.ndarray:
        return self.hi.first(begin, end, lambda v: v >= best)


def _num(t: pa.Table, c: str, kind: type = np.float64) -> np.ndarray:
    """A column as numbers; nulls as nan, or -1 for whole numbers."""
    x = t.column(c)
    return np.asarray((x.fill_null(np.nan) if kind is np.float64 else x.fill_null(-1)).to_numpy(), kind)


def _arrow(x: np.ndarray) -> pa.Array:
    """Numbers with nulls for nan, or for -1 of whole numbers."""
    return pa.array(x, mask=np.isnan(x) if x.dtype == np.float64 else x == -1)


def _sorted(points: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, prices and liquidities of a pane's points in order."""
    us, i = _num(points, "us", np.int64), _num(points, "point_id", np.int64)
    order = np.lexsort((i, us))
    return us[order], _num(points, "price")[order], _num(points, "liquidity")[order]


def _pane_row(points: pa.Table) -> pa.Table:
    """A pane's row of extremes."""
    _, price, liquidity = _sorted(points)
    told = price[~np.isnan(price)]
    low = liquidity[~np.isnan(liquidity)]
    of = lambda x, f: np.array([f(x) if len(x) else np.nan])
    values = [of(told, np.max), of(told, np.min), of(told, lambda x: x[-1]), of(low, np.min), liquidity[:1]]
    return pa.table([points.column("token_id").slice(0, 1), points.column("pane").slice(0, 1), *[_arrow(v) for v in values]], names=["token_id", "pane", "hi", "lo", "last", "liquidity", "first_liquidity"])


def _panes(panes: pa.Table) -> tuple[np.ndarray, _Points, np.ndarray]:
    """Numbers of panes in order, their extremes, and the liquidity of each one's first point."""
    t = panes.take(pa.array(np.argsort(_num(panes, "pane", np.int64), kind="stable")))
    return _num(t, "pane", np.int64), _Points(_num(t, "hi"), _num(t, "lo"), _num(t, "last"), _num(t, "liquidity")), _num(t, "first_liquidity")


def _prepared(signals: DataFrame, market: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Signals and points by pane, rows of panes by span, and a pane's width."""
    m = market.where("token_id is not null and ts is not null").select("token_id", _us("ts").alias("us"), "point_id", F.col("price").cast("double").alias("price"), F.col("liquidity").cast("double").alias("liquidity"))
    # One row: how dense points are.
    n, tokens, lo, hi = m.agg(F.count("*"), F.approx_count_distinct("token_id"), F.min("us"), F.max("us")).first()
    width = int(min(max(PANE_POINTS * max(tokens, 1) * ((hi or 0) - (lo or 0) + 1) / max(n, 1), NARROWEST), WIDEST))
    span = REACH // width // SPANS + 1
    points = m.withColumn("pane", F.floor(F.col("us") / width))
    s = signals.where("token_id is not null and fired_at is not null").select("signal_id", "token_id", F.col("entry_price").cast("double").alias("entry_price"), _us("fired_at").alias("fired"))
    s = s.withColumn("pane", F.floor(F.col("fired") / width)).withColumn("span", F.floor(F.col("pane") / span))
    rows = points.groupBy("token_id", "pane").applyInArrow(_pane_row, f"token_id {dict(points.dtypes)['token_id']}, {_PANE}")
    back = REACH // width // span + 2
    near = F.floor(F.col("pane") / span)
    return s, points, rows.withColumn("span", F.explode(F.sequence(near - back, near))), width


def _together(signals: DataFrame, others: DataFrame, by: str, visit: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return signals.groupBy("token_id", by).cogroup(others.groupBy("token_id", by)).applyInArrow(visit, schema)


def _kinds(signals: DataFrame) -> str:
    types = {f.name: f.dataType.simpleString() for f in signals.schema.fields}
    return f"signal_id {types['signal_id']}, token_id {types['token_id']}, entry_price double, fired long, pane long, span long"


def _join(a: tuple, b: tuple) -> tuple:
    """Extremes of a range and of one after it."""
    return np.fmax(a[0], b[0]), np.fmin(a[1], b[1]), np.where(np.isnan(b[2]), a[2], b[2])


_EXTREMES = ("hi", "lo", "last")
_OWN = ("signal_id", "token_id", "entry_price", "fired", "pane", "span")
_FOUND = [f"{k}_at" for k in (*MARKS, "peak")] + [f"{k}_us" for k in TIMED]
_VISIT = "some boolean, hi double, lo double, last double, entry_liquidity double"


def _placed(pane: np.ndarray, at: np.ndarray, us: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a pane as numbers that order points of all panes, and their times; -1 for none."""
    return np.where(at >= 0, ((pane + (1 << 29)) << 32) + at, -1), np.where(at >= 0, np.append(us, -1)[at], -1)


def _head(signals: pa.Table, points: pa.Table) -> pa.Table:
    """The pane of a fire: its points from the fire on."""
    us, price, liquidity = _sorted(points)
    p, fired, entry, pane = _Points(price, price, price, liquidity), _num(signals, "fired", np.int64), _num(signals, "entry_price"), _num(signals, "pane", np.int64)
    begin, end = np.searchsorted(us, fired, "left"), np.searchsorted(us, fired + REACH, "right")
    some = begin < end
    first = np.where(some, np.append(liquidity, np.nan)[begin], np.nan)
    hi, lo, last = p.extremes(begin, end)
    found = p.marks(begin, end, entry, first) | {"peak": p.peak(begin, end, hi)}
    placed = {k: _placed(pane, v, us) for k, v in found.items()}
    cols = [signals.column(c) for c in _OWN] + [pa.array(some)] + [_arrow(x) for x in (hi, lo, last, first)] + [_arrow(placed[k][0]) for k in (*MARKS, "peak")] + [_arrow(placed[k][1]) for k in TIMED]
    return pa.table(cols, names=[*_OWN, "some", *_EXTREMES, "entry_liquidity", *_FOUND])


def _middle(width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Whole panes up to the one in which seven days end: what they hold, and a row for each pane that a signal visits next.

    The row of the end's pane carries what is known; the others ask for marks, bit by bit in order of MARKS and peak.
    """

    def visit(signals: pa.Table, panes: pa.Table) -> pa.Table:
        number, p, opening = _panes(panes)
        fired, entry, own = _num(signals, "fired", np.int64), _num(signals, "entry_price"), _num(signals, "pane", np.int64)
        ends = (fired + REACH) // width
        begin = np.searchsorted(number, own, "right")
        end = np.maximum(begin, np.searchsorted(number, ends, "left"))
        some = signals.column("some").to_numpy()
        first = np.where(some, _num(signals, "entry_liquidity"), np.where(begin < end, np.append(opening, np.nan)[np.minimum(begin, len(opening))], np.nan))
        head = tuple(_num(signals, c) for c in _EXTREMES)
        hi, lo, last = p.extremes(begin, end)
        merged = _join(head, (hi, lo, last))
        asked = p.marks(begin, end, entry, first)
        for k in MARKS:
            asked[k] = np.where(_num(signals, f"{k}_at", np.int64) >= 0, -1, asked[k])
        higher = (hi > head[0]) | (np.isnan(head[0]) & ~np.isnan(hi))
        asked["peak"] = np.where(higher, p.peak(begin, end, hi), -1)
        # A row for each signal and pane that it asks, with the bits of what it asks for.
        who = np.concatenate([np.flatnonzero(v >= 0) for v in asked.values()])
        where = np.concatenate([v[v >= 0] for v in asked.values()])
        bits = np.concatenate([np.full(int((v >= 0).sum()), 1 << i) for i, v in enumerate(asked.values())])
        key, back = np.unique(who * max(1, len(number)) + where, return_inverse=True)
        mask = np.zeros(len(key), np.int64)
        np.bitwise_or.at(mask, back, bits)
        who, where = key // max(1, len(number)), key % max(1, len(number))
        m, n = len(fired), len(key)
        rows = pa.array(np.concatenate([np.arange(m), who]))
        visited = np.concatenate([ends, number[where]])
        carried = np.arange(m + n) < m
        only = lambda x: np.where(carried, np.concatenate([x, np.zeros(n, x.dtype)]), np.nan if x.dtype == np.float64 else -1)
        t = signals.take(rows)
        known = some | (begin < end)
        best = np.concatenate([merged[0], hi[who]])  # what a peak is looked for by
        # A peak in whole panes is higher than the head's.
        heads = {c: _num(signals, c, np.int64) for c in _FOUND}
        for c in ("peak_at", "peak_us"):
            heads[c] = np.where(higher, -1, heads[c])
        cols = [t.column(c) for c in ("signal_id", "token_id", "entry_price", "fired")] + [pa.array(visited), pa.array(np.concatenate([np.zeros(m, np.int64), mask])), pa.array(np.concatenate([known, np.ones(n, bool)]))]
        cols += [_arrow(best), _arrow(only(merged[1])), _arrow(only(merged[2])), _arrow(np.concatenate([first, first[who]]))] + [_arrow(only(heads[c])) for c in _FOUND]
        return pa.table(cols, names=["signal_id", "token_id", "entry_price", "fired", "pane", "asked", "some", *_EXTREMES, "entry_liquidity", *_FOUND])

    return visit


def _last(signals: pa.Table, points: pa.Table) -> pa.Table:
    """The pane in which seven days end, and the panes in which a mark is reached: the points themselves."""
    us, price, liquidity = _sorted(points)
    p, fired, entry, pane = _Points(price, price, price, liquidity), _num(signals, "fired", np.int64), _num(signals, "entry_price"), _num(signals, "pane", np.int64)
    asked, some = _num(signals, "asked", np.int64), signals.column("some").to_numpy()
    carried = asked == 0
    # The end's pane was the fire's if that reached so far.
    begin, end = np.searchsorted(us, fired, "left"), np.searchsorted(us, fired + REACH, "right")
    before = tuple(_num(signals, c) for c in _EXTREMES)
    first = np.where(some | (begin >= end), _num(signals, "entry_liquidity"), np.append(liquidity, np.nan)[begin])
    tail = p.extremes(begin, end)
    hi, lo, last = (np.where(carried, x, np.nan) for x in _join(before, tail))
    found = p.marks(begin, end, entry, first) | {"peak": p.peak(begin, end, np.where(carried, tail[0], before[0]))}
    higher = (tail[0] > before[0]) | (np.isnan(before[0]) & ~np.isnan(tail[0]))
    placed = {}
    for i, k in enumerate((*MARKS, "peak")):
        wanted = (asked >> i & 1) == 1
        own = np.where(wanted | (carried & (higher if k == "peak" else True)), found[k], -1)
        at, when = _placed(pane, own, us)
        told = _num(signals, f"{k}_at", np.int64)
        keep = carried & (told >= 0) & ~(higher if k == "peak" else False)
        placed[f"{k}_at"] = np.where(keep, told, at)
        if k in TIMED:
            placed[f"{k}_us"] = np.where(keep, _num(signals, f"{k}_us", np.int64), when)
    cols = [signals.column("signal_id"), pa.array(carried), pa.array(some | (begin < end)), signals.column("entry_price"), signals.column("fired")] + [_arrow(x) for x in (hi, lo, last)] + [_arrow(placed[c]) for c in _FOUND]
    return pa.table(cols, names=["signal_id", "carried", "some", "entry_price", "fired", *_EXTREMES, *_FOUND])


def judged(signals: DataFrame, market: DataFrame) -> DataFrame:
    """signal_id, label, max_upside_pct, max_drawdown_pct, roi_pct, to_peak, to_2x, to_5x, to_10x over seven days.

    signals: signal_id, token_id, fired_at, entry_price; the entry's liquidity is that of the first point at or after the
    fire. market: token_id, ts, point_id, price, liquidity.
    """
    s, points, panes, width = _prepared(signals, market)
    own, found = _kinds(s), ", ".join(f"{c} long" for c in _FOUND)
    heads = _together(s, points, "pane", _head, f"{own}, {_VISIT}, {found}")
    asks = _together(heads, panes, "span", _middle(width), f"{own.replace('span long', 'asked long')}, {_VISIT}, {found}")
    kind = own.split(", token_id ")[0]
    rows = _together(asks, points, "pane", _last, f"{kind}, carried boolean, some boolean, entry_price double, fired long, hi double, lo double, last double, {found}")
    # One carried row a signal; the first of a mark's places is the mark's.
    once = lambda c: F.max(F.when(F.col("carried"), F.col(c))).alias(c)
    out = rows.groupBy("signal_id").agg(*[once(c) for c in ("some", "entry_price", "fired", *_EXTREMES)], *[F.min(c).alias(c) for c in _FOUND if not c.startswith("peak")], F.max("peak_us").alias("peak_us")).where("some")
    # a comes before b, or b doesn't come: equal places are one point, which neither spoils nor is spoiled.
    free = lambda a, b: F.col(f"{a}_at").isNotNull() & (F.col(f"{b}_at").isNull() | (F.col(f"{a}_at") <= F.col(f"{b}_at")))
    label = F.when(free("gone", "good"), "hard_failure").when(free("major", "deep"), "major_win").when(free("good", "fall"), "good_win").when(free("small", "fall"), "small_win").when(free("deep", "good"), "failure").otherwise("neutral_pending")
    entry = F.when(F.col("entry_price") > 0, F.col("entry_price"))
    minutes = lambda us: F.round((us - F.col("fired")) / 60_000_000.0, 6)
    pct = lambda x: F.round((x / entry - 1) * 100, 6)
    return out.select(
        "signal_id", label.alias("label"), pct(F.col("hi")).alias("max_upside_pct"), pct(F.col("lo")).alias("max_drawdown_pct"), pct(F.col("last")).alias("roi_pct"),
        F.when(entry.isNotNull(), minutes(F.col("peak_us"))).alias("to_peak"), *[minutes(F.col(f"{k}_us")).alias(name) for k, name in (("good", "to_2x"), ("major", "to_5x"), ("ten", "to_10x"))],
    )


_AFTER = np.array([v * 60_000_000 for v in oc.HORIZONS.values()])
_BY_HORIZON = [f"{c}_{h}" for h in range(len(_AFTER)) for c in _EXTREMES]


def _slice_head(signals: pa.Table, points: pa.Table) -> pa.Table:
    """The pane of a fire, up to each horizon."""
    us, price, liquidity = _sorted(points)
    p, fired = _Points(price, price, price, liquidity), _num(signals, "fired", np.int64)
    begin = np.searchsorted(us, fired, "left")
    found = [_arrow(x) for after in _AFTER for x in p.extremes(begin, np.searchsorted(us, fired + after, "right"))]
    return pa.table([signals.column(c) for c in _OWN] + found, names=[*_OWN, *_BY_HORIZON])


def _slice_middle(width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Whole panes up to each horizon's; a row a horizon, at the pane in which it ends."""

    def visit(signals: pa.Table, panes: pa.Table) -> pa.Table:
        number, p, _ = _panes(panes)
        fired, own = _num(signals, "fired", np.int64), _num(signals, "pane", np.int64)
        begin, parts = np.searchsorted(number, own, "right"), []
        for h, after in enumerate(_AFTER):
            ends = (fired + after) // width
            mid = p.extremes(begin, np.maximum(begin, np.searchsorted(number, ends, "left")))
            known = _join(tuple(_num(signals, f"{c}_{h}") for c in _EXTREMES), mid)
            cols = [signals.column(c) for c in ("signal_id", "token_id", "entry_price", "fired")] + [pa.array(ends), pa.array(ends == own), pa.array(np.full(len(fired), h, np.int32))] + [_arrow(x) for x in known]
            parts.append(pa.table(cols, names=["signal_id", "token_id", "entry_price", "fired", "pane", "over", "h", *_EXTREMES]))
        return pa.concat_tables(parts)

    return visit


def _slice_last(signals: pa.Table, points: pa.Table) -> pa.Table:
    """The pane in which a horizon ends, unless that is the fire's."""
    us, price, liquidity = _sorted(points)
    p, h = _Points(price, price, price, liquidity), _num(signals, "h", np.int64)
    end = np.searchsorted(us, _num(signals, "fired", np.int64) + _AFTER[h], "right")
    end = np.where(signals.column("over").to_numpy(), 0, end)
    known = _join(tuple(_num(signals, c) for c in _EXTREMES), p.extremes(np.zeros_like(end), end))
    return pa.table([signals.column(c) for c in ("signal_id", "entry_price", "h")] + [_arrow(x) for x in known], names=["signal_id", "entry_price", "h", *_EXTREMES])


def horizon_slices(signals: DataFrame, market: DataFrame) -> DataFrame:
    """signal_id, horizon, max_upside_pct, max_drawdown_pct, roi_pct, for each horizon up to which a signal has a multiple."""
    s, points, panes, width = _prepared(signals.where("entry_price > 0"), market)
    own = _kinds(s)
    heads = _together(s, points, "pane", _slice_head, f"{own}, " + ", ".join(f"{c} double" for c in _BY_HORIZON))
    asks = _together(heads, panes, "span", _slice_middle(width), own.replace("span long", "over boolean, h int, hi double, lo double, last double"))
    kind = own.split(", token_id ")[0]
    out = _together(asks, points, "pane", _slice_last, f"{kind}, entry_price double, h int, hi double, lo double, last double").where("hi is not null")
    pct = lambda x: F.round((x / F.col("entry_price") - 1) * 100, 6)
    name = F.element_at(F.array(*[F.lit(k) for k in oc.HORIZONS]), F.col("h") + 1)
    return out.select("signal_id", name.alias("horizon"), pct(F.col("hi")).alias("max_upside_pct"), pct(F.col("lo")).alias("max_drawdown_pct"), pct(F.col("last")).alias("roi_pct"))
