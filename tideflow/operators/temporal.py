"""Latest-per-key, as-of and interval operators, without per-row look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nth_by(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """Each key's n-th row in an order that ends with a unique column."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == n).drop("_n")


def latest(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Each key's latest row: an aggregate, so that rows are combined before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, ts, tie)]
    return df.groupBy(*keys).agg(F.max(F.struct(ts, tie, *rest)).alias("_m")).select(*keys, "_m.*")


def _pane(micros: Column, seconds: int) -> Column:
    """The start of a time's pane, in microseconds."""
    return micros - F.pmod(micros, F.lit(seconds * 1_000_000))


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, tie: str, values: list[str], forward: bool = False, pane: int = 3600) -> DataFrame:
    """Each left row with values of the last right row at or before its time (forward: the first at or after).

    A prefix scan: rows are sorted in panes of a key and so many seconds, and each pane starts with the last row of the panes
    before it. So a key's history is dealt out over tasks; only one row a key and pane is walked in time. No pairs are formed.
    Left rows without a time find nothing, right rows without one are never found; null keys equal each other. left is read
    twice, so save one that is dear.
    """
    at = lambda c: _pane(F.unix_micros(F.col(c).cast("timestamp")), pane).alias("_pane")
    row = F.struct(F.col(right_ts).alias("_rt"), *values)
    empty = F.lit(None).cast(right.select(row.alias("x")).schema["x"].dataType)
    a = left.select(*keys, at(left_ts), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), F.struct(*left.columns).alias("_left"), empty.alias("_row"))
    none = F.lit(None).cast(a.schema["_left"].dataType).alias("_left")
    b = right.where(F.col(right_ts).isNotNull()).select(*keys, at(right_ts), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), none, row.alias("_row"))

    last = (F.min if forward else F.max)(F.struct("_t", "_tie", "_row")).alias("_end")
    ends = b.groupBy(*keys, "_pane").agg(last)
    asked = a.select(*keys, "_pane").distinct()
    panes = ends.unionByName(asked.withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))).groupBy(*keys, "_pane").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy(*keys).orderBy(F.desc("_pane") if forward else F.asc("_pane")).rowsBetween(Window.unboundedPreceding, -1)
    carried = panes.withColumn("_end", F.last("_end", ignorenulls=True).over(before)).where("_end is not null and _pane is not null")
    carried = carried.select(*keys, "_pane", F.col("_end._t").alias("_t"), F.lit(0).alias("_side"), F.col("_end._tie").alias("_tie"), none, F.col("_end._row").alias("_row"))

    # Forward is the same walk from the end, so that the frame grows with each row instead of being scanned anew.
    order = [F.desc("_t"), "_side", F.desc("_tie")] if forward else ["_t", "_side", "_tie"]
    frame = Window.partitionBy(*keys, "_pane").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).unionByName(carried).withColumn("_found", F.last("_row", ignorenulls=True).over(frame)).where("_left is not null")
    return out.select("_left.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def running(changes: DataFrame, asks: DataFrame, keys: list[str], t: str, value: str, pane: int = 3600) -> DataFrame:
    """asks with value: the sum of changes of equal keys up to their time, theirs included; 0 where there are none.

    t is in microseconds, value a long. A prefix scan like asof's: sums of panes are carried forward, so that a key's
    history is dealt out. Null keys equal each other; an ask without a time has 0.
    """
    at = _pane(F.col(t), pane).alias("_pane")
    c = changes.where(F.col(t).isNotNull()).groupBy(*keys, t).agg(F.sum(value).alias("_d")).select(*keys, at, F.col(t).alias("_t"), "_d")
    a = asks.select(*keys, at, F.col(t).alias("_t"), F.lit(0).cast("long").alias("_d"), F.struct(*asks.columns).alias("_ask"))
    none = F.lit(None).cast(a.schema["_ask"].dataType).alias("_ask")
    panes = c.select(*keys, "_pane", "_d").unionByName(a.select(*keys, "_pane", "_d")).groupBy(*keys, "_pane").agg(F.sum("_d").alias("_d"))
    before = Window.partitionBy(*keys).orderBy("_pane").rowsBetween(Window.unboundedPreceding, -1)
    carried = panes.select(*keys, "_pane", F.col("_pane").alias("_t"), F.sum("_d").over(before).alias("_d")).where("_d <> 0 and _pane is not null")
    frame = Window.partitionBy(*keys, "_pane").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(c.select("*", none)).unionByName(carried.select("*", none)).withColumn("_sum", F.sum("_d").over(frame)).where("_ask is not null")
    return out.select("_ask.*", F.col("_sum").alias(value))


def asof_or_first(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, tie: str, value: str, default: Column) -> DataFrame:
    """As-of, else the earliest value after, else a default."""
    back = asof(left, right, keys, left_ts, right_ts, tie, [value]).withColumnRenamed(value, "_back")
    both = asof(back, right, keys, left_ts, right_ts, tie, [value], forward=True)
    return both.withColumn(value, F.coalesce("_back", value, default)).drop("_back")


def within(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, seconds: int) -> DataFrame:
    """Pairs with equal keys and right_ts in [left_ts, left_ts + seconds]: an equi-join on time buckets of that width.

    Column names of the sides must differ but for the keys.
    """
    bucket = lambda c: F.expr(f"unix_micros(cast({c} as timestamp)) div {seconds * 1_000_000}")
    a = left.withColumn("_b", F.explode(F.array(bucket(left_ts), bucket(left_ts) + 1)))
    b = right.withColumn("_b", bucket(right_ts))
    gap = F.unix_micros(F.col(right_ts).cast("timestamp")) - F.unix_micros(F.col(left_ts).cast("timestamp"))
    return a.join(b, [*keys, "_b"]).where(gap.between(0, seconds * 1_000_000)).drop("_b")


def kept_fires(fires: DataFrame, keys: list[str], ts: str, hours: int = 24, closed: bool = False) -> DataFrame:
    """Fires that are not suppressed by the last kept one of their key less than hours ago: a fold over each key's times.

    closed: one exactly so many hours ago suppresses, too.
    """
    start = F.struct(F.lit(None).cast("timestamp_ntz").alias("last"), F.expr("cast(array() as array<timestamp_ntz>)").alias("kept"))
    end = lambda acc: acc["last"] + F.expr(f"INTERVAL {hours} HOURS")
    free = lambda acc, t: acc["last"].isNull() | ((t > end(acc)) if closed else (t >= end(acc)))
    fold = F.aggregate(F.array_sort(F.collect_set(ts)), start, lambda acc, t: F.when(free(acc, t), F.struct(t.alias("last"), F.concat(acc["kept"], F.array(t)).alias("kept"))).otherwise(acc))
    return fires.groupBy(*keys).agg(fold["kept"].alias("kept")).select(*keys, F.explode("kept").alias(ts))
