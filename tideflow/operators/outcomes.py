"""What became of signals: the marks they are judged by, summaries and buckets; outcome_index finds the outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Horizons in minutes, and the multiples that outcomes are judged by.
HORIZONS = {"M15": 15, "H1": 60, "H6": 360, "H24": 1440, "D3": 4320, "D7": 10080}
PLUS_50, GOOD, MAJOR, TEN, SMALL_DROP, MAJOR_DROP = 1.5, 2.0, 5.0, 10.0, 0.5, 0.4
LEAST_LIQUIDITY, LIQUIDITY_LEFT = 1000.0, 0.1


def summary_columns() -> list[Column]:
    """Hit rates, exact median and mean return, extremes and failure rates; money-free doubles are rounded exactly."""
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    up = F.col("max_upside_pct")
    return [
        F.count("*").alias("signals"),
        rate(up >= 50).alias("hit_50"),
        rate(up >= 100).alias("hit_2x"),
        rate(up >= 400).alias("hit_5x"),
        F.round(F.percentile("roi_pct", F.lit(0.5)), 4).alias("median_return"),
        F.round(F.avg(F.col("roi_pct").cast("decimal(24,6)")).cast("double"), 4).alias("avg_return"),
        F.max("max_upside_pct").alias("max_upside"),
        F.min("max_drawdown_pct").alias("max_drawdown"),
        rate(F.col("label") == "failure").alias("failure_rate"),
        rate(F.col("label") == "hard_failure").alias("hard_failure_rate"),
    ]


def mcap_bucket(x: Column) -> Column:
    return F.when(x.isNull(), "unknown").when(x < 100000, "<100k").when(x < 1000000, "100k-1M").when(x < 5000000, "1M-5M").otherwise(">5M")


def liquidity_bucket(x: Column) -> Column:
    return F.when(x.isNull(), "unknown").when(x < 20000, "<20k").when(x < 100000, "20k-100k").otherwise(">100k")
