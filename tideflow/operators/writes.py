"""Write semantics as joins: each takes a table and incoming rows, and gives the table as it is afterwards.

Keys are compared null-safe where said. Incoming rows must be unique by key unless said otherwise; `once` makes them so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(keys: list[str], safe: bool) -> Column:
    pairs = [(F.col(f"old.{k}"), F.col(f"new.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) if safe else x == y for x, y in pairs])


def once(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key: a later one is already there."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is new are added; nothing is overwritten."""
    fresh = rows.alias("new").join(table.alias("old"), _same(keys, False), "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], update: list[str], safe: bool = False) -> DataFrame:
    """New keys are added; of rows that are there, the columns in update are replaced and the others stay. One join."""
    both = table.withColumn("_o", F.lit(1)).alias("old").join(rows.withColumn("_w", F.lit(1)).alias("new"), _same(keys, safe), "full")
    came = F.col("new._w").isNotNull()
    was = F.col("old._o").isNotNull()

    def value(c: str) -> Column:
        fresh = F.col(f"new.{c}") if c in rows.columns else F.lit(None)
        if c in keys:
            return F.when(was, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
        if c in update:
            return F.when(came, fresh).otherwise(F.col(f"old.{c}"))
        return F.when(was, F.col(f"old.{c}")).otherwise(fresh)

    return both.select(*[value(c).alias(c) for c in table.columns])


def replace_scope(table: DataFrame, rows: DataFrame, scope: str) -> DataFrame:
    """All rows of the scopes that come are replaced by what comes."""
    return table.join(rows.select(scope).distinct(), scope, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def latest_patched(table: DataFrame, patch: DataFrame, key: str, order: list[Column | str], column: str) -> DataFrame:
    """column of each key's newest row is replaced by patch's (key, value)."""
    ranked = table.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    joined = ranked.join(patch.select(key, F.col("value").alias("_v")), key, "left")
    return joined.withColumn(column, F.when((F.col("_n") == 1) & F.col("_v").isNotNull(), F.col("_v")).otherwise(F.col(column))).select(*table.columns)


def counters(runs: DataFrame, key: str) -> DataFrame:
    """key, runs, fails in a row since the last success, scanned: counters as sums over a run log (key, at, ok, scanned)."""
    good = runs.groupBy(key).agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("_last"))
    late = runs.join(good, key)
    return late.groupBy(key).agg(F.count("*").alias("runs"), F.count_if(~F.col("ok") & (F.col("_last").isNull() | (F.col("at") > F.col("_last")))).alias("fails"), F.sum("scanned").alias("scanned"))
