"""CSV and JSON in and out: quoting, typed rows with the first error of each, rows dropped by reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideflow.functions import scalar as sc

#: Columns of a wallet list.
WALLET_COLUMNS = ("wallet_address", "chain", "pnl_30d", "realized_pnl_30d", "unrealized_pnl_30d", "win_rate", "trade_count_30d", "avg_trade_size_usd", "tags", "source")


def write_csv(df: DataFrame, path: str) -> None:
    """Cells with commas, quotes or line ends are quoted, quotes doubled, rows end in CR LF."""
    df.write.csv(path, header=True, quote='"', escape='"', lineSep="\r\n", emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Cells as strings, quoted line ends kept, blank rows dropped; a file whose header isn't `columns` is an error."""
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _number(c: str) -> Column:
    x = F.trim(c)
    return F.when((x != "") & ~x.rlike("(?i)nan|inf|[df]$"), x.try_cast("double"))


def validated_wallets(rows: DataFrame) -> DataFrame:
    """rows with typed columns (address, of_chain, pnl, realized, unrealized, rate, count, size, tag_list, note) and error.

    error is the first fault of a row, null for a good one.
    """
    address, chain = F.trim(F.coalesce("wallet_address", F.lit(""))), F.upper(F.trim(F.coalesce("chain", F.lit(""))))
    out = rows.withColumns(
        {"address": address, "of_chain": chain, "pnl": _number("pnl_30d"), "realized": _number("realized_pnl_30d"), "unrealized": _number("unrealized_pnl_30d"), "rate": _number("win_rate"), "count": _number("trade_count_30d"), "size": _number("avg_trade_size_usd")}
    )
    bad = lambda name: F.concat(F.lit(f"invalid {name}: "), F.coalesce(name, F.lit("")))
    tests = [
        (F.col("address") == "", F.lit("missing wallet_address")),
        (~F.col("of_chain").isin("SOLANA", "BSC"), bad("chain")),
        (~sc.address_valid(F.col("address"), F.col("of_chain")), F.concat(F.lit("malformed address: "), F.col("address"))),
        (F.col("pnl").isNull(), bad("pnl_30d")),
        (F.col("realized").isNull(), bad("realized_pnl_30d")),
        (F.col("unrealized").isNull(), bad("unrealized_pnl_30d")),
        (~F.coalesce(F.col("rate").between(0, 1), F.lit(False)), bad("win_rate")),
        (~F.coalesce((F.col("count") >= 0) & (F.col("count") == F.floor("count")), F.lit(False)), bad("trade_count_30d")),
        (~F.coalesce(F.col("size") >= 0, F.lit(False)), bad("avg_trade_size_usd")),
    ]
    error = reduce(lambda acc, t: F.when(t[0], t[1]).otherwise(acc), reversed(tests), F.lit(None).cast("string"))
    source = F.trim(F.coalesce("source", F.lit("")))
    note = F.when((source != "") & (F.lower(source) != "csv"), F.concat(F.lit("source: "), source))
    return out.withColumns({"tag_list": sc.split_tags(F.col("tags")), "note": note, "error": error})


def json_rows(rows: DataFrame, column: str, schema: StructType | str, required: tuple[str, ...]) -> DataFrame:
    """rows with the parsed struct j and reason: not json, no <field>, or null for a good row."""
    j = F.from_json(column, schema if isinstance(schema, str) else schema.json())
    fine = F.try_parse_json(column).isNotNull()
    reason = reduce(lambda acc, f: F.when(F.col(f"j.{f}").isNull(), f"no {f}").otherwise(acc), reversed(required), F.lit(None).cast("string"))
    return rows.withColumn("j", F.when(fine, j)).withColumn("reason", F.when(~fine, "not json").otherwise(reason))
