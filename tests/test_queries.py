"""Every query with an oracle against DuckDB on the smallest tables; and the entry module without the llm subpackage."""

from __future__ import annotations

import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

from tideflow import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x: object) -> str:
    return f"{float(x):.6g}" if isinstance(x, float | Decimal) else str(x)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_its_oracle(spark: SparkSession, duck: duckdb.DuckDBPyConnection, name: str) -> None:
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name not in plans.ORACLE_SQL:
        assert df.schema.fields
        return
    cursor = duck.execute(plans.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted([plain(r[i]) for i in at] for r in cursor.fetchall())


def test_budgeted_frontier_against_a_walk(spark: SparkSession, duck: duckdb.DuckDBPyConnection) -> None:
    """The query that SQL can't express: nodes level by level, the largest inflows first, as long as the budget lasts."""
    views = plans.ORACLE_SQL["agg_edges"].split("ae AS (")[0].rstrip().rstrip(",")
    single = duck.execute(f"{views} SELECT src, dst, CAST(sum(usd) AS DOUBLE) FROM edges WHERE usd >= 100 GROUP BY ALL").fetchall()
    stops = {r[0] for r in duck.execute(f"{views} SELECT address FROM registry").fetchall()}
    depth, front, left = {3: 0}, {3}, 39
    for level in range(1, 4):
        inflow: dict[int, float] = {}
        for s, t, usd in single:
            if s in front and s not in stops and t not in depth:
                inflow[t] = inflow.get(t, 0) + usd
        new = sorted(inflow, key=lambda t: (-inflow[t], t))[:left]
        left -= len(new)
        depth |= dict.fromkeys(new, level)
        front = set(new)
    got = {r["node"]: r["depth"] for r in plans.QUERIES["graph_bfs_budget"](spark, DATA).collect()}
    assert got == depth


def test_entry_without_the_training_data_operators() -> None:
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("tideflow.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 100 and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
assert e.oracle_sql().keys() <= e.queries().keys()
"""
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
