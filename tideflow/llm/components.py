"""Connected components of a table of links by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.llm.common import checkpointed

#: Links for which a round uses one more task. Few links take few tasks, so rounds over them cost no shuffle.
LINKS_A_TASK = 100_000


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """doc_id, component (the smallest doc_id of its component), for each end of links (a, b).

    Alternating large-star and small-star rounds: each round replaces links by links to smaller neighbours, and ends
    when nothing changes; a chain of n links takes about log2(n) rounds. Each round is checkpointed. links should be
    cheap to count: checkpointed.
    """
    tasks = 1 + links.count() // LINKS_A_TASK
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").coalesce(tasks).distinct()
    edges = checkpointed(edges.coalesce(tasks))
    before = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")).coalesce(tasks)
        # Large star: larger neighbours of u go to u's smallest neighbour (or u).
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(edges.join(least, "u").select("u", F.col("m").alias("v"))).where("u != v").coalesce(tasks).distinct().coalesce(tasks)
        # Small star: smaller neighbours of u, and u, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = checkpointed(small.select("e.u", "e.v").where("u != v").coalesce(tasks).distinct().coalesce(tasks))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not now[0]:
            break
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {most} rounds")
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component")).distinct())
