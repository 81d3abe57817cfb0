"""Mixing sources to target weights: how often each document goes into the mix.

Words are totalled by source. The mix holds `share` times all words; sources get shares by weight, none more than `most`
times its own words, and what a capped source can't take goes to the others by weight. A source's rate is its target by
its words; each document is taken floor(rate) times, plus once more by a hash-seeded draw with the rate's fraction as its
probability. The draw's threshold is the fraction as it falls on this corpus: draws are cut into BUCKETS equal ranges whose
words are totalled by source, and the threshold is the range edge up to which the words come nearest to what is missing
(for large sources that edge is the fraction to within a range; for small ones it keeps a long document's luck from
moving the source away from its target).

Sources are taken in code point order, null last; a null text has size 0; equal rows are taken alike; sources without
words have target 0. Tables of one row a source are broadcast behind a check of their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideflow.llm.common import checkpointed, small_or_shuffled

WEIGHTS = (3, 1, 2)
BUCKETS_BITS = 12
DRAW_BITS = 52


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number below 2**DRAW_BITS from the seed, doc_id and text, so that rows without an id, or with one id, differ."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))), 1, DRAW_BITS // 4), 16, 10).cast("long")


def source_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """source, source_size, target, whole (copies for all), cut (buckets below it get one more): one row a source."""
    sized = docs.select("source", word_count(F.col("text")).alias("size"), F.shiftright(draw(F.col("doc_id"), F.col("text"), seed), DRAW_BITS - BUCKETS_BITS).alias("bucket"))
    buckets = checkpointed(sized.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    sources = buckets.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source from here on: the windows over all of them are over that small table.
    ranked = sources.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("limit", F.lit(most) * F.col("source_size"))
    # In order of limit by weight, the capped sources come first; level is what a unit of weight gets if all before are capped.
    by = Window.orderBy(F.col("limit") / F.col("weight"), "i")
    total = F.lit(share) * F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    leveled = ranked.withColumn("level", (total - before) / left)
    common = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct((F.col("limit") / F.col("weight")).alias("r"), "i", "level"))).over(Window.partitionBy())["level"]
    target = F.when(F.col("level") * F.col("weight") > F.col("limit"), F.col("limit")).otherwise(F.least("limit", F.coalesce(common, F.lit(0.0)) * F.col("weight")))
    rated = leveled.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rated = rated.select("source", "source_size", "target", F.floor("rate").cast("long").alias("whole"), (F.col("target") - F.floor("rate") * F.col("source_size")).alias("missing"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = buckets.withColumn("before", F.coalesce(F.sum("size").over(along), F.lit(0))).withColumnRenamed("source", "of")
    rated = checkpointed(rated)
    cut = filled.join(small_or_shuffled(rated), F.col("of").eqNullSafe(F.col("source"))).where((F.col("missing") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("missing")))
    cut = cut.groupBy("of").agg((F.max("bucket") + 1).alias("cut"))
    return checkpointed(rated.join(cut, F.col("of").eqNullSafe(F.col("source")), "left").select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut")))


def with_copies(docs: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """docs with size, source_size, target and copies."""
    plan = small_or_shuffled(plan).withColumnRenamed("source", "plan_source")
    bucket = F.shiftright(draw(F.col("doc_id"), F.col("text"), seed), DRAW_BITS - BUCKETS_BITS)
    joined = docs.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "left")
    return joined.withColumn("size", word_count(F.col("text"))).withColumn("copies", F.col("whole") + F.when(bucket < F.col("cut"), 1).otherwise(0)).drop("plan_source", "whole", "cut")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """The columns doc_id, text, lang, source, n_chars of docs, each row as often as the mix takes it, and copy (from 1)."""
    keep = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]
    taken = with_copies(docs.select(*keep), source_plan(docs, weights, share, most, seed), seed)
    return taken.where("copies > 0").select(*keep, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


def mix_report(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, for each row of docs."""
    taken = with_copies(docs.select("doc_id", "source", "text"), source_plan(docs, weights, share, most, seed), seed)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) >> 40 AS bucket
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
c AS (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, i LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN level * weight > cap THEN cap ELSE least(cap, coalesce((SELECT level FROM c), 0) * weight) END AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
b AS (SELECT source, bucket, sum(size) AS size FROM d GROUP BY source, bucket),
f AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
k AS (SELECT f.source, max(bucket) + 1 AS cut FROM f JOIN q ON f.source IS NOT DISTINCT FROM q.source
      WHERE q.target > q.whole * q.source_size AND f.before + f.size / 2.0 <= q.target - q.whole * q.source_size GROUP BY f.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, q.source_size, q.target,
       CAST(d.size * (q.whole + CASE WHEN d.bucket < coalesce(k.cut, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(q.whole + CASE WHEN d.bucket < coalesce(k.cut, 0) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
