"""Filter interaction audit: what each order of filters removes at each step, from min-plus removal ranks.

A document is a mask: which filters it fails. Documents are counted by part, mask, quality and toxicity labels first, so
that all orders are evaluated on at most 2**filters masks a part. For them the removal step of mask m in order p is the
minimum over filters f of F[m, f] + P[p, f], where F is 0 where the mask fails f and infinite elsewhere, and P, the
inverse permutation, is the step at which order p applies f: a min-plus product of two matrices. Counts scattered by that
step are what a step removes; documents that fail a step's filter but left before are its redundancy.

Filters A to D read the text alone. E marks each copy of a text but those with its smallest doc_id: texts are told apart
by 96 bits of hashes and their length, copies of one part and label are added up before texts are shuffled, and no group
of copies is gathered. A null doc_id is neither smaller than another nor has a smaller one, so such rows never fail E;
rows that share the smallest doc_id pass all. A null text is an empty one; a null source is the part ''; a document is
good or toxic if any label row of its doc_id says so; an empty table gives no parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: whether a text fails filters A to D."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    size = F.char_length(text)
    upper = size - F.char_length(F.translate(text, _UPPER, ""))
    fails = (n < 50, distinct * 100 < n * 65, upper.cast("long") * 100 > size.cast("long") * 5, text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents by which filters they fail."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.xxhash64(text).alias("h"), F.hash(text).alias("g"), F.octet_length(text).alias("size"), text_mask(F.col("text")).alias("mask"))
    # Equal rows become one with a count, so that a group's least doc_id is one row.
    rows = rows.groupBy("doc_id", "part", "h", "g", "size", "mask").agg(F.count("*").alias("rows"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of_id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # Rows without a doc_id have no label; they don't meet in one task of the join.
    named = rows.where("doc_id is not null").join(told, F.col("doc_id") == F.col("of_id"), "left").drop("of_id")
    nameless = rows.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    rows = named.unionByName(nameless).na.fill(False, ["good", "toxic"])
    keys = ["h", "g", "size", "mask", "part", "good", "toxic"]
    texts = rows.groupBy(*keys).agg(F.sum("rows").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("rows"))), F.lit(0)).alias("nameless"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "rows"))).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("h", "g", "size"))
    passing = F.col("nameless") + F.when(F.col("first.doc_id") == least, F.col("first.rows")).otherwise(0)
    split = texts.select("part", "good", "toxic", "n", "mask", passing.alias("passing"))
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("passing")).alias("n"))))
    return split.select("part", "good", "toxic", both.alias("m")).groupBy("part", F.col("m.mask").alias("mask"), "good", "toxic").agg(F.sum("m.n").alias("n")).where("n > 0 or mask = 0")


def removal_steps(filters: int) -> tuple[np.ndarray, np.ndarray]:
    """(orders, steps): all orders as rows of filters, and the step at which an order removes a mask (filters: never)."""
    orders = np.array(list(permutations(range(filters))))
    position = np.argsort(orders, axis=1)
    fails = (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1
    never = np.where(fails == 1, 0, filters)
    return orders, (position[:, None, :] + never[None, :, :]).min(2).clip(max=filters)


def audited(parts: Iterator[pd.DataFrame], filters: str = FILTERS) -> Iterator[pd.DataFrame]:
    """Rows of a part's counts to its rows of all orders and steps."""
    k = len(filters)
    orders, steps = removal_steps(k)
    names = ["".join(filters[f] for f in o) for o in orders]
    masks = np.arange(1 << k)
    at = np.arange(len(orders))[:, None]
    for batch in parts:
        for part, cells in zip(batch["part"], batch["cells"], strict=True):
            counts = np.zeros((3, 1 << k), np.int64)
            for c in cells:
                counts[:, c["mask"]] += c["n"] * np.array([1, c["good"], c["toxic"]])
            scattered = np.zeros((3, len(orders), k + 1), np.int64)
            for row, weight in zip(scattered, counts, strict=True):
                np.add.at(row, (np.broadcast_to(at, steps.shape), steps), weight)
            removed, good, toxic = scattered[:, :, :k]
            failing = np.array([counts[0, masks >> f & 1 == 1].sum() for f in range(k)])[orders]
            shapley = np.zeros(k, np.int64)
            np.add.at(shapley, orders, removed)
            yield pd.DataFrame(
                {
                    "part": part,
                    "filter_order": np.repeat(names, k),
                    "step": np.tile(np.arange(1, k + 1), len(orders)).astype(np.int32),
                    "kept": (counts[0].sum() - removed.cumsum(1)).ravel(),
                    "removed": removed.ravel(),
                    "redundant": (failing - removed).ravel(),
                    "unique_fails": counts[0, 1 << orders].ravel(),
                    "good_lost": good.ravel(),
                    "toxic_lost": toxic.ravel(),
                    "shapley": shapley[orders].ravel(),
                }
            )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs has doc_id, text and source, labels doc_id, quality and toxic; other columns are ignored. redundant are the
    documents that fail the step's filter and went before.
    """
    cells = F.collect_list(F.struct("mask", "n", F.col("good").cast("int").alias("good"), F.col("toxic").cast("int").alias("toxic")))
    parts = mask_counts(docs, labels).groupBy("part").agg(cells.alias("cells"))  # at most 128 cells a part
    return parts.mapInPandas(audited, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 5 * length(x),
         regexp_matches(x, '[#$%&*|]'), coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY x), false)] AS fails
      FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM d GROUP BY part, fails),
f AS (SELECT unnest(range(1, 6)) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e
      WHERE a.f <> b.f AND a.f <> c.f AND a.f <> d.f AND a.f <> e.f AND b.f <> c.f AND b.f <> d.f AND b.f <> e.f AND c.f <> d.f AND c.f <> e.f AND d.f <> e.f),
s AS (SELECT part, o, s, o[s] AS f, list_bool_or(list_transform(range(1, s), lambda i: fails[o[i]])) AS gone, fails[o[s]] AS fail, len(list_filter(fails, lambda z: z)) AS n_fails, n, g, x
      FROM m, o, (SELECT unnest(range(1, 6)) AS s)),
r AS (SELECT part, o, s, f, sum(n) FILTER (NOT coalesce(gone, false) AND NOT fail) AS kept, sum(n) FILTER (NOT coalesce(gone, false) AND fail) AS removed, sum(n) FILTER (coalesce(gone, false) AND fail) AS redundant,
        sum(n) FILTER (fail AND n_fails = 1) AS unique_fails, sum(g) FILTER (NOT coalesce(gone, false) AND fail) AS good_lost, sum(x) FILTER (NOT coalesce(gone, false) AND fail) AS toxic_lost
      FROM s GROUP BY part, o, s, f)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, CAST(s AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM r
"""
