"""Benchmark decontamination: a positional inverted index of the training documents' telling terms.

Benchmark items are cut into windows of `window` consecutive words (a shorter item is one window). The documents' words
are counted for the items' vocabulary, so each window knows its rarest terms. The index stores postings (term, document,
position) for the terms that are among the rarest of some window, each with the words around the position as far as any
of the term's windows reaches. A window is looked up from its rarest term: its postings, adjusted by the term's offset,
are candidate places; the lists of its next rarest term, adjusted likewise, are intersected with them; and what is left
is compared word by word with the words kept in the posting, which gives exact phrase matches. Candidates whose two
rarest terms stand near their places, but not at them or without the whole phrase, are proximity matches.

DataFrame functions only. The windows are broadcast behind a check of their number; beyond it, the same joins shuffle.
Each row is a document: rows are told apart by doc_id and a hash of the text, so rows that share a doc_id or have none
have hits of their own, and equal rows have equal ones. Null and empty texts have no words and no hits; texts are read
whole; repeated items count once; an item with a null id counts for hits but can't be named; empty tables give no rows or
no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.llm.common import ascii_lower, checkpointed, small_or_shuffled

#: Words between a proximity match's terms beyond their distance in the window.
SLOP = 3
#: Windows up to which windows and terms are broadcast.
BROADCAST_WINDOWS = 200_000

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).cast("long")


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """item_id, terms (a window's words), for each distinct window of each item."""
    worded = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return worded.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("terms")).distinct()


def matches(docs: DataFrame, items: DataFrame, window: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, item_id, first, n): items' windows in documents; and (doc_id, row, item_id): proximity matches.

    row is a hash of the text.
    """
    owned = checkpointed(windows_of(items, window))
    ids = owned.select("terms").distinct().select(F.xxhash64("terms").alias("window"), "terms")
    vocabulary = small_or_shuffled(checkpointed(ids.select(F.explode("terms").alias("term")).distinct()), broadcast_windows)
    tokens = docs.select("doc_id", F.xxhash64("text").alias("row"), words(F.col("text")).alias("w"))

    counts = checkpointed(tokens.select(F.explode("w").alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("n")))
    # A window's terms from the rarest; a term that no document holds makes its window impossible.
    placed = ids.select("window", "terms", F.posexplode("terms").alias("offset", "term")).join(small_or_shuffled(counts, broadcast_windows), "term", "left")
    ranked = placed.groupBy("window", "terms").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))).alias("r"))
    ranked = checkpointed(ranked.where(F.col("r")[0]["n"] > 0).select("window", "terms", F.col("r")[0].alias("one"), F.coalesce(F.get("r", F.lit(1)), F.col("r")[0]).alias("two")))

    # How far each stored term's windows reach to either side of it.
    reach = ranked.select("terms", F.explode(F.array("one", "two")).alias("t")).groupBy("t.term").agg(F.max("t.offset").alias("left"), F.max(F.size("terms") - 1 - F.col("t.offset")).alias("right"))
    reach = checkpointed(reach)
    few = reach.limit(broadcast_windows + 1).count() <= broadcast_windows
    far = F.least(F.lit(window - 1), F.col("pos"))
    postings = tokens.select("doc_id", "row", "w", F.posexplode("w").alias("pos", "term"))
    if few:
        postings = postings.join(F.broadcast(reach), "term")
    # A posting takes along the words that a window can reach; where terms are shuffled, before that, and never the whole text.
    postings = postings.select("doc_id", "row", "pos", "term", far.alias("far"), F.slice("w", F.col("pos") + 1 - far, far + window).alias("near"), *(["left", "right"] if few else []))
    if not few:
        postings = postings.join(reach, "term")
    left = F.least("left", "far")
    around = F.slice("near", F.col("far") + 1 - left, left + 1 + F.col("right"))
    index = postings.select("term", "doc_id", "row", "pos", left.alias("at"), around.alias("around"))

    small = small_or_shuffled(ranked.select("window", "terms", F.col("one.term").alias("term"), F.col("one.offset").alias("offset"), F.col("two.term").alias("other"), (F.col("two.offset") - F.col("one.offset")).alias("apart")), broadcast_windows)
    entered = index.join(small, "term").where(F.col("pos") >= F.col("offset"))
    # The second list, adjusted: the other term at its distance from this place, within the words kept around it.
    other = F.transform(F.filter(F.transform("around", lambda w, i: F.when(w == F.col("other"), i - F.col("at") - F.col("apart"))), lambda d: d.isNotNull() & (F.abs(d) <= SLOP)), lambda d: F.abs(d))
    met = entered.withColumn("miss", F.array_min(other)).where("miss is not null")
    met = met.withColumn("exact", F.slice("around", F.greatest(F.col("at") - F.col("offset") + 1, F.lit(1)), F.size("terms")) == F.col("terms"))
    met = checkpointed(met.select("doc_id", "row", "window", (F.col("pos") - F.col("offset")).alias("first"), F.size("terms").alias("n"), "exact").distinct())
    of_items = small_or_shuffled(checkpointed(owned.select("item_id", F.xxhash64("terms").alias("window"))), broadcast_windows)
    exact = met.where("exact").join(of_items, "window").select("doc_id", "row", "item_id", "first", "n")
    near = met.where("not exact").join(of_items, "window").select("doc_id", "row", "item_id").distinct()
    return exact, near


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, row (a hash of the text), n_words, n_hit, n_items, items_sha256, contaminated, n_near, for each row of docs.

    docs has doc_id and text, items item_id and text; other columns are ignored.
    """
    exact, near = matches(docs, items, window, broadcast_windows)
    places = exact.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "n")).alias("p"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    covered = F.aggregate(
        F.array_sort("p"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda a, x: F.struct(F.greatest(a["end"], x["first"] + x["n"]).alias("end"), (a["hit"] + F.greatest(x["first"] + x["n"] - F.greatest(a["end"], x["first"]), F.lit(0))).alias("hit")),
    )["hit"]
    hits = places.select("doc_id", "row", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join(F.array_sort("items"), ",").alias("items"), F.lit(0).alias("n_near"))
    none = near.groupBy("doc_id", "row").agg(F.count("*").alias("n_near"))
    none = none.select("doc_id", "row", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items"), "n_near")
    hits = hits.unionByName(none).groupBy(F.col("doc_id").alias("hit_id"), F.col("row").alias("hit_row")).agg(F.max("n_hit").alias("n_hit"), F.max("n_items").alias("n_items"), F.max("items").alias("items"), F.max("n_near").alias("n_near"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), word_count(F.col("text")).alias("n_words"))
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row") == F.col("hit_row")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "row", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS t FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)),
m AS (SELECT doc_id, item_id, i, g.n FROM g JOIN win USING (n, t)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
