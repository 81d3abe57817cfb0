"""Ranked lexical search with bit-sliced Bloom signatures.

The index holds the documents in blocks of like size. A document's signature is a Bloom filter of its (term, level) pairs,
one for each level that the term's count reaches; a block stores the filters bit by bit: slice b is the bitmap of the
block's documents that have bit b set. For a query term and level, the AND of its slices is a bitmap of documents that
holds all that reach the level, and perhaps others, so the slices' sums, weighted by what each level adds to a score, are
upper bounds of the scores. Beside the blocks, the index keeps each task's terms with their document counts.

A search reads the index twice. First each query's documents with the highest bounds are scored exactly from their texts;
the tenth such score is one that ten documents reach. Then every document whose bound doesn't prove that it lies behind
those ten (by its score or, at an equal score, by its doc_id) is scored exactly, and the best are ranked. No document is
left out for any other reason. Queries are taken in blocks of bounded size; what is sent to tasks is one block's terms.

Texts are read whole and only as their terms: runs of digits, ASCII letters and characters beyond ASCII, A-Z lowered.
Each row is a document, rows that share a doc_id too; equal scores rank by doc_id, null last; a null text has no terms;
documents without terms count for nothing; an item without terms, or whose terms no document has, returns no rows; each
item row is a query, also where item_ids repeat; empty tables give no rows. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideflow.llm.common import checkpointed, shared_folder, small_or_shuffled
from tideflow.llm.textarrays import ALNUM, Chunk, U, chunks, mix

#: Counts at which a term reaches the next level: each up to 8, then four an octave. A bound takes the largest count of its level.
LEVELS = np.array([*range(1, 9), *[(4 + q) << k for k in range(1, 20) for q in range(1, 5)]], np.int64)
#: Bits a (term, level) pair of a signature, and slices that a pair sets.
BITS_A_PAIR, SLICES = 16, 4
#: Bits of a block, and documents in it at most.
BLOCK_BITS, BLOCK_DOCS = 1 << 23, 8192
#: Distinct terms after which a task writes what it has counted.
TERMS_A_ROW = 1 << 19
#: Queries, and terms of queries, that are searched at once.
ITEMS, ITEM_TERMS = 512, 1 << 16

_INDEX = "doc_ids array<long>, rows array<long>, n array<long>, bits int, slices binary, terms binary, dfs binary"
_FIELDS = pa.schema([("doc_ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("bits", pa.int32()), ("slices", pa.binary()), ("terms", pa.binary()), ("dfs", pa.binary())])


def _places(terms: np.ndarray, level: np.ndarray | int, bits: int) -> list[np.ndarray]:
    """The slices of (term, level) pairs in signatures of so many bits, a power of two."""
    h = mix(terms + np.asarray(level).astype(U) * U(0x9E3779B97F4A7C15))
    return [(mix(h + U(k)) & U(bits - 1)).astype(np.int64) for k in range(SLICES)]


def _counted(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of a chunk's distinct terms by document."""
    h, doc = chunk.hashes, chunk.doc
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.r_[at, len(h)])


class _Blocks:
    """Documents of one size class, until they fill a block."""

    def __init__(self, size: int) -> None:
        self.bits = BITS_A_PAIR << size
        self.most = min(BLOCK_DOCS, max(8, BLOCK_BITS // self.bits))
        self.docs: list[tuple] = []
        self.terms: list[np.ndarray] = []
        self.levels: list[np.ndarray] = []

    def add(self, doc: tuple, terms: np.ndarray, levels: np.ndarray) -> pa.RecordBatch | None:
        self.docs.append(doc)
        self.terms.append(terms)
        self.levels.append(levels)
        return self.flush() if len(self.docs) == self.most else None

    def flush(self) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(self.docs)), [len(t) for t in self.terms])
        bitmap = np.zeros((self.bits, -(-len(self.docs) // 8) * 8), bool)
        for at in _places(np.concatenate(self.terms), np.concatenate(self.levels), self.bits):
            bitmap[at, owner] = True
        ids, rows, n = zip(*self.docs, strict=True)
        row = {"doc_ids": [list(ids)], "rows": [list(rows)], "n": [list(n)], "bits": [self.bits], "slices": [np.packbits(bitmap, axis=1).tobytes()], "terms": [None], "dfs": [None]}
        self.docs, self.terms, self.levels = [], [], []
        return pa.RecordBatch.from_pydict(row, _FIELDS)


def _term_row(found: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    terms, at = np.unique(np.concatenate(found), return_inverse=True)
    return terms, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def _indexing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks (doc_ids, hashes and lengths of texts, slices), and rows of terms with their document counts."""
    blocks: dict[int, _Blocks] = {}
    found, counts, kept = [], [], 0

    def terms_row() -> pa.RecordBatch:
        terms, dfs = _term_row(found, counts)
        return pa.RecordBatch.from_pydict({"doc_ids": [[]], "rows": [[]], "n": [[]], "bits": [0], "slices": [None], "terms": [terms.tobytes()], "dfs": [dfs.tobytes()]}, _FIELDS)

    for batch in batches:
        ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
        for chunk in chunks(batch.column("text"), ALNUM, True):
            doc, term, tf = _counted(chunk)
            some, df = np.unique(term, return_counts=True)
            found.append(some)
            counts.append(df)
            kept += len(some)
            if kept > TERMS_A_ROW:
                found, counts = map(lambda x: [x], _term_row(found, counts))
                kept = len(found[0])
                if kept > TERMS_A_ROW // 2:
                    yield terms_row()
                    found, counts, kept = [], [], 0
            reached = np.searchsorted(LEVELS, tf, "right")
            ends = np.cumsum(reached)
            level = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - reached, reached)
            pair = np.repeat(term, reached)
            bounds = np.r_[0, ends][np.searchsorted(doc, np.arange(chunk.n + 1))]
            for i, n in enumerate(chunk.counts):
                if n:
                    own = slice(bounds[i], bounds[i + 1])
                    size = int(bounds[i + 1] - bounds[i] - 1).bit_length()
                    block = blocks.setdefault(size, _Blocks(size))
                    full = block.add((ids[chunk.lo + i], rows[chunk.lo + i], int(n)), pair[own], level[own])
                    if full:
                        yield full
    for block in blocks.values():
        if block.docs:
            yield block.flush()
    if found:
        yield terms_row()


def build_index(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text), written to the shared folder."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/signatures-{uuid.uuid4().hex}"
    docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(_indexing, _INDEX).write.parquet(path)
    return spark.read.parquet(path)


@dataclass
class Query:
    """A block of queries: terms in order of hash with their weights, and for each item its terms and how often each stands there."""

    terms: np.ndarray
    weights: np.ndarray
    items: list[tuple[np.ndarray, np.ndarray]]
    docs: int
    words: int

    def m(self, n: np.ndarray) -> np.ndarray:
        return 25 + (75 * n * self.docs) // max(self.words, 1)


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text"), ALNUM, True):
            doc, term, tf = _counted(chunk)
            at = np.searchsorted(doc, np.arange(chunk.n + 1))
            ids = batch.column("item_id").slice(chunk.lo, chunk.n)
            lists = [[x[a:b] for a, b in zip(at, at[1:], strict=False)] for x in (term.view(np.int64), tf)]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.list_(pa.int64())) for x in lists]], names=["item_id", "terms", "tf"])


def _blocks_of_items(items: DataFrame) -> Iterator[list[tuple]]:
    """Items with their terms, a block at a time; one item with more terms than a block may hold is a block."""
    kind = items.schema["item_id"].dataType.simpleString()
    terms = items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, terms array<long>, tf array<long>")
    block, size = [], 0
    for r in terms.toLocalIterator():
        if block and (len(block) == ITEMS or size + len(r["terms"]) > ITEM_TERMS):
            yield block
            block, size = [], 0
        block.append((r["item_id"], np.array(r["terms"], np.int64).view(U), np.array(r["tf"], np.int64)))
        size += len(r["terms"])
    if block:
        yield block


def _sum_dfs(wanted: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(wanted), np.int64)
    for batch in batches:
        for terms, dfs in zip(batch.column("terms"), batch.column("dfs"), strict=True):
            here = np.frombuffer(terms.as_py(), U)
            at = np.minimum(np.searchsorted(here, wanted), max(len(here) - 1, 0))
            if len(here):
                total += np.where(here[at] == wanted, np.frombuffer(dfs.as_py(), np.int64)[at], 0)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])


def _query(index: DataFrame, block: list[tuple]) -> Query:
    """A block of queries with the corpus's weights of their terms."""
    wanted = np.unique(np.concatenate([t for _, t, _ in block]))
    size = index.agg(F.sum(F.size("n")).alias("docs"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words")).first()
    docs, words = size["docs"] or 0, size["words"] or 0
    dfs = np.zeros(len(wanted), np.int64)
    found = index.where("terms is not null").select("terms", "dfs").mapInArrow(partial(_sum_dfs, wanted), "term long, df long")
    for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of this block of queries
        dfs[r["term"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(df) + 1))) if df else 0 for df in dfs], np.int64)
    used = weights > 0
    kept = np.cumsum(used) - 1
    items = []
    for _, terms, tf in block:
        at = np.searchsorted(wanted, terms)
        some = used[at]
        items.append((kept[at[some]], tf[some]))
    return Query(wanted[used], weights[used], items, docs, words)


def _bounds(query: Query, n: np.ndarray, bits: int, slices: bytes) -> np.ndarray:
    """Upper bounds of the scores, items by documents of a block."""
    docs = len(n)
    bitmap = np.frombuffer(slices, np.uint8).reshape(bits, -1)
    m = query.m(n)
    most = np.r_[LEVELS[1:] - 1, np.iinfo(np.int32).max]
    gains = np.stack([gain(np.minimum(x, n), m) for x in most])
    adds = np.diff(gains, axis=0, prepend=0)
    out = np.zeros((len(query.items), docs), np.int64)
    step = max(1, (1 << 21) // docs)
    for lo in range(0, len(query.terms), step):
        terms = query.terms[lo : lo + step]
        got = np.zeros((len(terms), docs), np.int64)
        rows, reach = np.arange(len(terms)), np.full((len(terms), bitmap.shape[1]), 255, np.uint8)
        for level in range(len(LEVELS)):
            for at in _places(terms[rows], level, bits):
                reach = reach & bitmap[at]
            some = reach.any(1)
            rows, reach = rows[some], reach[some]
            if not len(rows):
                break
            got[rows] += np.unpackbits(reach, axis=1, count=docs) * adds[level]
        got *= query.weights[lo : lo + step, None]
        for i, (at, tf) in enumerate(query.items):
            own = (at >= lo) & (at < lo + step)
            if own.any():
                out[i] += tf[own] @ got[at[own] - lo]
    return out


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, bytes]]:
    """doc_ids (null: the largest number), hashes, lengths, bits and slices of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, rows, n = (batch.column(c)[i].values for c in ("doc_ids", "rows", "n"))
            yield ids.fill_null(np.iinfo(np.int64).max).to_numpy(), rows.to_numpy(), n.to_numpy(), batch.column("bits")[i].as_py(), batch.column("slices")[i].as_py()


def _candidates(items: np.ndarray, ids: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    null = ids == np.iinfo(np.int64).max
    return pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(ids, pa.int64(), mask=null), pa.array(rows, pa.int64()), pa.array(bounds, pa.int64())], names=["item", "doc_id", "row", "bound"])


_CANDIDATE = "item int, doc_id long, row long, bound long"


def _highest(query: Query, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's k documents with the highest bounds for each item."""
    best: dict[int, list[np.ndarray]] = {}
    for ids, rows, n, bits, slices in _block_rows(batches):
        for i, bound in enumerate(_bounds(query, n, bits, slices)):
            some = np.flatnonzero(bound)
            if len(some) > k:
                some = some[bound[some] >= np.partition(bound[some], -k)[-k]]
            new = [ids[some], rows[some], bound[some]]
            both = [np.concatenate(x) for x in zip(best[i], new, strict=True)] if i in best else new
            top = np.lexsort((both[0], -both[2]))[:k]
            best[i] = [x[top] for x in both]
    for i, (ids, rows, bound) in best.items():
        yield _candidates(np.full(len(ids), i), ids, rows, bound)


def _not_excluded(query: Query, least: list[tuple[int, int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All documents that could be among an item's best: their bound and doc_id don't put them behind `least`."""
    for ids, rows, n, bits, slices in _block_rows(batches):
        for i, (bound, (score, doc_id)) in enumerate(zip(_bounds(query, n, bits, slices), least, strict=True)):
            some = np.flatnonzero((bound > score) | ((bound == score) & (bound > 0) & (ids <= doc_id)))
            if len(some):
                yield _candidates(np.full(len(some), i), ids[some], rows[some], bound[some])


def _scoring(query: Query, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact scores of the (document, item) pairs, from whole texts."""
    for batch in batches:
        wanted = batch.column("items")
        for chunk in chunks(batch.column("text"), ALNUM, True):
            at = np.minimum(np.searchsorted(query.terms, chunk.hashes), max(len(query.terms) - 1, 0))
            hit = query.terms[at] == chunk.hashes if len(query.terms) else np.zeros(len(at), bool)
            pair, tf = np.unique(chunk.doc[hit] * len(query.terms) + at[hit], return_counts=True)
            own = np.searchsorted(pair, np.arange(chunk.n + 1) * len(query.terms))
            m = query.m(chunk.counts)
            items, docs, scores = [], [], []
            counts = np.zeros(len(query.terms), np.int64)
            for d in range(chunk.n):
                here = slice(own[d], own[d + 1])
                terms = pair[here] - d * len(query.terms)
                counts[terms] = tf[here]
                for i in wanted[chunk.lo + d].as_py():
                    of, often = query.items[i]
                    items.append(i)
                    docs.append(chunk.lo + d)
                    scores.append(int((often * query.weights[of] * gain(counts[of], m[d])).sum()))
                counts[terms] = 0
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])


def _scored(docs: DataFrame, query: Query, candidates: DataFrame) -> DataFrame:
    """item, doc_id, score of candidates, from the texts they stand for; each row of docs with a candidate's text counts."""
    of = candidates.groupBy(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row")).agg(F.collect_set("item").alias("items"))
    of = small_or_shuffled(checkpointed(of), 50_000)
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row"))
    found = docs.select("doc_id", F.xxhash64("text").alias("row"), "text").join(of, same).select("doc_id", "text", "items")
    return found.mapInArrow(partial(_scoring, query), "item int, doc_id long, score long").where("score > 0")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, index: DataFrame | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item. index: of docs, where it has been built before.

    docs has doc_id and text, items item_id and text; other columns are ignored.
    """
    spark = docs.sparkSession
    index = index if index is not None else build_index(docs)
    blocks = index.where("bits > 0").select("doc_ids", "rows", "n", "bits", "slices")
    kind = items.schema["item_id"].dataType.simpleString()
    parts = [spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")]
    for block in _blocks_of_items(items):
        query = _query(index, block)
        if not len(query.terms):
            continue
        high = blocks.mapInArrow(partial(_highest, query, k), _CANDIDATE)
        high = high.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id")))).where(F.col("r") <= k)
        known = defaultdict(list)
        for r in _best(_scored(docs, query, high.drop("r")), k).collect():  # k rows an item of this block
            known[r["item"]].append((r["score"], np.iinfo(np.int64).max if r["doc_id"] is None else r["doc_id"]))
        last = lambda x: max(x, key=lambda y: (-y[0], y[1])) if len(x) >= k else (0, np.iinfo(np.int64).max)
        open_ = blocks.mapInArrow(partial(_not_excluded, query, [last(known[i]) for i in range(len(block))]), _CANDIDATE)
        best = _best(_scored(docs, query, open_), k)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _, _) in enumerate(block)], f"item int, item_id {kind}")
        parts.append(checkpointed(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
v AS (SELECT DISTINCT term FROM q),
k AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
o AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d WHERE len(w) > 0),
c AS (SELECT r, doc_id, n, term, count(*) AS tf FROM o JOIN v USING (term) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT n FROM k) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c GROUP BY term),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(f.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * c.n * (SELECT n FROM k)) // (SELECT l FROM k))))) AS BIGINT) AS score
      FROM q JOIN c USING (term) JOIN f USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""
