"""Substring dedup: remove every word that lies in a passage of enough words that also stands elsewhere.

Seed: each window of `window` words holds `window - SEED + 1` seeds of SEED words, and its anchor is the seed with the
least hash (winnowing). Equal windows have equal anchors, so only windows whose anchor stands in at least two places can
repeat. Extend: around such anchors, all windows to both sides that hold the anchor are hashed (95 bits), and windows
with equal hashes meet by a shuffle; the union of a document's repeated windows is its set of maximal repeats.

Copies within one batch are settled there, and one of them stands for all in the shuffle, so that a passage found in a
third of all documents sends one row per batch. Shared anchors are joined to documents, never collected.

Each row is a document: rows are told apart by doc_id and a hash of the text, so rows that share a doc_id or have none are
searched by their own texts, and equal rows are copies of each other with equal results. Null and empty texts have no
words. Texts of any length are read whole; a longer repeat is the union of its windows; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.llm import textarrays as ta
from tideflow.llm.common import BROADCAST_ROWS, checkpointed

#: Words of a seed. Longer seeds are rarer by chance; shorter ones give fewer anchors.
SEED = 11


def _slide(a: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over each n consecutive values, by doubling."""
    width = 1
    while 2 * width <= n:
        a = f(a[:-width], a[width:])
        width *= 2
    return f(a[: len(a) - (n - width)], a[n - width :]) if n > width else a


def _anchors(chunk: ta.Chunk, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each long enough document: its index, its seeds' hashes, each window's anchor hash."""
    at, grams = chunk.grams(SEED)
    ends = ta.per_doc(at, chunk)
    for i in np.flatnonzero(chunk.counts >= window):
        seeds = grams[ends[i] : ends[i + 1]]
        yield i, seeds, _slide(seeds, window - SEED + 1, np.minimum)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text, of 32 bits where there is a doc_id), text."""
    whole = F.xxhash64("text")
    return docs.select("doc_id", F.when(F.col("doc_id").isNull(), whole).otherwise(whole.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("row"), "text")


def _of(docs: DataFrame, table: DataFrame) -> DataFrame:
    """docs with a table's columns, inner, on doc_id = of_id (or both null) and row = of_row. table is checkpointed.

    Where few documents are in the table, only those are shuffled.
    """
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row"))
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(table.select("of_id", "of_row")), same, "left_semi")
    return docs.join(table, same)


def _selected(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, doc_id, row, n): documents' anchors with the number of places in the document's batch, 2 for any more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = window - SEED + 1
        for b in batches:
            for c in ta.chunks(b.column(2), ta.PLAIN, lower=False):
                found, doc, n = [], [], []
                for i, seeds, least in _anchors(c, window):
                    # A seed is an anchor if some window over it has no lesser one.
                    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
                    values, places = np.unique(seeds[_slide(padded, span, np.maximum) == seeds], return_counts=True)
                    found.append(values)
                    n.append(places)
                    doc.append(np.full(len(values), i))
                if found:
                    anchor, doc = np.concatenate(found), np.concatenate(doc)
                    _, back = np.unique(anchor, return_inverse=True)
                    places = np.minimum(np.bincount(back, np.concatenate(n))[back], 2)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), b.column(0)[c.lo : c.hi].take(pa.array(doc)), b.column(1)[c.lo : c.hi].take(pa.array(doc)), pa.array(places.astype(np.int32))], ["anchor", "doc_id", "row", "n"])

    return _keyed(docs).mapInArrow(run, "anchor long, doc_id long, row long, n int")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(k1, k2, doc_id, row, first, n): windows that may repeat, n 0; runs of n windows that are known to repeat.

    docs has doc_id, row, text and anchors, the array of a document's shared anchors.
    """

    def isin(values: np.ndarray, among: np.ndarray) -> np.ndarray:
        return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in ta.chunks(b.column(2), ta.PLAIN, lower=False):
                at, doc = [], []
                for i, _, least in _anchors(c, window):
                    among = np.sort(np.asarray(b.column(3)[c.lo + i].values, np.int64).view(np.uint64))
                    values, back = np.unique(least, return_inverse=True)
                    hits = np.flatnonzero(isin(values, among)[back])
                    at.append(hits + c.word_at[i])
                    doc.append(np.full(len(hits), i))
                if not at or not sum(map(len, at)):
                    continue
                at, doc = np.concatenate(at), np.concatenate(doc)
                k1, k2 = ta.gram_hash(c.hashes, at, window), ta.gram_hash(c.hashes, at, window, second=True)
                order = np.lexsort((k2, k1))
                same = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])
                head = np.concatenate([[True], ~same])
                many = np.zeros(len(at), bool)
                many[order[1:][same]] = many[order[:-1][same]] = True
                first = at - c.word_at[doc]
                sure = np.flatnonzero(many)
                starts = sure[np.concatenate([[True], (np.diff(at[sure]) != 1) | (np.diff(doc[sure]) != 0)])] if len(sure) else sure
                lengths = np.diff(np.append(np.searchsorted(sure, starts), len(sure)))
                one = order[head]
                rows = np.concatenate([one, starts])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([k1[one], ta.mix(k1[starts])]).view(np.int64)),
                        pa.array((np.concatenate([k2[one], k2[starts]]) >> np.uint64(33)).astype(np.int32)),
                        b.column(0)[c.lo : c.hi].take(pa.array(doc[rows])),
                        b.column(1)[c.lo : c.hi].take(pa.array(doc[rows])),
                        pa.array(first[rows].astype(np.int32)),
                        pa.array(np.concatenate([np.zeros(len(one)), lengths]).astype(np.int32)),
                    ],
                    ["k1", "k2", "doc_id", "row", "first", "n"],
                )

    return docs.select("doc_id", "row", "text", "anchors").mapInArrow(run, "k1 long, k2 int, doc_id long, row long, first int, n int")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of their keys: (doc_id, row, run) of those whose key comes twice, and all known runs."""
    held: pa.RecordBatch | None = None
    held_hit = False
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        k1, k2, first, n = (b.column(k).to_numpy().astype(np.int64) for k in ("k1", "k2", "first", "n"))
        same = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]) & (n[1:] == 0) & (n[:-1] == 0)
        hit = n > 0
        hit[1:] |= same
        hit[:-1] |= same
        hit[0] |= held_hit and held is not None
        every = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array((first << 32) | np.maximum(n, 1))], ["doc_id", "row", "run"])
        yield every.slice(0, len(hit) - 1).filter(pa.array(hit[:-1]))
        held, held_hit = b.slice(len(hit) - 1), bool(hit[-1])
        last = every.slice(len(hit) - 1)
    if held is not None and held_hit:
        yield last


def repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, row, runs: runs of repeated windows, each as (first word << 32) + number of windows, where there are any."""
    anchors = _selected(docs, window)
    shared = checkpointed(anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    # What a batch holds twice needs no join, so a frequent anchor sends a row a batch at most.
    single = anchors.where("n = 1").join(shared, "anchor")
    of_doc = anchors.where("n > 1").select("anchor", "doc_id", "row").unionByName(single.select("anchor", "doc_id", "row"))
    of_doc = checkpointed(of_doc.groupBy(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row")).agg(F.collect_set("anchor").alias("anchors")))
    rows = _windows(_of(_keyed(docs), of_doc), window)
    hits = rows.repartition("k1").sortWithinPartitions("k1", "k2").mapInArrow(_repeated, "doc_id long, row long, run long")
    return hits.groupBy("doc_id", "row").agg(F.collect_set("run").alias("runs"))


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, row (a hash of the text), n_words, n_removed, kept_sha256, kept_text (null: nothing removed), for each row of docs.

    docs has doc_id and text; other columns are ignored.
    """
    runs = checkpointed(repeats(docs, window))
    runs = runs.select(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row"), "runs")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, sha, kept = [], [], [], []
            for text, of in zip(b.column(2), b.column(3)):
                words = (text.as_py() or "").encode().split()
                rest, gone = words, 0
                if of.is_valid:
                    of = np.asarray(of.values, np.int64)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, of >> 32, 1)
                    np.add.at(edge, (of >> 32) + (of & 0xFFFFFFFF) - 1 + window, -1)
                    out = np.cumsum(edge)[:-1] > 0
                    rest, gone = [w for w, x in zip(words, out) if not x], int(out.sum())
                joined = b" ".join(rest)
                n.append(len(words))
                removed.append(gone)
                sha.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode() if gone else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["doc_id", "row", "n_words", "n_removed", "kept_sha256", "kept_text"])

    if runs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # Only texts with runs are shuffled to them.
        ids = F.broadcast(runs.select("of_id", "of_row"))
        plain = _keyed(docs).join(ids, same, "left_anti").withColumn("runs", F.lit(None).cast("array<long>"))
        rows = _of(_keyed(docs), runs).select("doc_id", "row", "text", "runs").unionByName(plain)
    else:
        rows = _keyed(docs).join(runs, same, "left").select("doc_id", "row", "text", "runs")
    return rows.mapInArrow(run, "doc_id long, row long, n_words long, n_removed long, kept_sha256 string, kept_text string")
