"""Language-model scores by logistic mixing of context bit predictors, beside a smoothed unigram base score.

A text's lower-cased UTF-8 bytes and an end byte are predicted bit by bit. An event is a byte with up to five bytes before
it, back to the white space in front of its word, packed into a 64-bit key. All events are counted over the training texts
in one distributed table, which grows with the corpus; its sums by shorter contexts count the zeros and ones that follow
(context, bits of this byte so far) for the last 1 to 5 bytes. The five predictors' log-odds are mixed with weights gated
by how often the two longest contexts were seen; an adaptive probability map over (quantised prediction, bits so far)
refines the mixture.

Weights are learned online from a fifth of the training texts (by a hash of the text), whose counts are left out of the
predictors that are mixed there. Events are dealt to shards by a hash of their key and taken in its order, so the stream
is the same however the documents are partitioned; the shards' weights are averaged by the mass of events behind them.
Then all training counts enter the predictors. An event's probability depends on its key alone, so it is computed once;
frequent events' values are broadcast, FREQUENT at most, and the others are joined to the documents that hold them. Words
of the base score take the same way.

Null and empty texts have one end token and one end byte. Each row is scored by its own text: rows are told apart by
doc_id and a hash of the text, and equal rows have equal scores. Rows with a null doc_id count as training rows. Texts of
any length are read whole; without training texts all predictors are even; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.llm import textarrays as ta
from tideflow.llm.common import checkpointed, small_or_shuffled

#: Context bytes of an event, and the byte that ends a text (it is in no UTF-8 text).
ORDERS, END = 5, 0xFF
#: Words, and events, whose values are broadcast: the most frequent ones, this many at most.
FREQUENT = 1 << 19
#: Events up to which a predictor's table is broadcast (some 20 MB).
BROADCAST_EVENTS = 1 << 16
#: Distinct events that a task adds up before it passes them on.
HELD = 1 << 20
#: Events of a shard, about, and of a step of the online pass; passes over a shard.
SHARD, STEP, PASSES = 1 << 16, 1 << 10, 3
#: A training text in so many is left to learn the weights.
TUNE = 5
DELTA = 0.4
GATES, MAP = 6 * 4 * 2, 24
START = [0.1, 0.1, 0.2, 0.3, 0.3, 0.0]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _find(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each value's index in a sorted array, -1 if it isn't there."""
    if not len(sorted_):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


# ---- counts


def _events(chunk: ta.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's distinct events, each position's index among them, each position's document, and documents' first positions."""
    import pandas as pd  # on workers only

    lengths = np.diff(chunk.offsets)
    n = len(chunk.data) + chunk.n
    data = np.full(n, END, np.uint64)
    doc = np.repeat(np.arange(chunk.n), lengths + 1)
    starts = chunk.offsets[:-1] + np.arange(chunk.n)
    at = np.arange(n)
    data[at - starts[doc] < lengths[doc]] = chunk.data
    # The oldest position of a context: the white space before the word, or the text's start.
    mark = np.where(ta.SPACES[data.astype(np.uint8)], at, -1)
    oldest = np.maximum(np.maximum.accumulate(np.concatenate([[-1], mark[:-1]])), starts[doc])
    key = data.copy()
    for k in range(1, ORDERS + 1):
        key[k:] |= np.where(at[k:] - k >= oldest[k:], data[:-k], np.uint64(0)) << np.uint64(8 * k)
    codes, keys = pd.factorize(key)
    return keys, codes, doc, starts


def _counts(docs: DataFrame) -> DataFrame:
    """word (or 0 and the event in key), and how often it stands in texts that fit, that tune, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[np.ndarray]] = {False: [], True: []}
        sizes = {False: 0, True: 0}

        def told(word: bool) -> pa.RecordBatch:
            x = np.concatenate(held[word], axis=1)
            order = np.argsort(x[0], kind="stable")
            x = x[:, order]
            head = np.flatnonzero(np.concatenate([[True], x[0, 1:] != x[0, :-1]]))
            sums = np.add.reduceat(x[1:], head, axis=1).astype(np.int64)
            held[word], sizes[word] = [], 0
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(head), word)), pa.array(x[0, head].view(np.int64)), *[pa.array(s) for s in sums]], ["word", "key", "fit", "tune", "every"])

        for b in batches:
            for c in ta.chunks(b.column(0), ta.PLAIN, lower=True):
                part = b.column(1)[c.lo : c.hi].to_numpy()
                keys, codes, doc, _ = _events(c)
                import pandas as pd  # on workers only

                word_codes, words = pd.factorize(c.hashes)
                for word, own, at, of in ((False, keys, codes, doc), (True, words, word_codes, c.doc)):
                    if not len(own):
                        continue
                    n = np.bincount(at * 3 + part[of], minlength=3 * len(own)).reshape(-1, 3).T.astype(np.uint64)
                    held[word].append(np.stack([own, n[0], n[1], n.sum(axis=0)]))
                    sizes[word] += len(own)
                    if sizes[word] > HELD:
                        yield told(word)
        for word in (False, True):
            if held[word]:
                yield told(word)

    part = F.when(F.col("held"), 2).when(F.pmod(F.xxhash64("text"), F.lit(TUNE)) == 0, 1).otherwise(0)
    rows = docs.select("text", part.alias("part")).mapInArrow(run, "word boolean, key long, fit long, tune long, every long")
    return rows.groupBy("word", "key").agg(*[F.sum(c).alias(c) for c in ("fit", "tune", "every")])


# ---- predictors


def _masked(order: int) -> Column:
    return F.col("key").bitwiseAND(F.lit((1 << (8 * (order + 1))) - 1))


def _class(n: np.ndarray) -> np.ndarray:
    """How often a context was seen, in six classes."""
    return np.searchsorted(np.array([1, 3, 9, 33, 257]), n, "right").astype(np.uint8)


def _bit_counts(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of 8 bits of each sorted key's byte: the count of the byte's bits up to it, and of the bits before it.

    Keys of one context stand together in the order of their bytes, so those that share bits are a run.
    """
    totals = np.empty((9, len(key)))
    sums = np.concatenate([[0.0], np.cumsum(n)])
    for depth in range(9):
        own = key >> np.int64(8 - depth)
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        size = np.diff(np.append(head, len(key)))
        totals[depth] = np.repeat(sums[head + size] - sums[head], size)
    return totals[1:], totals[:-1]


def _predictor(counts: DataFrame, order: int) -> DataFrame:
    """k (a byte with `order` bytes before it), p: 8 log-odds (half floats) and 8 classes, from fit counts, then from all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None

        def told(x: np.ndarray) -> pa.RecordBatch:
            bit = (x[0] >> (7 - np.arange(8))[:, None]) & 1
            out = []
            for n in (x[1], x[1] + x[2]):
                own, both = _bit_counts(x[0], n)
                ones = np.where(bit == 1, own, both - own)
                out += [np.log((ones + DELTA) / (both - ones + DELTA)).astype(np.float16).T.copy().view(np.uint8), _class(both).T]
            blobs = np.concatenate(out, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.Array.from_buffers(pa.binary(48), len(blobs), [None, pa.py_buffer(blobs.tobytes())]).cast(pa.binary())], ["k", "p"])

        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([c.to_numpy().astype(np.int64) for c in b.columns])
            x = x if held is None else np.concatenate([held, x], axis=1)
            # The last context may go on in the next batch; a context has 256 bytes at most.
            last = (x[0] >> 8) == (x[0, -1] >> 8)
            if not last.all():
                yield told(x[:, ~last])
            held = x[:, last]
        if held is not None:
            yield told(held)

    summed = counts.groupBy(_masked(order).alias("k")).agg(F.sum("fit").alias("fit"), F.sum("tune").alias("tune"))
    ordered = summed.repartition(F.shiftright("k", 8)).sortWithinPartitions("k")
    return ordered.mapInArrow(run, "k long, p binary")


def _predicted(counts: DataFrame) -> DataFrame:
    """counts with p1 to p5, the predictors' blobs by order."""
    out = counts
    for order in range(1, ORDERS + 1):
        own = _predictor(counts, order)
        # Contexts of one byte are 65,536 at most; longer ones are joined as they are.
        own = F.broadcast(own) if order == 1 else small_or_shuffled(checkpointed(own), BROADCAST_EVENTS)
        out = out.withColumn("k", _masked(order)).join(own.withColumnRenamed("p", f"p{order}"), "k").drop("k")
    return out


def _unpacked(b: pa.RecordBatch, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds (ORDERS, 8, n) and gates (8, n) of a batch with p1 to p5; every: from all counts, else from fit counts."""
    odds, classes = [], []
    for order in range(1, ORDERS + 1):
        raw = np.frombuffer(b"".join(b.column(f"p{order}").to_pylist()), np.uint8).reshape(-1, 48)[:, 24 * every : 24 * every + 24]
        odds.append(raw[:, :16].copy().view(np.float16).astype(np.float32).T)
        classes.append(raw[:, 16:].T.astype(np.int64))
    first = np.zeros_like(classes[0])
    first[0] = 1
    return np.stack(odds), (classes[-1] * 4 + np.minimum(classes[-2], 3)) * 2 + first


def _nodes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of 8 bits: the byte's bits so far, and the bit."""
    symbol, depth = key & 255, np.arange(8)[:, None]
    return (1 << depth) | (symbol >> (8 - depth)), (symbol >> (7 - depth)) & 1


def _mixed(odds: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = weights[gate, ORDERS]
    for k in range(ORDERS):
        z = z + weights[gate, k] * odds[k]
    return np.clip(z, -12, 12)


def _cell(z: np.ndarray, node: np.ndarray) -> np.ndarray:
    return node * MAP + ((z + 12) * (MAP - 1) / 24 + 0.5).astype(np.int64)


def _learn(predicted: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The mixer's weights (GATES, ORDERS + 1) and the map's refined probabilities, from an online pass over each shard."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("key").to_numpy(), b.column("tune").to_numpy().astype(np.float64), *_unpacked(b, False)) for b in batches if b.num_rows]
        keys, n = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        odds, gate = np.concatenate([x[2] for x in parts], axis=2), np.concatenate([x[3] for x in parts], axis=1)
        order = np.argsort(ta.mix(keys.view(np.uint64)), kind="stable")
        keys, n, odds, gate = keys[order], n[order], odds[:, :, order], gate[:, order]
        node, bit = _nodes(keys)
        weights, curve = np.tile(np.array(START), (GATES, 1)), np.full((GATES, ORDERS + 1), 20.0)
        mass, cells = np.zeros(GATES), np.zeros((2, 256 * MAP))
        for again in range(PASSES):
            for lo in range(0, len(keys), STEP):
                s = slice(lo, lo + STEP)
                z = _mixed(odds[:, :, s], gate[:, s], weights)
                p = 1 / (1 + np.exp(-z))
                g, every = gate[:, s].ravel(), np.broadcast_to(n[s], z.shape).ravel()
                miss, bend = (bit[:, s] - p).ravel() * every, np.maximum(p * (1 - p), 0.01).ravel() * every
                for k in range(ORDERS + 1):
                    x = odds[k, :, s].ravel() if k < ORDERS else np.ones(len(g))
                    curve[:, k] += np.bincount(g, bend * x * x, GATES)
                    weights[:, k] += np.clip(0.3 * np.bincount(g, miss * x, GATES) / curve[:, k], -0.1, 0.1)
                if again == PASSES - 1:
                    mass += np.bincount(g, every, GATES)
                    cell = _cell(z, node[:, s]).ravel()
                    cells[0] += np.bincount(cell, every, 256 * MAP)
                    cells[1] += np.bincount(cell, every * bit[:, s].ravel(), 256 * MAP)
        value = np.concatenate([(weights * mass[:, None]).ravel(), mass, cells.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value)), pa.int32()), pa.array(value)], ["i", "v"])

    width = ORDERS + 1
    out = np.zeros(GATES * (width + 1) + 2 * 256 * MAP)
    dealt = predicted.where("tune > 0").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    rows = dealt.select("shard", "key", "tune", *[f"p{k + 1}" for k in range(ORDERS)]).groupBy("shard").applyInArrow(run, "i int, v double")
    for r in rows.groupBy("i").agg(F.sum("v").alias("v")).collect():  # of fixed size
        out[r["i"]] = r["v"]
    mass = out[GATES * width : GATES * (width + 1)][:, None]
    weights = np.where(mass > 0, out[: GATES * width].reshape(GATES, width) / np.maximum(mass, 1e-9), np.array(START))
    seen, ones = out[GATES * (width + 1) :].reshape(2, 256, MAP)
    middle = 1 / (1 + np.exp(-(np.arange(MAP) * 24 / (MAP - 1) - 12)))
    return weights, ((ones + 20 * middle) / (seen + 20)).ravel()


def _costs(predicted: DataFrame, weights: np.ndarray, refined: np.ndarray) -> DataFrame:
    """key, every, value: an event's log10 probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node, bit = _nodes(b.column("key").to_numpy())
            z = _mixed(*_unpacked(b, True), weights)
            p = (1 / (1 + np.exp(-z)) + refined[_cell(z, node)]) / 2
            # 1 / 2**16 of even odds, so that nothing is impossible and zeros and ones still add up to one.
            p = p * (1 - 2.0**-16) + 2.0**-17
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("every"), pa.array(np.log10(np.where(bit == 1, p, 1 - p)).sum(axis=0))], ["key", "every", "value"])

    return predicted.select("key", "every", *[f"p{k + 1}" for k in range(ORDERS)]).mapInArrow(run, "key long, every long, value double")


# ---- scores


def _split(values: DataFrame, frequent: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """The most frequent keys, sorted, and their values; and the others as a table. values has key, every, value."""
    level = F.floor(2 * F.log2("every")).cast("int")
    cut, held = 10**9, 0
    for r in values.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most two rows a power of two
        if (held := held + r["count"]) > frequent:
            break
        cut = r["level"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in b.columns], ["key", "value"])

    rows = values.where(level >= cut).select("key", "value").mapInArrow(pack, "key binary, value binary").collect()  # bounded by frequent
    keys = np.frombuffer(b"".join(bytes(r["key"]) for r in rows), np.int64)
    order = np.argsort(keys)
    return keys[order], np.frombuffer(b"".join(bytes(r["value"]) for r in rows), np.float64)[order], values.where(level < cut)


def _rare(docs: DataFrame, words: np.ndarray, events: np.ndarray) -> DataFrame:
    """word, key, doc_id, row, tf: what a document holds beside the frequent words and events."""
    shared = docs.sparkSession.sparkContext.broadcast((words, events))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd  # on workers only

        words, events = shared.value
        for b in batches:
            for c in ta.chunks(b.column(2), ta.PLAIN, lower=True):
                keys, codes, doc, _ = _events(c)
                word_codes, own_words = pd.factorize(c.hashes)
                for word, own, at, of, often in ((False, keys, codes, doc, events), (True, own_words, word_codes, c.doc, words)):
                    if not len(own):
                        continue
                    rare = np.flatnonzero((_find(often, own.view(np.int64)) < 0)[at])
                    pair, tf = np.unique(of[rare] * len(own) + at[rare], return_counts=True)
                    if len(pair):
                        where = pa.array(pair // len(own))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), word)), pa.array(own[pair % len(own)].view(np.int64)), b.column(0)[c.lo : c.hi].take(where), b.column(1)[c.lo : c.hi].take(where), pa.array(tf.astype(np.int32))], ["word", "key", "doc_id", "row", "tf"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, "word boolean, key long, doc_id long, row long, tf int")


def lm_scores(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, for each row of docs.

    docs has doc_id and text; other columns are ignored. Documents with crc32(doc_id as text) mod 7 = 2 are held out.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64("text").alias("row"), "text", held_out(F.col("doc_id")).alias("held"))
    counts = checkpointed(_counts(docs))
    n = F.col("fit") + F.col("tune")
    words, events = counts.where("word"), counts.where("not word").drop("word")
    total, distinct = words.where(n > 0).agg(F.coalesce(F.sum(n), F.lit(0)), F.count("*")).first()
    ends = docs.where("not held").count()
    n_all, v_all = total + ends, distinct + (ends > 0)

    predicted = _predicted(events)
    weights, refined = _learn(predicted, 1 + events.where("tune > 0").count() // SHARD)
    costs = checkpointed(_costs(predicted, weights, refined))
    known = words.where(n > 0).select("key", "every", F.log10(n + 1.0).alias("value"))
    word_keys, word_values, rare_words = _split(known, frequent)
    event_keys, event_values, rare_events = _split(costs, frequent)
    # Words that no training text holds add nothing, so they may as well be missing from both.
    table = rare_words.select(F.lit(True).alias("word"), "key", "value").unionByName(rare_events.select(F.lit(False).alias("word"), "key", "value"))
    rare = _rare(docs, word_keys, event_keys).join(table, ["word", "key"])
    of = lambda word, x: F.coalesce(F.sum(F.when(F.col("word") == word, x)), F.lit(0))
    rare = rare.groupBy("doc_id", "row").agg(of(True, F.col("tf") * F.col("value")).alias("more"), of(True, F.col("tf")).alias("more_known"), of(False, F.col("tf") * F.col("value")).alias("more_score"))
    model = spark.sparkContext.broadcast((word_keys, word_values, event_keys, event_values))
    end_log = math.log10(ends + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_keys, word_values, event_keys, event_values = model.value
        for b in batches:
            for c in ta.chunks(b.column(2), ta.PLAIN, lower=True):
                keys, codes, _, starts = _events(c)
                at = _find(event_keys, keys.view(np.int64))
                cost = np.where(at >= 0, event_values[at] if len(event_values) else 0.0, 0.0)
                score = np.add.reduceat(cost[codes], starts)
                at = _find(word_keys, c.hashes.view(np.int64))
                value, hit = np.where(at >= 0, word_values[at] if len(word_values) else 0.0, 0.0), (at >= 0).astype(np.int64)
                sums, hits = np.concatenate([[0], np.cumsum(value)]), np.concatenate([[0], np.cumsum(hit)])
                part, known = np.diff(sums[c.word_at]), np.diff(hits[c.word_at])
                yield pa.RecordBatch.from_arrays([b.column(0)[c.lo : c.hi], b.column(1)[c.lo : c.hi], pa.array(np.diff(c.offsets)), pa.array(c.counts.astype(np.int64) + 1), pa.array(known), pa.array(part), pa.array(score)], ["doc_id", "row", "n_bytes", "n_tokens", "known", "part", "score"])

    plain = docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, n_bytes long, n_tokens long, known long, part double, score double")
    # Equal rows bring equal parts; each has its own.
    plain = checkpointed(plain)
    copies = plain.groupBy("doc_id", "row").agg(F.count("*").alias("copies"))
    rare = rare.withColumnsRenamed({"doc_id": "of_id", "row": "of_row"})
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row"))
    more = rare.join(copies, same).select("of_id", "of_row", *[(F.col(c) / F.col("copies")).alias(c) for c in ("more", "more_known", "more_score")])
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return plain.join(more, same, "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce(F.round("more_known"), F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("more", F.lit(0.0)) + end_log - F.col("n_tokens") * F.lit(math.log10(n_all + v_all + 1))).alias("base_score"),
        score.alias("score"),
        (-score / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
