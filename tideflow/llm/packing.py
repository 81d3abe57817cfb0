"""Packing documents into training sequences of a fixed capacity by minimum bin slack.

Texts are encoded once, into a table in the shared folder; a document's ids are cut into full sequences and a rest shorter
than the capacity. Only the number of rests of each length matters to the fill, so the plan is made on that histogram,
which has capacity - 1 entries at any size of the corpus: a window starts with the longest rest left; a subset-sum
program on bitsets (bit s: a sum of s can be reached) tries the remaining lengths, the most frequent first and each as
often as it is there, until the window is full or all are tried; tracking the fullest sum back gives how many rests of
each length the window takes; and the window is repeated as often as these counts last. A rest finds its window from its
rank among the rests of its length: ranks are counted within the tasks that wrote the table and moved by how many rests
of the length the tasks before it have, so no length is gathered in one task.

Windows that stay open by more than most_padding ids are dealt out as sequences of powers of two instead, which need no
padding: each of their rests is cut at its binary digits.

Each row is a document, also where doc_ids repeat or are null; a null text is an empty one and has its end id alone; of
equal rests any may go first; an empty table gives no rows; columns other than doc_id and text are ignored. A sequence's
pieces lie in it without gaps from offset 0.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tideflow.llm.common import shared_folder, small_or_shuffled
from tideflow.llm.tokens import encoder

CAPACITY = 2048
END = 1
#: Ids that a window may lack before its rests are dealt out as powers of two.
MOST_PADDING = 20
#: Planned windows are numbered below it; a task's full sequences from a multiple of it.
FULL_FROM = 1 << 40

_ENCODED = "doc_id long, block long, n_tokens long, rest int, nth long, full_before long, ids binary"


def _encoding(vocabulary: str, end: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ranks, full = TaskContext.get().partitionId(), Counter(), 0
        tail = np.array([end], "<u4")
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for ids in encoder(vocabulary).encode(part.column("text").to_pylist()):
                    n = len(ids) + 1
                    rest = n % capacity
                    rows.append((n, rest, ranks[rest], full, np.concatenate([ids, tail]).astype("<u4").tobytes()))
                    ranks[rest] += 1
                    full += n // capacity
                n, rest, nth, before, ids = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([block] * len(n), pa.int64()), pa.array(n, pa.int64()), pa.array(rest, pa.int32()), pa.array(nth, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "block", "n_tokens", "rest", "nth", "full_before", "ids"],
                )

    return run


def encoded(docs: DataFrame, vocabulary: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit, the end id last) of each row, with its place: block, rest, nth, full_before.

    Written to the shared folder, so ranks within a block hold for all who read it.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/encoded-{uuid.uuid4().hex}"
    docs.select("doc_id", "text").mapInArrow(_encoding(vocabulary, end, capacity), _ENCODED).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The window that the longest length starts and that the others fill closest to capacity: how many of each length."""
    longest = max(counts)
    left = counts | {longest: counts[longest] - 1}
    room = capacity - longest
    reach, steps = 1, []
    for length in sorted((x for x in left if x <= room), key=lambda x: (-left[x], -x)):
        most, take = min(left[length], room // length), 1
        while most > 0:
            take = min(take, most)
            steps.append((length, take, reach))
            reach |= reach << (length * take)
            most, take = most - take, take * 2
        if reach >> room & 1:
            break
    total = (reach & ((1 << (room + 1)) - 1)).bit_length() - 1
    used = Counter({longest: 1})
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] += take
            total -= length * take
    return dict(used)


def fill_plan(counts: dict[int, int], capacity: int, most_padding: int = MOST_PADDING) -> list[tuple]:
    """(rest, from, upto, each, first_sequence, offset, cut): which ranks of a length go to which windows.

    Ranks from..upto-1 go, `each` to a window, to windows from first_sequence on, at offset; where cut holds, each of them
    goes by its binary digits to as many sequences of its own.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    done: Counter = Counter()
    plan, sequence = [], 0
    while left:
        used = fullest(left, capacity)
        windows = min(left[k] // n for k, n in used.items())
        fill = sum(k * n for k, n in used.items())
        cut = capacity - fill > most_padding and fill & (fill - 1) != 0
        offset = 0
        for k, n in sorted(used.items(), reverse=True):
            plan.append((k, done[k], done[k] + n * windows, n, sequence, offset, cut))
            done[k] += n * windows
            left[k] -= n * windows
            if not left[k]:
                del left[k]
            offset += k * n
            if cut:
                sequence += n * windows * k.bit_count()
        sequence += 0 if cut else windows
    return plan


_PIECE = "struct<start:long,length:long,sequence_id:long,offset:long>"


def _rest_pieces(capacity: int) -> Column:
    """The pieces of a row's rest, from its plan entry e and its rank."""
    start, rest = F.col("n_tokens") - F.col("rest"), F.col("rest").cast("long")
    nth = F.col("rank") - F.col("e.from")
    window = nth - nth % F.col("e.each")
    whole = F.array(F.struct(start.alias("start"), rest.alias("length"), (F.col("e.first_sequence") + window / F.col("e.each")).cast("long").alias("sequence_id"), (F.col("e.offset") + nth % F.col("e.each") * rest).alias("offset")).cast(_PIECE))
    bits = F.array(*[F.lit(1 << k) for k in reversed(range(capacity.bit_length()))])
    digits = F.filter(bits, lambda b: F.col("rest").bitwiseAND(b) != 0)
    first = F.col("e.first_sequence") + nth * F.size(digits)
    above = lambda b: F.col("rest") - F.col("rest") % (b * 2)
    cut = F.transform(digits, lambda b, i: F.struct((start + above(b)).alias("start"), b.cast("long").alias("length"), (first + i).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).cast(_PIECE))
    return F.when(F.col("rest") == 0, F.array().cast(f"array<{_PIECE}>")).when(F.col("e.cut"), cut).otherwise(whole)


def pack(docs: DataFrame, vocabulary: str, end: int = END, capacity: int = CAPACITY, most_padding: int = MOST_PADDING) -> DataFrame:
    """doc_id, doc_tokens, start, length, sequence_id, offset, ids: one row a piece."""
    rows = encoded(docs, vocabulary, end, capacity)
    spark = rows.sparkSession
    counts = rows.where("rest > 0").groupBy("rest", "block").agg(F.count("*").alias("n"))
    # One row a length: fewer than capacity, whatever the corpus.
    plan = fill_plan({r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}, capacity, most_padding)
    entries = spark.createDataFrame(plan, 'rest int, "from" long, upto long, each long, first_sequence long, offset long, cut boolean'.replace('"', "`"))
    entries = entries.groupBy("rest").agg(F.sort_array(F.collect_list(F.struct("from", "upto", "each", "first_sequence", "offset", "cut"))).alias("entries"))
    before = Window.partitionBy("rest").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.select("rest", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("moved"))
    ranked = rows.join(small_or_shuffled(moved), ["rest", "block"], "left").join(F.broadcast(entries), "rest", "left").withColumn("rank", F.col("moved") + F.col("nth"))
    own = F.get(F.filter("entries", lambda e: (F.col("rank") >= e["from"]) & (F.col("rank") < e["upto"])), F.lit(0))
    full = (F.col("n_tokens") - F.col("rest")) / capacity
    numbers = F.when(full > 0, F.sequence(F.lit(0).cast("long"), full.cast("long") - 1)).otherwise(F.array().cast("array<long>"))
    of_task = (F.col("block") + 1) * F.lit(FULL_FROM) + F.col("full_before")
    wholes = F.transform(numbers, lambda k: F.struct((k * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), (of_task + k).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).cast(_PIECE))
    placed = ranked.withColumn("e", own).select("doc_id", "n_tokens", "ids", F.concat(wholes, _rest_pieces(capacity)).alias("pieces"))
    bytes_of = lambda p: F.substring(F.col("ids"), (p["start"] * 4 + 1).cast("int"), (p["length"] * 4).cast("int"))
    cut = F.transform("pieces", lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"), p["sequence_id"].alias("sequence_id"), p["offset"].alias("offset"), bytes_of(p).alias("ids")))
    return placed.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.explode(cut).alias("p")).select("doc_id", "doc_tokens", "p.start", "p.length", "p.sequence_id", "p.offset", "p.ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, ids (an array), doc_starts (offsets at which a document's piece starts), for each sequence of pack().

    A sequence holds capacity ids at most, so a group is small.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    g = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    joined = F.hex(F.aggregate("parts", F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"])))
    # Four little-endian bytes an id.
    number = lambda i: F.conv(F.concat(*[F.substring(joined, i * 8 + 2 * k + 1, 2) for k in (3, 2, 1, 0)]), 16, 10).cast("int")
    ids = F.transform(F.sequence(F.lit(0), F.col("length").cast("int") - 1), number)
    return g.select("sequence_id", "length", ids.alias("ids"), F.transform("parts", lambda p: p["offset"]).alias("doc_starts"))


def pieces_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs, vocabulary).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
