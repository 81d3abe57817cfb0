"""N-gram Jaccard join: links between documents whose word-shingle sets are similar, and their components.

A set's shingles are put in one order for all sets, rare ones first. If 100 * overlap >= percent * union, the two sets
share a shingle among the first size - ceil(percent * size / 100) + 1 of each, so those are a set's prefix, and each
(size band, prefix shingle) is a tile in which every pair that can pass meets. Bands are a factor of four wide; a set
whose partners may be of the next band goes into that band's tiles, too. Rarity is read from a hashed table of counts of
fixed size: it only decides the order, so that a passage which many documents share stands in few prefixes; no pair hangs
on it. In a tile, documents are ordered by size and compared inside the sizes that the threshold allows. Parity bitmaps
bound the overlap from above (each differing shingle flips one bit, so the sets differ in at least as many shingles as
their bitmaps in bits), and pairs that pass are settled by intersecting the sorted arrays.

A large tile isn't expanded into all pairs. Documents of one batch that share a token send one of them, their head, to the
tile and are compared with it; the others go along under a salted key, so a token that a third of all documents have is
spread out. Then each document is compared with one document only, the nearest by bitmap of its tiles' heads, and the
links are merged into components. Documents of a tile that still lie in different components are compared in blocks of
bounded size: first the nearest pair of each two components, and, after merging again, all pairs that are left. Pairs
inside one component can't change it, so no component loses a link.

Equal sets are one node, named by a 64-bit hash of the set; rows are told apart by doc_id and a hash of the text. Null
texts and texts without a word have no shingles and link with nothing. Rows that repeat a doc_id link each by its own
text. A row with a null doc_id links as others do and doesn't name a component: its component_id is the smallest doc_id
that it reaches, null if there is none. Texts of any length are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.llm import textarrays as ta
from tideflow.llm.common import checkpointed, small_or_shuffled
from tideflow.llm.components import components

#: Log2 of the number of hashed counts, and of the parts in which they are added up.
LOAD_BITS, PART_BITS = 20, 16
#: Factor between the least and the largest size of a band.
BAND = 4
#: Bits of a token. Two that agree by chance put sets into one tile that needn't be; no pair is lost or linked by it.
TOKEN_BITS = 40
#: 64-bit words of a bitmap.
BITMAP = 16
#: Bytes of text handled at once: less than elsewhere, as several arrays a word are held beside each other.
CHUNK_BYTES = 1 << 19
#: Documents of a tile that are compared with one another in one group.
BLOCK = 1024
#: Sets up to which a list of them is broadcast.
BROADCAST_NODES = 100_000
#: Rows of one set from which it is joined apart from others.
HOT_ROWS = 100_000

_MIX_BAND = np.uint64(0x9E3779B97F4A7C15)


def _flat(chunk: ta.Chunk, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' distinct shingles end to end, each document's sorted: (document, shingle), and offsets by document.

    A shorter document is one shingle, an empty one none.
    """
    at, grams = chunk.grams(n)
    short = np.flatnonzero((chunk.counts > 0) & (chunk.counts < n))
    doc = np.concatenate([np.searchsorted(chunk.word_at, at, "right") - 1, short])
    shingle = np.concatenate([grams, ta.gram_hash(chunk.hashes, chunk.word_at[short], chunk.counts[short])]) if len(short) else grams
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])]) if len(doc) else np.zeros(0, bool)
    doc, shingle = doc[new], shingle[new]
    return doc, shingle, np.searchsorted(doc, np.arange(chunk.n + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 between offsets."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[at[1:]] - sums[at[:-1]]


def _blob(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def _bitmaps(doc: np.ndarray, shingle: np.ndarray, n: int) -> list[np.ndarray]:
    at = doc * (64 * BITMAP) + (shingle >> np.uint64(20)).astype(np.int64) % (64 * BITMAP)
    bits = (np.bincount(at, minlength=n * 64 * BITMAP) & 1).astype(np.uint8)
    return list(np.packbits(bits).reshape(n, 8 * BITMAP))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row, text. doc_id and row (a hash of the text) tell rows apart but for equal ones."""
    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text")


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, row, size, node (a hash of the set), bits (parity bitmap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in ta.chunks(b.column(2), ta.PLAIN, True, CHUNK_BYTES):
                doc, shingle, at = _flat(c, n)
                node = ta.mix(_sums(ta.mix(shingle), at)).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0)[c.lo : c.hi], b.column(1)[c.lo : c.hi], pa.array(np.diff(at)), pa.array(node), _blob(_bitmaps(doc, shingle, c.n))], ["doc_id", "row", "size", "node", "bits"])

    return _keyed(docs).mapInArrow(run, "doc_id long, row long, size long, node long, bits binary")


def _loads(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents hold the shingles of each of 2**LOAD_BITS hashes; a task counts 255 at most."""
    part = 1 << PART_BITS
    kind = "part int, salt int, n binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, some = np.zeros(1 << LOAD_BITS, np.uint8), False
        for b in batches:
            for c in ta.chunks(b.column(0), ta.PLAIN, True, CHUNK_BYTES):
                at, more = np.unique(_flat(c, n)[1] >> np.uint64(64 - LOAD_BITS), return_counts=True)
                at = at.astype(np.int64)
                counts[at] = np.minimum(counts[at] + more, 255)
                some = True
        for k in range(len(counts) // part if some else 0):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([TaskContext.get().partitionId() // 256], pa.int32()), pa.array([counts[k * part : (k + 1) * part].tobytes()], pa.binary())], ["part", "salt", "n"])

    def add(kind: type) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(part, np.int64)
            for b in batches:
                for x in b.column("n"):
                    total += np.frombuffer(x.as_buffer(), kind)
            sums = np.minimum(total, 2**32 - 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["part", "salt", "n"])

        return run

    rows = docs.select("text").mapInArrow(run, kind).groupBy("part", "salt").applyInArrow(add(np.uint8), kind).groupBy("part").applyInArrow(add(np.uint32), kind)
    out = np.zeros(1 << LOAD_BITS, np.uint32)
    for r in rows.toLocalIterator():  # of fixed size
        out[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["n"], np.uint32)
    return out


_ROW = "token long, salt int, size int, node long, head long, head_size int, keep boolean"


def _prefixes(docs: DataFrame, n: int, percent: int, shared: Broadcast) -> DataFrame:
    """A row a set, band and prefix shingle.

    Heads and single sets of a batch have salt 0 and name no head; keep: the batch has others. shared: the hashed counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in ta.chunks(b.column(0), ta.PLAIN, True, CHUNK_BYTES):
                doc, shingle, at = _flat(c, n)
                size, node = np.diff(at), ta.mix(_sums(ta.mix(shingle), at))
                # One document of each set.
                one = np.zeros(c.n, bool)
                one[np.unique(node, return_index=True)[1]] = True
                length = np.where(one & (size > 0), size + 1 - -(-percent * size // 100), 0)
                keep = length[doc] > 0
                doc, shingle = doc[keep], shingle[keep]
                if not len(doc):
                    continue
                order = np.lexsort((shingle, shared.value[(shingle >> np.uint64(64 - LOAD_BITS)).astype(np.int64)], doc))
                place = np.arange(len(doc)) - np.searchsorted(doc, doc)
                first = place < length[doc]
                doc, shingle = doc[first], shingle[order][first]
                level = (np.log(np.maximum(size, 1)) / np.log(BAND) + 1e-9).astype(np.int64)
                most = (np.log(np.maximum(size * 100 // percent, 1)) / np.log(BAND) + 1e-9).astype(np.int64)
                # A set whose partners may be of the next band is a guest there.
                guest = np.flatnonzero((most > level)[doc])
                doc, shingle, band = np.concatenate([doc, doc[guest]]), np.concatenate([shingle, shingle[guest]]), np.concatenate([level[doc], level[doc[guest]] + 1])
                token = ta.mix(shingle ^ (band.astype(np.uint64) * _MIX_BAND)) >> np.uint64(64 - TOKEN_BITS)
                own, many = node[doc].view(np.int64), size[doc]
                order = np.lexsort((own, many, token))
                token, own, many = token[order], own[order], many[order]
                new = np.concatenate([[True], token[1:] != token[:-1]])
                head = np.flatnonzero(new)[np.cumsum(new) - 1]
                salt = np.where(new, 0, 1 + (ta.mix(own.view(np.uint64)) >> np.uint64(40)).astype(np.int64) % 1024)
                others = new & ~np.concatenate([new[1:], [True]])
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(own), pa.array(np.where(new, 0, own[head])), pa.array(np.where(new, 0, many[head]).astype(np.int32)), pa.array(others)], ["token", "salt", "size", "node", "head", "head_size", "keep"])

    return docs.select("text").mapInArrow(run, _ROW)


def _tiles(rows: DataFrame) -> DataFrame:
    """(token, node, size, head, head_size): rows whose token comes twice at least; head: its least row, or the batch's."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in order, so a tile's first row is its head; it is held until it's known whether a second one comes.
        held: np.ndarray | None = None
        told = False
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            carried = held is not None
            if carried:
                x = np.concatenate([held, x], axis=1)
            # Batches that hold the same set send the same row; the first that has others in its batch stands for them.
            again = np.concatenate([[False], (x[:4, 1:] == x[:4, :-1]).all(axis=0) & (x[6, 1:] <= x[6, :-1]) & (x[1, 1:] == 0)])
            x = x[:, ~again]
            new = np.concatenate([[True], (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])])
            at = np.flatnonzero(new)
            tile = np.cumsum(new) - 1
            salted = x[1] > 0
            out = (np.bincount(tile)[tile] > 1) | salted | (x[6] > 0)
            emitted = bool(out[-1]) or (carried and told and len(at) == 1)
            if carried and told:
                out[0] = False  # it is out already
            heads = at[tile]
            head, head_size = np.where(salted, x[4], x[3, heads]), np.where(salted, x[5], x[2, heads])
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[0, out]), pa.array(x[3, out]), pa.array(x[2, out].astype(np.int32)), pa.array(head[out]), pa.array(head_size[out].astype(np.int32))], ["token", "node", "size", "head", "head_size"])
            told, held = emitted, x[:, at[-1] : at[-1] + 1]

    ordered = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "size", "node", F.desc("keep"))
    return ordered.mapInArrow(mark, "token long, node long, size int, head long, head_size int")


def _overlap_ok(size_a: str, size_b: str, differ: F.Column | str, percent: int) -> F.Column:
    """Whether the overlap that is left when the sets differ in `differ` shingles reaches the threshold."""
    total = F.col(size_a) + F.col(size_b)
    # overlap = (total - differ) / 2; 100 * overlap >= percent * (total - overlap)
    return (100 + percent) * (total - differ) >= 2 * percent * total


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets pass, by intersecting their sorted arrays."""
    wanted = small_or_shuffled(checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), BROADCAST_NODES)
    rows = checkpointed(classes.join(wanted, "node").select("node", F.col("doc_id").alias("of_id"), F.col("row").alias("of_row")))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row"))
    texts = _keyed(docs).join(small_or_shuffled(rows, BROADCAST_NODES), same).select("node", "text").dropDuplicates(["node"])

    def sets_of(text: pa.Array) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for c in ta.chunks(text, ta.PLAIN, True, CHUNK_BYTES):
            _, shingle, at = _flat(c, n)
            out.extend(np.split(shingle, at[1:-1]))
        return out

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                ids = b.column(0).to_numpy()
                new = np.concatenate([[True], ids[1:] != ids[:-1]])
                lefts, which = sets_of(b.column(2).take(pa.array(np.flatnonzero(new)))), np.cumsum(new) - 1
                keep = []
                for i, y in enumerate(sets_of(b.column(3))):
                    both = np.concatenate([lefts[which[i]], y])
                    both.sort()
                    same = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep.append(100 * same >= percent * (len(both) - same))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(settle, "a long, b long")


def _open(named: DataFrame) -> DataFrame:
    """token, g (its number of sets): tiles whose sets (token, node, component, distinct) lie in different components.

    Documents that share a passage meet in a tile for each of its shingles; of tiles with the same sets, by 128 bits of
    their names and their number, one is kept, as all have the same pairs.
    """
    tiles = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("g"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"))
    return tiles.where("lo < hi").groupBy("g", "x", "y").agg(F.min("token").alias("token")).select("token", "g")


def _across(tiles: DataFrame, label: DataFrame, bits: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of a token's sets in different components that their bitmaps allow.

    nearest: of each two components, only the pair whose bitmaps differ least.
    """
    named = tiles.select("token", "node", "size").distinct().join(label, "node", "left").select("token", "node", "size", F.coalesce("component", "node").alias("component"))
    open_ = named.join(_open(named), "token").join(bits, "node")
    blocks = F.ceil(F.col("g") / BLOCK).cast("int")
    dealt = open_.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "size", "component", "bits")

    def pairs_of(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        """Pairs inside whole groups, rows ordered by group and size: each row with the next, the one after, and so on."""
        group = np.cumsum(np.concatenate([[True], (np.diff(x["token"]) != 0) | (np.diff(x["i"]) != 0) | (np.diff(x["j"]) != 0)]))
        bitmaps = x["bits"]
        active, found, lag = np.arange(len(group)), [[np.zeros(0, np.int64)] * 3], 0
        while True:
            lag += 1
            active = active[active + lag < len(group)]
            active = active[(group[active] == group[active + lag]) & (x["size"][active + lag] * percent <= x["size"][active] * 100)]
            if not len(active):
                break
            for lo in range(0, len(active), 1 << 16):
                a = active[lo : lo + (1 << 16)]
                a = a[(x["component"][a] != x["component"][a + lag]) & ((x["own"][a] != x["own"][a + lag]) | (x["i"][a] == x["j"][a]))]
                differ = np.bitwise_count(bitmaps[a] ^ bitmaps[a + lag]).sum(axis=1, dtype=np.int64)
                total = x["size"][a] + x["size"][a + lag]
                ok = (100 + percent) * (total - differ) >= 2 * percent * total
                found.append([a[ok], a[ok] + lag, differ[ok]])
        a, b, differ = (np.concatenate(c) for c in zip(*found))
        lo, hi = np.minimum(x["component"][a], x["component"][b]), np.maximum(x["component"][a], x["component"][b])
        left, right = np.minimum(x["node"][a], x["node"][b]), np.maximum(x["node"][a], x["node"][b])
        best = np.lexsort((right, left, differ, hi, lo)) if nearest else np.lexsort((right, left))
        keys = (lo, hi) if nearest else (left, right)
        best = best[np.concatenate([[True], (np.diff(keys[0][best]) != 0) | (np.diff(keys[1][best]) != 0)])] if len(best) else best
        return pa.RecordBatch.from_arrays([pa.array(v[best]) for v in (left, right, differ, lo, hi)], ["a", "b", "differ", "lo", "hi"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            x = {k: b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("token", "i", "j", "own", "node", "size", "component")}
            x["bits"] = np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint64).reshape(-1, BITMAP)
            if held is not None:
                x = {k: np.concatenate([held[k], x[k]]) for k in x}
            # The last group may go on in the next batch; a group has a bounded number of rows.
            last = (x["token"] == x["token"][-1]) & (x["i"] == x["i"][-1]) & (x["j"] == x["j"][-1])
            held = {k: v[last] for k, v in x.items()}
            if not last.all():
                yield pairs_of({k: v[~last] for k, v in x.items()})
        if held is not None:
            yield pairs_of(held)

    ordered = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "size", "node")
    pairs = ordered.mapInArrow(compare, "a long, b long, differ long, lo long, hi long")
    if nearest:
        return pairs.groupBy("lo", "hi").agg(F.min(F.struct("differ", "a", "b")).alias("m")).select("m.a", "m.b")
    return pairs.select("a", "b").distinct()


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included), for each row.

    docs has doc_id and text; other columns are ignored.
    """
    out = shingle_components(docs, shingle, percent)
    return out.select("doc_id", "n_shingles", "component_id")


def shingle_components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, row (xxhash64 of the text), n_shingles, component_id and lead (of the component's rows the first: its doc_id and row)."""
    sets = checkpointed(shingle_sets(docs, shingle))
    some = sets.where("size > 0")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = some.groupBy("node").agg(F.min(F.struct(*[F.col("doc_id").isNull().alias("none"), "doc_id", "row", "size", "bits"])).alias("m"), F.count("*").alias("rows"))
    classes = checkpointed(classes.select("node", "m.doc_id", "m.row", "m.size", "m.bits", "rows"))
    loads = docs.sparkSession.sparkContext.broadcast(_loads(docs, shingle))
    tiles = checkpointed(_tiles(_prefixes(docs, shingle, percent, loads)))
    loads.destroy()
    bits = classes.select("node", "bits")
    unpacked = bits.select("node", *[F.conv(F.hex(F.substring("bits", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"b{i}") for i in range(BITMAP)])

    # Each set and the nearest of its tiles' heads.
    star = tiles.select(F.col("head").alias("a"), F.col("node").alias("b"), F.col("head_size").alias("size_a"), F.col("size").alias("size_b"))
    star = star.where((100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")) & (F.col("a") != F.col("b"))).distinct()
    a = unpacked.select(F.col("node").alias("a"), *[F.col(f"b{i}").alias(f"a{i}") for i in range(BITMAP)])
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(BITMAP)), F.lit(0))
    star = star.join(unpacked.withColumnRenamed("node", "b"), "b").join(a, "a").withColumn("differ", differ).where(_overlap_ok("size_a", "size_b", F.col("differ"), percent))
    star = star.groupBy("b").agg(F.min(F.struct("differ", "a")).alias("m")).select("m.a", "b")
    links = checkpointed(_verified(checkpointed(star), classes, docs, shingle, percent))
    label = components(links).withColumnRenamed("doc_id", "node")
    for nearest in (True, False):
        pairs = checkpointed(_across(tiles, label, bits, percent, nearest))
        links = checkpointed(links.unionByName(_verified(pairs, classes, docs, shingle, percent)))
        label = components(links).withColumnRenamed("doc_id", "node")

    # Classes of one row without links are their own component; the others are joined, those of many rows apart.
    label = checkpointed(label)
    linked = classes.join(label, "node", "left").where("rows > 1 or component is not null").select("node", "rows", F.coalesce("component", "node").alias("component"), first.alias("lead"))
    least = linked.groupBy("component").agg(F.min("lead").alias("lead"))
    named = checkpointed(linked.select("node", "rows", "component").join(least, "component").select("node", "rows", "lead"))
    hot = small_or_shuffled(named.where(F.col("rows") >= HOT_ROWS).select(F.col("node").alias("hot_node"), F.col("lead").alias("hot_lead")))
    rest = small_or_shuffled(named.where(F.col("rows") < HOT_ROWS).select(F.col("node").alias("rest_node"), F.col("lead").alias("rest_lead")))
    out = some.join(hot, F.col("node") == F.col("hot_node"), "left")
    key = F.when(F.col("hot_node").isNull(), F.col("node")).otherwise(F.xxhash64("doc_id", "row"))
    out = out.withColumn("key", key).join(rest, F.col("key") == F.col("rest_node"), "left").select("doc_id", "row", "size", F.coalesce("hot_lead", "rest_lead", first).alias("lead"))
    out = out.unionByName(sets.where("size = 0").select("doc_id", "row", "size", first.alias("lead")))
    return out.select("doc_id", "row", F.col("size").alias("n_shingles"), F.col("lead.doc_id").alias("component_id"), F.struct("lead.doc_id", "lead.row").alias("lead"))
