"""Toxicity: a convolutional text classifier over hashed words, trained in numpy, with thresholds by language.

Words are lower-cased runs of letters and digits. A word's embedding is the sum of the hashed embeddings of the word and of
its beginnings, so that unseen forms of a known stem count. Filters of several widths slide over a document's words, each
filter's largest response is pooled, and a logistic layer gives the score. One coordinate of the embeddings starts from
the training sample's log-odds (a lower bound of them, so that rare words start at nothing); everything is then trained
by Adam, and the scores are rescaled on rows that the training left out, with the labels' share of toxic rows as prior.

The fit uses at most `fit_rows` labelled documents of each class, those with the least hash of doc_id (a bound on driver
memory and time), and all words of each; scoring covers all words of all documents. Thresholds by language come from
counts of scores over all labelled documents that aren't held out; a language's own errors count beside those of all
languages, so few labels move it little and a language without labels has the threshold of all. Labels of one doc_id that
differ count as toxic. Only the text goes into a score; language chooses `threshold` alone, which decides `flagged`,
never score or predicted.

A null or empty text has a score from the bias. Each row is scored by its own text, so rows that share a doc_id may differ
and equal rows don't; very long texts are read whole; an empty table gives an empty one. With no usable labels of both classes every score is the labels' share
of toxic rows, or 0 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.llm import textarrays as ta
from tideflow.llm.common import checkpointed

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 8, 6, (1, 2, 3)
#: Labelled documents of each class that the fit uses at most.
FIT_ROWS = 2000
PAD = max(WIDTHS) - 1
#: Bytes of text handled at once: less than elsewhere, as a word has features, vectors and responses beside each other.
CHUNK_BYTES = 1 << 18
#: Bytes of the beginnings of a word that count, besides the word.
STEMS = (3, 4, 5, 6, 7, 8)
#: Scores that a threshold may take.
TRIES = np.linspace(0.05, 0.95, 91)
#: Labelled documents as which all languages' errors count beside a language's own.
PRIOR = 40

#: A document's distinct words' features, and each word's index among them.
Doc = tuple[np.ndarray, np.ndarray]


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _chunks(text: pa.Array) -> Iterator[ta.Chunk]:
    return ta.chunks(text, ta.ALNUM, True, CHUNK_BYTES)


def _features(chunk: ta.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words' buckets (words, 1 + len(STEMS)), 0 for none, and each word's index among them."""
    import pandas as pd  # on workers only

    codes, _ = pd.factorize(chunk.hashes)
    some = np.zeros(codes.max(initial=-1) + 1, np.int64)
    some[codes] = np.arange(len(codes))
    first, end = chunk.first[some], chunk.end[some]
    out = np.zeros((len(some), 1 + len(STEMS)), np.uint16)
    out[:, 0] = 1 + (chunk.hashes[some] >> np.uint64(33)) % np.uint64(BUCKETS - 1)
    for k, n in enumerate(STEMS, 1):
        long = np.flatnonzero(end - first > n)
        out[long, k] = 1 + ((chunk.hash_between(first[long], first[long] + n) + np.uint64(k)) >> np.uint64(29)) % np.uint64(BUCKETS - 1)
    return out, codes


def _padded(words: np.ndarray, counts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents' words end to end, each document followed by pads, and where each starts."""
    starts = np.concatenate([[0], np.cumsum(counts + PAD)])[:-1]
    out = np.full(int(counts.sum()) + PAD * len(counts), pad, np.int64)
    out[np.arange(len(words)) + np.repeat(PAD * np.arange(len(counts)), counts)] = words
    return out, starts


def _joined(docs: list[Doc]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' features end to end, their padded words, and where each document starts."""
    features = np.concatenate([f for f, _ in docs])
    at = np.cumsum([0, *(len(f) for f, _ in docs)])
    return features, *_padded(np.concatenate([codes + k for (_, codes), k in zip(docs, at)]), np.array([len(codes) for _, codes in docs]), len(features))


class Network:
    """embed (BUCKETS, DIM), filters by width (DIM, width, FILTERS), their biases, and the last layer."""

    def __init__(self, log_odds: np.ndarray, rng: np.random.Generator) -> None:
        self.p = {"embed": rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32), "out": np.full(FILTERS * len(WIDTHS), 0.2, np.float32), "bias": np.zeros(1, np.float32)}
        self.p["embed"][:, 0] = log_odds
        self.p["embed"][0] = 0
        for w in WIDTHS:
            f = rng.normal(0, 0.1, (DIM, w, FILTERS)).astype(np.float32)
            f[0] += 1 / w
            self.p[f"f{w}"], self.p[f"b{w}"] = f, np.zeros(FILTERS, np.float32)
        self.scale, self.shift = 1.0, 0.0

    def vectors(self, features: np.ndarray) -> np.ndarray:
        """Words' embeddings, and a last row of zeros for pads."""
        out = np.zeros((len(features) + 1, DIM), np.float32)
        for k in range(features.shape[1]):
            out[:-1] += self.p["embed"][features[:, k]]
        return out

    def pooled(self, words: np.ndarray, starts: np.ndarray, vectors: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each document's largest responses; where: also their positions."""
        best, at = [], []
        for w in WIDTHS:
            z = (vectors @ self.p[f"f{w}"][:, 0])[words]
            for j in range(1, w):
                z[:-j] += (vectors @ self.p[f"f{w}"][:, j])[words[j:]]
            m = np.maximum.reduceat(z, starts, axis=0)
            best.append(m + self.p[f"b{w}"])
            if where:
                doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
                row, col = np.nonzero(z == m[doc])
                place = np.empty(m.shape, np.int64)
                place[doc[row][::-1], col[::-1]] = row[::-1]
                at.append(place)
        return np.concatenate(best, axis=1), at

    def raw(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.p["out"] + self.p["bias"][0]

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -30, 30)))

    def gradients(self, docs: list[Doc], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        features, words, starts = _joined(docs)
        vectors = self.vectors(features)
        pooled, at = self.pooled(words, starts, vectors, where=True)
        p = 1 / (1 + np.exp(-np.clip(self.raw(pooled), -30, 30)))
        d = ((p - y) * weight / len(y)).astype(np.float32)
        g = {"out": np.maximum(pooled, 0).T @ d, "bias": d.sum(keepdims=True), "embed": np.zeros_like(self.p["embed"])}
        back = d[:, None] * self.p["out"] * (pooled > 0)
        every = np.concatenate([features, np.zeros((1, features.shape[1]), np.uint16)])
        for k, w in enumerate(WIDTHS):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"b{w}"] = own.sum(axis=0)
            g[f"f{w}"] = np.zeros_like(self.p[f"f{w}"])
            for j in range(w):
                word = words[np.minimum(at[k] + j, len(words) - 1)]
                g[f"f{w}"][:, j] = np.einsum("nf,nfd->df", own, vectors[word])
                step = (own[:, :, None] * self.p[f"f{w}"][:, j].T[None]).reshape(-1, DIM)
                for column in every[word.ravel()].T:
                    np.add.at(g["embed"], column, step)
        g["embed"][0] = 0
        return g


def _log_odds(docs: list[Doc], y: np.ndarray) -> np.ndarray:
    """Each bucket's log-odds of a toxic document, two standard errors nearer to 0."""
    df = np.zeros((2, BUCKETS))
    for (features, _), label in zip(docs, y):
        df[int(label), np.unique(features)] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    odds = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
    error = np.sqrt(1 / (df[0] + 0.5) + 1 / (df[1] + 0.5))
    return (np.sign(odds) * np.clip(np.abs(odds) - 2 * error, 0, 3)).astype(np.float32)


def train(docs: list[Doc], y: np.ndarray, share: float, seed: int = 7, epochs: int = 12) -> Network:
    """A network fitted to documents of word features; share: of toxic rows among all labels."""
    rng = np.random.default_rng(seed)
    y = np.asarray(y, np.float64)
    order = rng.permutation(len(y))
    spare = order[: max(1, len(y) // 5)]
    rest = order[len(spare) :]
    if len(set(y[rest])) < 2 or len(set(y[spare])) < 2:
        spare = rest = order
    net = Network(_log_odds([docs[i] for i in rest], y[rest]), rng)
    weight = np.where(y == 1, (y[rest] == 0).mean(), (y[rest] == 1).mean()) * 2
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(v) for k, v in net.p.items()}
    t = 0
    for _ in range(epochs if len(rest) > 1500 else 3 * epochs):
        for part in np.array_split(rng.permutation(rest), -(-len(rest) // 128)):
            t += 1
            for k, g in net.gradients([docs[i] for i in part], y[part], weight[part]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] -= ((0.002 if k == "embed" else 0.01) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6) + 1e-4 * net.p[k]).astype(np.float32)
    # Rescale on the spare rows, weighted to the labels' true share.
    x = raw_scores(net, [docs[i] for i in spare])
    z = y[spare]
    own = np.where(z == 1, share / max(z.mean(), 1e-9), (1 - share) / max(1 - z.mean(), 1e-9))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        ga, gb = (own * (p - z) * x).mean() + 1e-3 * (a - 1), (own * (p - z)).mean()
        h = own * p * (1 - p) + 1e-6
        haa, hab, hbb = (h * x * x).mean() + 1e-3, (h * x).mean(), h.mean() + 1e-6
        det = haa * hbb - hab * hab + 1e-12
        a, b = a - 0.5 * (hbb * ga - hab * gb) / det, b - 0.5 * (haa * gb - hab * ga) / det
    net.scale, net.shift = float(np.clip(a, 0.05, 20)), float(b)
    return net


def raw_scores(net: Network, docs: list[Doc]) -> np.ndarray:
    out = []
    for lo in range(0, len(docs), 256):
        features, words, starts = _joined(docs[lo : lo + 256])
        out.append(net.raw(net.pooled(words, starts, net.vectors(features))[0]))
    return np.concatenate(out)


def thresholds(scores: DataFrame, usable: DataFrame) -> tuple[dict[str | None, float], float]:
    """By language, the score from which a document is flagged, and that of all languages: those with the least errors.

    scores has doc_id, lang and score, of which those with a row in usable (doc_id, toxic) count; 0.5 without any.
    """
    bins = F.aggregate(F.array(*[F.lit(float(x)) for x in TRIES]), F.lit(0), lambda a, x: a + (F.col("score") >= x).cast("int"))
    counted = scores.join(usable, "doc_id").groupBy("lang", "toxic", bins.alias("bin")).count().collect()  # languages * 2 * 92 rows at most
    # errors[k]: of rows in bins up to k, toxic ones are missed at try k; of those beyond, clean ones are flagged.
    by_lang: dict[str | None, np.ndarray] = {}
    for r in counted:
        by_lang.setdefault(r["lang"], np.zeros((2, len(TRIES) + 1)))[r["toxic"], r["bin"]] += r["count"]

    def errors(n: np.ndarray) -> np.ndarray:
        return np.cumsum(n[1])[:-1] + n[0].sum() - np.cumsum(n[0])[:-1]

    def best(e: np.ndarray) -> float:
        good = np.flatnonzero(e <= e.min() + 1e-9)
        return float(TRIES[good[np.argmin(np.abs(TRIES[good] - 0.5))]])

    if not by_lang:
        return {}, 0.5
    every = sum(by_lang.values())
    rate = errors(every) / every.sum()
    return {k: best(errors(n) + PRIOR * rate) for k, n in by_lang.items()}, best(rate)


def usable_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic, a row for each labelled document that isn't held out."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    return usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def fit(docs: DataFrame, usable: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Network | None, float]:
    """The network, and the share of toxic rows among usable labels."""
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    parts = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * fit_rows rows

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in _chunks(b.column(1)):
                features, codes = _features(c)
                blobs, own = [], []
                for i in range(c.n):
                    some, at = np.unique(codes[c.word_at[i] : c.word_at[i + 1]], return_inverse=True)
                    blobs.append(features[some].tobytes())
                    own.append(at.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0)[c.lo : c.hi], pa.array(blobs, pa.binary()), pa.array(own, pa.binary()), b.column(2)[c.lo : c.hi]], ["doc_id", "features", "codes", "toxic"])

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "toxic").mapInArrow(ids, "doc_id long, features binary, codes binary, toxic int")
    # Of rows that repeat a doc_id the same one in any order, so that 2 * fit_rows at most come to the driver.
    got = sorted(rows.groupBy("doc_id").agg(F.max(F.struct("codes", "features", "toxic")).alias("r")).select("doc_id", "r.*").collect(), key=lambda r: r["doc_id"])
    y = np.array([r["toxic"] for r in got], np.float64)
    if not 0 < y.sum() < len(y):
        return None, share
    words = [(np.frombuffer(r["features"], np.uint16).reshape(-1, 1 + len(STEMS)), np.frombuffer(r["codes"], np.int32).astype(np.int64)) for r in got]
    return train(words, y, share), share


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, row (a hash of text and language), held_out, score, predicted, threshold, flagged, for each row of docs.

    docs has doc_id and text, and lang if there are thresholds by language; labels has doc_id and toxic.
    """
    usable = checkpointed(usable_labels(labels))
    net, share = fit(docs, usable, fit_rows)
    model = docs.sparkSession.sparkContext.broadcast(net)
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for b in batches:
            for c in _chunks(b.column(1)):
                if net is None:
                    score = np.full(c.n, share)
                else:
                    features, codes = _features(c)
                    words, starts = _padded(codes, c.counts, len(features))
                    score = net.score(net.raw(net.pooled(words, starts, net.vectors(features))[0])).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0)[c.lo : c.hi], b.column(2)[c.lo : c.hi], b.column(3)[c.lo : c.hi], pa.array(score)], ["doc_id", "lang", "row", "score"])

    scores = checkpointed(docs.select("doc_id", "text", "lang", F.xxhash64("text", "lang").alias("row")).mapInArrow(run, "doc_id long, lang string, row long, score double"))
    by_lang, general = thresholds(scores, usable) if net is not None else ({}, 0.5)
    limits = F.broadcast(docs.sparkSession.createDataFrame(list(by_lang.items()), "of string, own double"))  # a row a language
    out = scores.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("threshold", F.coalesce("own", F.lit(general)))
    return out.select("doc_id", "row", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))
