"""What keeps disk and memory small: tiles of the same sets are compared once, and toxicity takes texts in small chunks."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from tideflow.llm import ngram_join as nj
from tideflow.llm import toxicity as tox


def test_tiles_of_the_same_sets_are_kept_once(spark: SparkSession) -> None:
    rows = [(t, n, n) for t in (1, 2, 3) for n in (10, 11)] + [(4, n, n) for n in (10, 11, 12)] + [(5, n, 10) for n in (10, 13)]
    named = spark.createDataFrame(rows, "token long, node long, component long")
    assert {(r["token"], r["g"]) for r in nj._open(named).collect()} == {(1, 2), (4, 3)}


def test_passages_shared_by_many_shingles_still_link(spark: SparkSession) -> None:
    words = [f"w{i}" for i in range(200)]
    texts = [words, [*words[:199], "x"], ["y", *words[1:199], "z"], [f"v{i}" for i in range(200)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in nj.jaccard_components(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_toxicity_scores_a_batch_in_little_memory() -> None:
    text = pa.array([" ".join(f"word{(i * j) % 977}" for j in range(400)) for i in range(1500)])
    assert text.nbytes > 4_000_000
    net = tox.Network(np.zeros(tox.BUCKETS, np.float32), np.random.default_rng(1))
    tracemalloc.start()
    n = 0
    for c in tox._chunks(text):
        features, codes = tox._features(c)
        words, starts = tox._padded(codes, c.counts, len(features))
        n += len(net.pooled(words, starts, net.vectors(features))[0])
        del features, codes, words, starts
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1500 and peak < 32_000_000
