"""Ranked search, the filter audit and packing against brute force over whole texts, with awkward rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import DataFrame, SparkSession
from test_contracts import ALNUM, LOWER, PLAIN, SCHEMA, awkward
from tokenizers import Tokenizer

from tideflow.llm import filter_audit, packing, ranked_search, tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows(spark: SparkSession) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): given texts and awkward ones, repeated and null ids, equal rows."""
    given = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    more = [(10_000_000 + i, t) for i, t in enumerate(awkward())]
    twice = [(7, "one id, two texts"), (7, "one id, two texts"), (7, "and another"), (None, "no id"), (None, "no id"), (None, None), (None, given[0][1]), (-5, given[1][1])]
    return [(i, t, "en", ("a", "b", None, "", "Z")[k % 5], len(t or "")) for k, (i, t) in enumerate(given + more + twice)]


@pytest.fixture(scope="module")
def docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    # Columns whose names clash with those that the operators make.
    extra = "item long, rank int, part string, mask int, ids string, rest int, block long"
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "y", 4, 5) for r in rows], f"{SCHEMA}, {extra}").repartition(5).cache()


def words(text: str | None) -> list[str]:
    return ALNUM.findall((text or "").translate(LOWER))


def best_of(rows: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    counted = [(i, c, sum(c.values())) for i, c in ((r[0], Counter(words(r[1]))) for r in rows) if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        terms = Counter(words(text))
        scores = []
        for doc_id, c, size in counted:
            m = 25 + (75 * size * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in terms.items() if t in c)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_ranked_search(spark: SparkSession, docs: DataFrame, rows: list[tuple]) -> None:
    given = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()
    items = [(r.item_id, r.text) for r in given] + [(-1, None), (-2, ""), (-3, "no such termsatall xyzzyq"), (-4, "the THE mit license w w"), (-5, rows[3][1]), (None, "one two no id"), (-4, "Köln line")]
    table = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, doc_id long")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search.search(docs, table).collect()), key=str)
    assert got == best_of(rows, items)


def test_queries_in_small_blocks_and_reuse_of_an_index(spark: SparkSession, docs: DataFrame, rows: list[tuple], monkeypatch: pytest.MonkeyPatch) -> None:
    items = [(i, " ".join(words(rows[i][1])[:30])) for i in range(12)]
    monkeypatch.setattr(ranked_search, "ITEMS", 5)
    index = ranked_search.build_index(docs)
    for k in (1, 3):
        out = ranked_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), k, index)
        assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in out.collect()), key=str) == best_of(rows, items, k)


def test_bounds_are_never_below_scores_and_exclude_most(docs: DataFrame, rows: list[tuple]) -> None:
    index = ranked_search.build_index(docs)
    block = next(ranked_search._blocks_of_items(docs.sparkSession.createDataFrame([(i, " ".join(words(rows[i][1])[:40])) for i in range(60)], "item_id long, text string")))
    query = ranked_search._query(index, block)
    exact = {(i, d): s for i, _, d, s in best_of(rows, [(i, " ".join(words(rows[i][1])[:40])) for i in range(60)], len(rows))}
    open_ = held = 0
    for r in index.where("bits > 0").collect():
        bounds = ranked_search._bounds(query, np.array(r["n"]), r["bits"], bytes(r["slices"]))
        for i in range(60):
            tenth = sorted((s for (item, _), s in exact.items() if item == i), reverse=True)[:10][-1]
            for d, bound in zip(r["doc_ids"], bounds[i], strict=True):
                held += 1
                open_ += bound >= tenth
                if d not in (7, None):
                    assert bound >= exact.get((i, d), 0)
    assert open_ < held / 5


def test_search_of_empty_tables(spark: SparkSession, docs: DataFrame) -> None:
    items, none = spark.createDataFrame([(1, "a b")], "item_id long, text string"), spark.createDataFrame([], SCHEMA)
    assert ranked_search.search(none, items).collect() == []
    assert ranked_search.search(docs, items.where("false")).collect() == []
    assert ranked_search.search(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), items).collect() == []


def audit(rows: list[tuple], labels: list[tuple]) -> list[tuple]:
    least: dict[str, int] = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    parts = defaultdict(list)
    for doc_id, text, _, source, _ in rows:
        text = text or ""
        w = PLAIN.findall(text)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and doc_id > least[text]}
        parts[source or ""].append(({k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out = []
    for part, of in parts.items():
        told = {}
        for order in permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                now = {i for i, (x, _, _) in enumerate(of) if f in x and i not in gone}
                redundant = sum(f in x for x, _, _ in of) - len(now)
                gone |= now
                told["".join(order), step] = (len(of) - len(gone), len(now), redundant, sum(x == {f} for x, _, _ in of), sum(of[i][1] for i in now), sum(of[i][2] for i in now))
        every = Counter()
        for (order, step), v in told.items():
            every[order[step - 1]] += v[1]
        out += [(part, order, step, *v, every[order[step - 1]]) for (order, step), v in told.items()]
    return sorted(out)


AUDITED = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit(spark: SparkSession, docs: DataFrame, rows: list[tuple]) -> None:
    rng = random.Random(4)
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in rows if rng.random() < 0.7] + [(7, 1, 0), (7, 0, 1), (999_999_999, 1, 1)]
    table = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, text string")
    labels = [x for x in labels if x[0] is not None]
    got = sorted(tuple(r[c] for c in AUDITED) for r in filter_audit.filter_audit(docs, table).collect())
    assert got == audit(rows, labels)


def test_audit_of_many_copies_and_of_empty_tables(spark: SparkSession) -> None:
    rows = [(i, "Same text $", "en", "ab"[i % 2], 0) for i in range(300)] + [(i, None, None, None, None) for i in range(300, 320)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted(tuple(r[c] for c in AUDITED) for r in filter_audit.filter_audit(spark.createDataFrame(rows, SCHEMA), labels).collect())
    assert got == audit(rows, [])
    assert filter_audit.filter_audit(spark.createDataFrame([], SCHEMA), labels).collect() == []


def test_encoder_is_the_tokenizer(rows: list[tuple]) -> None:
    rng = random.Random(1)
    alphabet = list("ab'stmdrevl  \n\t \x85\x1f.,12²é'_ßñ😀中 “!́x ")
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(3000)] + ["it's we'll I'd 're're 'llx ''s  's\n's x's", "<|endoftext|> a", "'s", "'", "' s", "l'l", "a'r", "'v", " ", "\n"] + [r[1] or "" for r in rows]
    encoder = tokens.Encoder(VOCABULARY)
    wrong = [t for t, ids in zip(texts, encoder.encode(texts), strict=True) if ids.tolist() != encoder.tokenizer.encode(t, add_special_tokens=False).ids]
    assert not wrong


def check_packed(rows: list[tuple], got: list, capacity: int) -> tuple[int, int]:
    """That each document's ids lie in exactly one piece each, and sequences have no gaps; (ids, padding)."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    sequences, want, have = defaultdict(list), Counter(), Counter()
    cached = {t: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for t in {r[1] or "" for r in rows}}
    for i, text, *_ in rows:
        want[i, cached[text or ""].tobytes()] += 1
    pieces = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], bytes(r["ids"])))
        assert r["length"] * 4 == len(r["ids"]) and r["length"] > 0
    for (i, n), own in pieces.items():
        # Rows of one id and length may be several documents: their pieces of the same start are tried in order of ids.
        by_start = defaultdict(list)
        for start, length, ids in own:
            by_start[start].append((length, ids))
        docs_here = [ids for (j, ids), c in want.items() if j == i and len(ids) == 4 * n for _ in range(c)]
        for ids in docs_here:
            at = 0
            while at < n:
                length, part = next(x for x in by_start[at] if ids[at * 4 :].startswith(x[1]))
                by_start[at].remove((length, part))
                at += length
            have[i, ids] += 1
        assert not any(by_start.values())
    assert have == want
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return sum(len(x) // 4 * c for (_, x), c in want.items()), padding


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(docs: DataFrame, rows: list[tuple], capacity: int) -> None:
    ids, padding = check_packed(rows, packing.pack(docs, VOCABULARY, capacity=capacity).collect(), capacity)
    assert padding <= 0.01 * ids


def test_packed_checksums_and_sequences(spark: SparkSession) -> None:
    rows = [(i, f"copy {'x ' * (i % 3)}", "en", "a", 0) for i in range(200)] + [(500, "long " * 5000, "en", "a", 0), (501, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    pieces = packing.pack(docs, VOCABULARY).cache()
    check_packed(rows, pieces.collect(), 2048)
    report = {(r["sequence_id"], r["offset"]): r["ids_crc32"] for r in pieces.selectExpr("*", "crc32(ids) AS ids_crc32").collect()}
    assert all(report[r["sequence_id"], r["offset"]] == crc32(bytes(r["ids"])) for r in pieces.collect())
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    for r in pieces.collect():
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert whole[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]] == ids
        assert r["offset"] in whole[r["sequence_id"]]["doc_starts"]


def test_packing_of_one_length_and_of_empty_tables(spark: SparkSession) -> None:
    rows = [(i, "word " * 999 + "end", "en", "a", 0) for i in range(50)]
    ids, padding = check_packed(rows, packing.pack(spark.createDataFrame(rows, SCHEMA), VOCABULARY, capacity=1500).collect(), 1500)
    assert not padding
    assert packing.pack(spark.createDataFrame([], SCHEMA), VOCABULARY).collect() == []


def test_fullest_window_is_the_best_subset() -> None:
    rng = random.Random(5)
    for _ in range(60):
        counts = dict(Counter(rng.choices(range(1, 40), k=8)))
        used = packing.fullest(counts, 50)
        longest = max(counts)
        sums = {longest}
        left = Counter(counts)
        left[longest] -= 1
        for length in left.elements():
            sums |= {s + length for s in sums if s + length <= 50}
        assert sum(k * n for k, n in used.items()) == max(sums)
        assert used[longest] >= 1 and all(n <= counts[k] for k, n in used.items())


def test_plan_takes_each_rest_once() -> None:
    counts = dict(Counter(random.Random(6).choices(range(1, 64), k=5000)))
    taken = defaultdict(list)
    for rest, lo, hi, *_ in packing.fill_plan(counts, 64):
        taken[rest].append((lo, hi))
    for rest, spans in taken.items():
        assert spans[0][0] == 0 and spans[-1][1] == counts[rest] and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert taken.keys() == counts.keys()
