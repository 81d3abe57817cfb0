"""Licence scans: a positional index of licence templates, entered by each template's rarest words.

Templates are short licence notices as word lists. The documents are read once to count how many hold each template word
(the words' IDF over all documents). A template is looked up by its places of highest IDF, one more of them than an
alignment may miss, so that each alignment with enough words has a hit; a hit names the start (document position -
template position) at which the template is aligned. The alignment counts only if enough template words stand at their
places and every mandatory key phrase of the template stands inside it. Base phrases are the same search with phrases as templates: from each place of the
phrase's rarest word, the other words must stand at their relative positions.

Null and empty texts have no words and no labels. Texts are read whole; rows are independent, so equal rows get equal
results. Templates are a fixed list, so nothing that is broadcast grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.llm import textarrays as ta

#: Phrases whose places are counted, by label.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: (label, notice, mandatory key phrases).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "provided that the following conditions"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work", ["waived all copyright"]),
    ("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited", ["all rights reserved", "strictly prohibited"]),
]

#: Part of a template's words that must stand at their places.
MATCHED = 0.75


def _hash_words(words: list[str]) -> np.ndarray:
    chunk = next(ta.chunks(pa.array([" ".join(words)]), ta.ALNUM, lower=True))
    return chunk.hashes


class Index:
    """The templates' words as hashes, their IDF, postings by word, and the key phrases."""

    def __init__(self, templates: list[tuple[str, str, list[str]]], base: dict[str, str]) -> None:
        self.labels = [t[0] for t in templates]
        self.words = [_hash_words(t[1].split()) for t in templates]
        self.keys = [[_hash_words(k.split()) for k in t[2]] for t in templates]
        self.base = {k: _hash_words(v.split()) for k, v in base.items()}
        self.vocabulary = np.unique(np.concatenate([*self.words, *self.base.values(), *(k for ks in self.keys for k in ks)]))
        self.idf = np.zeros(len(self.vocabulary))
        self.ids = [np.array([self.at(w) for w in words]) for words in self.words]
        self.key_ids = [[[self.at(w) for w in k] for k in keys] for keys in self.keys]
        #: Words that an alignment needs, and the template's places that are looked up.
        self.needed = [math.ceil(MATCHED * len(words)) for words in self.words]
        self.lookups: list[np.ndarray] = []

    def at(self, word: np.uint64) -> int:
        return int(np.searchsorted(self.vocabulary, word))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's index in the vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def weigh(self, found: dict[int, int], documents: int) -> None:
        self.idf = np.array([math.log((documents + 1) / (found.get(i, 0) + 1)) for i in range(len(self.vocabulary))])
        # All but the places that an alignment may miss, and one: an alignment has a hit among them.
        self.lookups = [np.argsort(-self.idf[ids], kind="stable")[: len(ids) - n + 1] for ids, n in zip(self.ids, self.needed)]
        # A template is entered by its rarest words; a document without any of those can't hold it.
        self.entries = np.unique([max((self.at(w) for w in words), key=lambda i: (self.idf[i], -i)) for k in self.keys for words in k] + [self.rarest(p) for p in self.base.values()])

    def rarest(self, phrase: np.ndarray) -> int:
        return max((self.at(w) for w in phrase), key=lambda i: (self.idf[i], -i))


def phrase_starts(ids: np.ndarray, phrase: list[int], idf: np.ndarray) -> np.ndarray:
    """Where vocabulary ids stand consecutively, from the places of the rarest and then the others in order of IDF."""
    order = sorted(range(len(phrase)), key=lambda k: -idf[phrase[k]])
    at = np.flatnonzero(ids == phrase[order[0]]) - order[0]
    at = at[(at >= 0) & (at + len(phrase) <= len(ids))]
    for k in order[1:]:
        at = at[ids[at + k] == phrase[k]]
    return at


def scan_one(ids: np.ndarray, index: Index) -> dict[str, float]:
    """Labels with the matched part of the best alignment, for one document's vocabulary ids (-1: other words)."""
    own = set(np.unique(ids).tolist())
    best: dict[str, float] = {}
    for label, words, keys, lookups, needed in zip(index.labels, index.ids, index.key_ids, index.lookups, index.needed):
        if not own.issuperset(w for k in keys for w in k):
            continue
        starts = np.unique(np.concatenate([np.flatnonzero(ids == words[i]) - i for i in lookups]))
        matched = np.zeros(len(starts), np.int64)
        for i, w in enumerate(words):
            at = starts + i
            matched += (ids[np.clip(at, 0, len(ids) - 1)] == w) & (at >= 0) & (at < len(ids))
        good = matched >= needed
        # From the best alignment on, the first with all key phrases inside decides.
        for k in np.argsort(-matched[good], kind="stable").tolist():
            start, part = int(starts[good][k]), int(matched[good][k]) / len(words)
            if part <= best.get(label, 0):
                break
            inside = ids[max(0, start) : start + len(words)]
            if all(len(phrase_starts(inside, phrase, index.idf)) for phrase in keys):
                best[label] = part
                break
    return best


def license_scan(docs: DataFrame, templates: list[tuple[str, str, list[str]]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, for each row of docs.

    docs has doc_id and text; other columns are ignored.
    """
    index = Index(templates, base)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(index.vocabulary), np.int64), 0
        for b in batches:
            for c in ta.chunks(b.column(0), ta.ALNUM, lower=True):
                ids = index.find(c.hashes)
                hit = ids >= 0
                total += np.bincount(np.unique(c.doc[hit] * len(total) + ids[hit]) % len(total), minlength=len(total))
                n += c.n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int32()), pa.array(np.concatenate([[n], total]))], ["i", "df"])

    found = {r["i"]: r["df"] for r in docs.select("text").mapInArrow(frequencies, "i int, df long").groupBy("i").agg(F.sum("df").alias("df")).collect()}  # a row a vocabulary word
    index.weigh(found, found.get(-1, 0))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        phrases = {k: [index.at(w) for w in v] for k, v in index.base.items()}
        for b in batches:
            for c in ta.chunks(b.column(1), ta.ALNUM, lower=True):
                ids = index.find(c.hashes)
                n_base, first, last = np.zeros(c.n, np.int64), [None] * c.n, [None] * c.n
                base_labels, labels, score = [""] * c.n, [""] * c.n, np.zeros(c.n)
                for d in np.unique(c.doc[np.isin(ids, index.entries)]).tolist():
                    own = ids[c.word_at[d] : c.word_at[d + 1]]
                    starts = {k: phrase_starts(own, p, index.idf) for k, p in phrases.items()}
                    every = np.concatenate(list(starts.values()))
                    told = {k for k, s in starts.items() if len(s)}
                    more = scan_one(own, index)
                    n_base[d] = len(every)
                    if len(every):
                        first[d], last[d] = int(every.min()), int(every.max())
                    base_labels[d], labels[d] = ",".join(sorted(told)), ",".join(sorted(told | set(more)))
                    score[d] = 1.0 if told else max(more.values(), default=0.0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[c.lo : c.hi], pa.array(c.counts.astype(np.int64)), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels), pa.array(labels), pa.array(score)],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
