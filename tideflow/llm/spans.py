"""Spans of regular expression matches as DataFrame expressions: code points from 0, end exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,match:string>>"


def matches(text: Column, regex: str, kind: str, gate: Column | None = None, in_text: Column | None = None) -> Column:
    """All leftmost non-overlapping matches. gate: where it is not true, there are none, and regex isn't run.

    in_text: the text that regex is run on, of the same code points as text but for those that it masks.
    """
    on = text if in_text is None else in_text
    pairs = F.arrays_zip(F.split(on, regex, -1).alias("gap"), F.regexp_extract_all(on, F.lit(regex), F.lit(0)).alias("hit"))
    none = F.from_json(F.lit("[]"), SPAN)
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.char_length(x["gap"])
        end = first + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        own = F.array(F.struct(F.lit(kind).alias("kind"), first.alias("start"), end.alias("end"), F.substring(text, first + 1, end - first).alias("match")))
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], own)).alias("spans"))

    found = F.aggregate(pairs, start, step)["spans"]
    return F.when(F.coalesce(gate if gate is not None else F.lit(True), F.lit(False)), F.coalesce(found, none)).otherwise(none)


def told(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("s"), rank[s["kind"]].alias("r"), s["end"].alias("e"), s["kind"].alias("k")))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(keyed)), lambda s: F.concat_ws(":", s["k"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def keep(spans: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(spans, test)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")
