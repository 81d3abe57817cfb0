"""Scalar functions as column expressions: numbers, times, texts, arrays, JSON and bands.

Null in gives null out where nothing else is said. Formats round half up on the double itself, without a detour over
decimal strings, so they agree between engines.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bands of link confidence and of holder concentration.
LINK_BANDS = ((30, "weak"), (60, "possible"), (80, "probable"))
CONCENTRATION_HIGH, CONCENTRATION_MEDIUM = 0.66, 0.33
# The two lanes' starts and factors of the content hash.
HASH_STARTS, HASH_FACTORS, HASH_MIXERS = (0xDEADBEEF, 0x41C6CE57), (2654435761, 1597334677), (2246822507, 3266489909)


# ---- numbers


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def round_int(x: Column) -> Column:
    """To the nearest whole number, halves upwards."""
    return F.floor(x + 0.5)


def round1(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def safe_ratio(n: Column, d: Column, default: Any = None) -> Column:
    """n / d where d is positive, else the default."""
    return F.when(d > 0, n / d).otherwise(F.lit(default))


def min_max_ratio(a: Column, b: Column) -> Column:
    """The lesser by the greater, 0 where that isn't positive."""
    return F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def finite_positive(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (x > 0) & (x < float("inf")), F.lit(False))


def node_size(flow: Column, most: Column) -> Column:
    return F.when(most <= 0, 16.0).otherwise(clamp(16 + F.sqrt(F.greatest(flow, F.lit(0.0)) / most) * 44, 16.0, 60.0))


def edge_width(usd: Column) -> Column:
    return F.when(usd <= 0, 1.0).otherwise(clamp(F.log10(usd), 1.0, 8.0))


# ---- times


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def days_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / 86_400_000_000.0


def minutes_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / 60_000_000.0


def hour_bucket(ts: Column) -> Column:
    """Year, month, day and hour without leading zeros."""
    return F.date_format(ts, "y-M-d-H")


def iso_minute(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def age(seconds: Column) -> Column:
    """The two largest units: 2d 4h, 3h 12m, 5m 10s, 9s, just now."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    part = lambda size, within: F.floor(s % within / size).cast("long").cast("string")
    d, h, m = F.floor(s / 86400).cast("long").cast("string"), part(3600, 86400), part(60, 3600)
    return (
        F.when(s < 1, "just now")
        .when(s >= 86400, F.concat(d, F.lit("d "), h, F.lit("h")))
        .when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m")))
        .when(s >= 60, F.concat(m, F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )


def horizon_elapsed(fired: Column, minutes: int, now: Column) -> Column:
    return micros(now) >= micros(fired) + minutes * 60_000_000


# ---- texts


def fixed(x: Column, digits: int) -> Column:
    """A number that isn't negative with so many decimals."""
    t = F.floor(x * 10**digits + 0.5).cast("long")
    return F.concat(F.floor(t / 10**digits).cast("long").cast("string"), F.lit("."), F.lpad((t % 10**digits).cast("string"), digits, "0"))


def fmt_usd(x: Column) -> Column:
    a = F.abs(x)
    sign = F.when(x < 0, "-").otherwise("")
    body = F.when(a >= 1e9, F.concat(fixed(a / 1e9, 1), F.lit("B"))).when(a >= 1e6, F.concat(fixed(a / 1e6, 1), F.lit("M"))).when(a >= 1e3, F.concat(fixed(a / 1e3, 1), F.lit("k"))).when(a >= 1, fixed(a, 2)).when(a >= 0.00005, fixed(a, 4)).otherwise(fixed(a, 6))
    return F.when(a.isNull() | F.isnan(a) | (a == float("inf")) | (a == 0), "$0.00").otherwise(F.concat(sign, F.lit("$"), body))


def fmt_pct(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), "+0.0%").otherwise(F.concat(F.when(x < 0, "-").otherwise("+"), fixed(F.abs(x), 1), F.lit("%")))


def short_id(x: Column) -> Column:
    return F.when(F.length(x) <= 10, x).otherwise(F.concat(F.left(x, F.lit(4)), F.lit("…"), F.right(x, F.lit(4))))


def escape_html(x: Column) -> Column:
    return reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), x)


def fill_template(template: Column, address: Column) -> Column:
    return F.replace(template, F.lit("{address}"), address)


def csv_escape(x: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line end."""
    return F.when(x.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def split_tags(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\|"), lambda t: F.trim(t)), lambda t: t != "")


def note_append(notes: Column, line: Column) -> Column:
    """The lines of notes and, unless it is among them, the line."""
    lines = F.filter(F.split(F.coalesce(notes, F.lit("")), "\n"), lambda t: t != "")
    return F.when(line.isNull() | F.array_contains(lines, line), notes).otherwise(F.array_join(F.concat(lines, F.array(line)), "\n"))


def has_note(notes: Column, mark: str) -> Column:
    return F.array_contains(F.transform(F.split(F.coalesce(notes, F.lit("")), ","), lambda t: F.trim(t)), mark)


def alnum_length(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^a-z0-9]", ""))


def address_valid(x: Column, chain: Column) -> Column:
    return F.when(chain == "SOLANA", x.rlike("^[1-9A-HJ-NP-Za-km-z]{32,44}$")).otherwise(x.rlike("^0x[0-9a-f]{40}$"))


def decimal_shift(raw: Column, decimals: Column) -> Column:
    """A whole number of any length by 10**decimals, exactly: trailing zeros go; 0 if raw is no whole number."""
    sign = F.when(raw.startswith("-"), "-").otherwise("")
    figures = F.regexp_replace(F.ltrim(raw, F.lit("-")), "^0+(?=[0-9])", "")
    padded = F.lpad(figures, F.greatest(F.length(figures), decimals + 1), F.lit("0"))
    whole = F.substring(padded, F.lit(1), F.length(padded) - decimals)
    rest = F.rtrim(F.substring(padded, F.length(padded) - decimals + 1, decimals), F.lit("0"))
    out = F.when(decimals <= 0, figures).when(rest == "", whole).otherwise(F.concat_ws(".", whole, rest))
    return F.when(~raw.rlike("^-?[0-9]+$"), "0").when(out == "0", out).otherwise(F.concat(sign, out))


def content_hash(x: Column) -> Column:
    """A 53-bit hash of ASCII text in base 36: two lanes of 32-bit products, folded together."""

    def times(a: Column, b: int | Column) -> Column:
        low = F.lit(0xFFFF).cast("long")
        return (F.shiftleft(F.shiftright(a, 16) * b % F.lit(65536), 16) + a.bitwiseAND(low) * b) % F.lit(1 << 32)

    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))

    def lane(k: int) -> Column:
        return F.aggregate(codes, F.lit(HASH_STARTS[k]).cast("long"), lambda h, c: times(h.bitwiseXOR(c), HASH_FACTORS[k]))

    lanes = F.transform(F.array(F.struct(lane(0).alias("a"), lane(1).alias("b"))), lambda s: F.struct(times(s["a"].bitwiseXOR(F.shiftright(s["a"], 16)), HASH_MIXERS[0]).bitwiseXOR(times(s["b"].bitwiseXOR(F.shiftright(s["b"], 13)), HASH_MIXERS[1])).alias("a"), s["b"].alias("b")))
    both = F.transform(lanes, lambda s: F.struct(s["a"].alias("a"), times(s["b"].bitwiseXOR(F.shiftright(s["b"], 16)), HASH_MIXERS[0]).bitwiseXOR(times(s["a"].bitwiseXOR(F.shiftright(s["a"], 13)), HASH_MIXERS[1])).alias("b")))
    return F.transform(both, lambda s: F.lower(F.conv((F.lit(1 << 32) * s["b"].bitwiseAND(F.lit(2097151).cast("long")) + s["a"]).cast("string"), 10, 36)))[0]


# ---- arrays and JSON


def first_distinct(x: Column, n: int) -> Column:
    return F.slice(F.array_distinct(x), 1, n)


def sort_join(x: Column, sep: str = "|") -> Column:
    return F.array_join(F.array_sort(x), sep)


def json_number(json: Column, path: str, default: float) -> Column:
    """The number at a path; the default where there's none or another type."""
    return F.when(json_kind(json, path) == "number", F.get_json_object(json, path).try_cast("double")).otherwise(F.lit(default))


def json_kind(json: Column, path: str) -> Column:
    """number, string, boolean, other, or null where there's nothing."""
    of = F.schema_of_variant(F.variant_get(F.try_parse_json(json), path, "variant"))
    return F.when(of.rlike("^(BIGINT|DOUBLE|DECIMAL)"), "number").when(of == "STRING", "string").when(of == "BOOLEAN", "boolean").when(of.isNull() | (of == "VOID"), None).otherwise("other")


# ---- bands


def link_band(x: Column) -> Column:
    out = F.lit("strong")
    for limit, name in reversed(LINK_BANDS):
        out = F.when(x <= limit, name).otherwise(out)
    return out


def entity_bucket(x: Column) -> Column:
    return F.when(x.isNull() | (x < 1), None).when(x <= 4, "1-4").when(x <= 14, "5-14").otherwise("15+")


def concentration_band(x: Column) -> Column:
    return F.when(x.isNull(), "unknown").when(x >= CONCENTRATION_HIGH, "high").when(x >= CONCENTRATION_MEDIUM, "medium").otherwise("low")


def merged_leaves(base: Column, over: Column) -> Column:
    """Two maps of leaves by path: over's stand for base's; a null map is an empty one."""
    none = F.from_json(F.lit("{}"), "map<string,string>")
    base, over = F.coalesce(base, none), F.coalesce(over, none)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)
