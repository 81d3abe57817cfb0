"""Secret scans: known formats, and a battery of randomness tests with false-discovery control by length.

Base spans come from three patterns. Further spans are random strings: each long token of key characters is taken in the
encoding its alphabet shows (hexadecimal, base32, upper or lower alphanumeric, base64), and four tests compare it with
uniform random characters of that alphabet: chi-squared on the counts of characters and of vowels, other letters and the
rest, runs about the alphabet's middle, and serial correlation of neighbours. The least of the four p-values, times four,
says how well randomness fits.

The null is what isn't random: names made of words, numbers and separators, as paths and identifiers are. REFERENCE such
names are put together for each encoding and length class and go through the same battery, so a token's p-value against
the null is the part of its class's names that look at least as random. It doesn't depend on the corpus, so a key in a
corpus of one document is judged as one among many. Each length class then accepts by Benjamini and Hochberg's rule, at
rate FDR over the class's tokens with digits and letters.

DataFrame functions only. Counts are kept in bins by encoding and class, a table of bounded size. Null and empty texts
have no spans; texts are searched whole; rows are independent but for the thresholds, so repeated rows have equal results,
and an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.llm import spans as S

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
LEAST_LENGTH = 20
#: Upper lengths of the classes.
CLASSES = (23, 31, 47, 1 << 30)
#: Least and largest length of the null's names by class.
LENGTHS = ((20, 23), (24, 31), (32, 47), (48, 79))
BINS = 64
FDR = 0.1
#: Names of the null by encoding and class.
REFERENCE = 2048
#: Encodings: a pattern of the whole token, and the alphabet. The last one takes every token.
ENCODINGS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Words of the null's names; those that hexadecimal digits spell.
WORDS = (
    "user name file path data test value index list table config server client request response handler manager service "
    "module package version build release debug error message string number default internal public static final class "
    "object array buffer stream input output reader writer parser token query result update delete insert select account "
    "project report document image picture camera summer winter haus strasse wetter sprache casa tiempo libro maison temps"
).split()
HEX_WORDS = "face dead beef cafe bad add bed fade decade facade ace bee dad fed deaf dec feb abc".split()
#: The part of truly random tokens that may be turned away.
REJECT = 0.001


def base_spans(text: Column) -> Column:
    value = r"[A-Za-z0-9+/_.=-]+"
    head = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
    assigned = S.matches(text, head + value, "assign", F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")))
    return F.concat(
        S.keep(assigned, lambda s: F.length(F.regexp_extract(s["match"], f"^{head}({value})$", 1)) >= 6),
        S.keep(S.matches(text, r"AKIA[A-Z0-9]+", "access", F.contains(text, F.lit("AKIA"))), lambda s: s["end"] - s["start"] >= 20),
        S.matches(text, r"[0-9a-f]{24,}", "hex", text.rlike(r"[0-9a-f]{24}")),
    )


def candidates(text: Column) -> Column:
    regex = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+={0,2}" % LEAST_LENGTH
    return S.matches(text, regex, "random", text.rlike(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d}" % LEAST_LENGTH))


def _tails(z: Column) -> Column:
    """P(a standard normal value > z) for each of an array, by a classic polynomial (absolute error below 1e-7)."""
    at = F.transform(z, lambda v: F.struct(v.alias("z"), (1 / (1 + 0.2316419 * F.abs(v))).alias("t")))

    def tail(y: Column) -> Column:
        t = y["t"]
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.struct((poly * F.exp(-y["z"] * y["z"] / 2) / 2.5066282746310002).alias("upper"), y["z"].alias("z"))

    return F.transform(F.transform(at, tail), lambda y: F.when(y["z"] >= 0, y["upper"]).otherwise(1 - y["upper"]))


def _core(token: Column) -> Column:
    return F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")


def _encoding(core: Column) -> Column:
    out = F.lit(len(ENCODINGS) - 1)
    for i in reversed(range(len(ENCODINGS) - 1)):
        out = F.when(core.rlike(ENCODINGS[i][0]), i).otherwise(out)
    return out


def encoding(token: Column) -> Column:
    """The first of ENCODINGS that holds all of a token's characters."""
    return _encoding(_core(token))


def randomness(token: Column) -> Column:
    """How well random characters of the token's own alphabet fit it: a p-value, 1 at most."""
    # Each step over an array of one, so that what a lambda uses is there as a value.
    one = F.transform(F.array(_core(token)), lambda core: F.struct(core.alias("core"), F.array(*[F.lit(a) for _, a in ENCODINGS])[_encoding(core)].alias("alphabet")))
    one = F.transform(one, lambda x: F.struct(x["core"].alias("core"), x["alphabet"].alias("alphabet"), F.transform(F.split(x["core"], ""), lambda c: F.instr(x["alphabet"], c) - 1).alias("codes")))

    def tests(x: Column) -> Column:
        core, values = x["core"], x["codes"]
        size, n = F.length(x["alphabet"]).cast("double"), F.length(core).cast("double")

        def times(c: Column) -> Column:
            return n - F.length(F.replace(core, c, F.lit("")))

        squares = F.aggregate(F.array_distinct(F.split(core, "")), F.lit(0.0), lambda a, c: a + times(c) * times(c))
        def share(s: Column, group: str) -> Column:
            return (F.length(s) - F.length(F.translate(s, group, ""))) / F.length(s)

        # The same over vowels, other letters and the rest, which tells words from keys where single characters are few.
        groups = ("aeiouAEIOU", "bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ", "0123456789+/")
        off = sum((F.pow(share(core, g) - share(x["alphabet"], g), F.lit(2.0)) / share(x["alphabet"], g) for g in groups), F.lit(0.0))
        grouped = F.exp(-n * off / 2)
        # Sums in one pass over neighbours; a first pass over the values alone.
        sums = F.aggregate(
            values,
            F.struct(F.lit(-1.0).alias("was"), F.lit(0.0).alias("total"), F.lit(0.0).alias("powers"), F.lit(0.0).alias("products"), F.lit(0.0).alias("ones"), F.lit(0.0).alias("runs")),
            lambda a, v: F.struct(
                v.cast("double").alias("was"),
                (a["total"] + v).alias("total"),
                (a["powers"] + v * v).alias("powers"),
                (a["products"] + F.greatest(a["was"], F.lit(0.0)) * v).alias("products"),
                (a["ones"] + (v * 2 >= size).cast("int")).alias("ones"),
                (a["runs"] + ((a["was"] < 0) | ((v * 2 >= size) != (a["was"] * 2 >= size))).cast("int")).alias("runs"),
            ),
        )
        return F.transform(F.array(F.struct(sums.alias("s"), squares.alias("squares"), size.alias("size"), grouped.alias("grouped"), n.alias("n"), values[0].alias("first"), F.element_at(values, -1).alias("last"))), combined)[0]

    def combined(x: Column) -> Column:
        s, n, size, df = x["s"], x["n"], x["size"], x["size"] - 1
        chi = F.greatest(x["squares"] * size / n - n, F.lit(1e-9))
        uniform = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        mean = 1 + 2 * s["ones"] * (n - s["ones"]) / n
        run = F.abs(s["runs"] - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.25)))
        middle = s["total"] / n
        over = s["powers"] - s["total"] * middle
        along = s["products"] - middle * (2 * s["total"] - x["first"] - x["last"]) + (n - 1) * middle * middle
        serial = F.abs(along / F.greatest(over, F.lit(1e-9))) * F.sqrt(n)
        return F.least(F.lit(1.0), F.transform(F.array(F.struct(_tails(F.array(uniform, run, serial)).alias("p"), x["grouped"].alias("grouped"))), lambda y: 4 * F.least(y["grouped"], y["p"][0], 2 * y["p"][1], 2 * y["p"][2]))[0])

    return F.transform(one, tests)[0]


def _class(length: Column) -> Column:
    out = F.lit(len(CLASSES) - 1)
    for i in reversed(range(len(CLASSES) - 1)):
        out = F.when(length <= CLASSES[i], i).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    """Bins of -log10 p, from the best fit (0) to the worst."""
    return F.least(F.floor(-8 * F.log10(F.greatest(p, F.lit(1e-12)))), F.lit(BINS - 1)).cast("int")


def _telling(match: Column) -> Column:
    return match.rlike("[0-9]") & match.rlike("[A-Za-z]")


def reference(spark: SparkSession) -> DataFrame:
    """token: REFERENCE names for each encoding and length class, of words, numbers and separators."""
    ids = spark.range(len(ENCODINGS) * len(CLASSES) * REFERENCE)
    form, of = (F.col("id") % len(ENCODINGS)).cast("int"), (F.floor(F.col("id") / len(ENCODINGS)) % len(CLASSES)).cast("int")

    def drawn(below: int | Column, *key: Column | int) -> Column:
        return F.pmod(F.xxhash64("id", *[k if isinstance(k, Column) else F.lit(k) for k in key]), F.lit(below) if isinstance(below, int) else below).cast("int")

    least, width = F.array(*[F.lit(a) for a, _ in LENGTHS])[of], F.array(*[F.lit(b - a + 1) for a, b in LENGTHS])[of]

    def part(k: Column) -> Column:
        word = F.when(form < 2, F.array(*[F.lit(w) for w in HEX_WORDS])[drawn(len(HEX_WORDS), k, 0)]).otherwise(F.array(*[F.lit(w) for w in WORDS])[drawn(len(WORDS), k, 0)])
        word = F.when((form == 5) & (drawn(2, 1) == 0), F.initcap(word)).otherwise(word)
        number = F.when(drawn(3, k, 2) == 0, F.when(drawn(2, k, 3) == 0, (1990 + drawn(40, k, 4)).cast("string")).otherwise(drawn(100, k, 5).cast("string"))).otherwise("")
        between = F.when(form == 5, F.array(F.lit(""), F.lit("-"), F.lit("_"), F.lit("/"))[drawn(4, 6)]).otherwise("")
        return F.concat(word, number, between)

    name = F.substring(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), part), ""), F.lit(1), least + drawn(width, 7))
    upper = F.when(form == 2, F.translate(F.upper(name), "0189", "2345")).when(form.isin(1, 3), F.upper(name)).otherwise(name)
    return ids.select(upper.alias("token"))


def accepted_bins(null: dict[tuple[int, int], list[int]], tokens: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int], int]:
    """By encoding and length class, the worst bin that is accepted, from counts by (encoding, class) in each bin.

    A token's p-value is the part of the null's names of its encoding and class that look at least as random; all of a bin
    share its worst. Each length class applies Benjamini and Hochberg's rule over all its encodings.
    """
    p = {k: [(1 + sum(null.get(k, [0] * BINS)[: b + 1])) / (1 + sum(null.get(k, []))) for b in range(BINS)] for k in tokens}
    out = {}
    for c in range(len(CLASSES)):
        cells = sorted((p[k][b], n) for k, ns in tokens.items() if k[1] == c for b, n in enumerate(ns) if n)
        total, taken, limit = sum(n for _, n in cells), 0, -1.0
        for i, (value, n) in enumerate(cells):
            taken += n
            if (i + 1 == len(cells) or cells[i + 1][0] > value) and value <= FDR * taken / total:
                limit = value
        for k in tokens:
            if k[1] == c:
                fit = [b for b in range(BINS) if p[k][b] <= limit and b <= -8 * math.log10(REJECT)]
                if fit:
                    out[k] = max(fit)
    return out


def cutoffs(docs: DataFrame) -> dict[tuple[int, int], int]:
    """By encoding and length class, the worst bin that is accepted among the tokens of docs."""
    found = docs.select(F.explode(candidates(F.coalesce("text", F.lit("")))).alias("s")).select(F.col("s.match").alias("token")).where(_telling(F.col("token")))
    rows = found.withColumn("null", F.lit(False)).unionByName(reference(docs.sparkSession).withColumn("null", F.lit(True)))
    token = F.col("token")
    rows = rows.groupBy("null", encoding(token).alias("encoding"), _class(F.length(token)).alias("class"), _bin(randomness(token)).alias("bin")).count()
    counts: dict[bool, dict[tuple[int, int], list[int]]] = {False: {}, True: {}}
    for r in rows.collect():  # 2 * encodings * classes * bins rows at most
        counts[r["null"]].setdefault((r["encoding"], r["class"]), [0] * BINS)[r["bin"]] = r["count"]
    return accepted_bins(counts[True], counts[False])


def all_spans(docs: DataFrame) -> DataFrame:
    """docs with base and every (arrays of spans), and text not null."""
    limits = cutoffs(docs)
    worst = F.array(*[F.lit(limits.get((e, c), -1)) for e in range(len(ENCODINGS)) for c in range(len(CLASSES))])

    def accepted(s: Column) -> Column:
        own = worst[encoding(s["match"]) * len(CLASSES) + _class(F.length(s["match"]))]
        return (own >= 0) & _telling(s["match"]) & (_bin(randomness(s["match"])) <= own)

    out = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("base", base_spans(F.col("text")))
    # What a base span covers isn't told again.
    more = F.filter(candidates(F.col("text")), lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) & accepted(s))
    return out.withColumn("every", F.concat("base", more))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, for each row of docs.

    docs has doc_id and text; other columns are ignored.
    """
    out = all_spans(docs.select("doc_id", "text"))
    return out.select("doc_id", *[S.count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE], F.sha2(S.told(F.col("base"), KINDS), 256).alias("base_sha256"), S.told(F.col("every"), KINDS).alias("spans"))


def redact(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) with each run of overlapping spans replaced by mark; n_chars follows."""
    def last(spans: Column) -> Column:
        return F.try_element_at(spans, F.lit(-1))

    merged = F.aggregate(
        F.array_sort(F.transform("every", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b")))),
        F.from_json(F.lit("[]"), "array<struct<a:int,b:int>>"),
        lambda acc, s: F.when(F.coalesce(last(acc)["b"] >= s["a"], F.lit(False)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], s["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(s))),
    )
    parts = F.aggregate(
        F.col("merged"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(s["b"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["a"] - acc["at"]), F.lit(mark)).alias("out")),
    )
    whole = docs.select("doc_id", F.col("text").alias("before"), "lang", "source", "n_chars")
    out = all_spans(whole.withColumn("text", F.col("before"))).withColumn("merged", merged).withColumn("parts", parts)
    text = F.when(F.size("every") > 0, F.concat(F.col("parts.out"), F.substring(F.col("text"), F.col("parts.at") + 1, F.lit(1 << 30)))).otherwise(F.col("before"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.size("every") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
