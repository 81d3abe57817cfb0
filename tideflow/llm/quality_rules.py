"""Quality rules with adaptive thresholds: KLL sketches by language and source instead of fixed cutoffs.

Statistics of each text: words, characters in words, symbols, repeated lines, words in repeated three-word windows. Their
fences come from mergeable KLL sketches for each language and source, which tasks build and a shuffle of sketches merges;
no fixed cutoff takes part. Most documents have rates of nothing, so that quartiles tell nothing of them: a rate's fence
lies FENCE times the distance of median and 0.9 quantile beyond the latter. Where these are 0, all they tell is that a
document of the group's median length has fewer than one, so that one a median length is the least fence: a rate, which
a long text with few symbols stays below. A document is beyond a fence only if its count is by more than ERRORS standard
errors of a count (one repeated line is no outlier where nobody repeats any). The mean word length has a fence on each
side, FENCE interquartile ranges beyond the quartile. All fences are shrunk to their language's (the same sketches
merged), which weighs as much as PRIOR documents. The statistics are joined with the fences and filtered.

DataFrame functions only; the words of a text are compared inside its row, so no word leaves its task. Windows are
compared by 64-bit hashes inside one text. Null texts have no words; null languages and sources are groups of their own.
Rows are independent but for the fences, so repeated rows have equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.llm.common import checkpointed, small_or_shuffled

SPACE = "[\\x20\\x09-\\x0D]+"
#: Rates, the count of each, and its weight.
RATES = {"symbol_rate": ("n_symbols", 1.0), "dup_line_rate": ("n_dup_lines", 10.0), "repeat_rate": ("n_repeat_words", 1.0)}
FENCE = 6.0
#: Standard errors of a count by which it must be beyond the fence.
ERRORS = 3.0
#: Documents as which a language's fence weighs in that of a language and source.
PRIOR = 10
SKETCH_K = 400


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.select("doc_id", "lang", "source", text.alias("text"))
    out = out.select(
        "doc_id",
        "lang",
        "source",
        F.char_length(F.translate("text", " \t\n\u000b\f\r", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        F.filter(F.split(F.col("text"), SPACE, -1), lambda w: w != "").alias("words"),
    )
    # One pass over the words: the hash of each word and the next two.
    n = F.size("words")
    hashes = F.transform(F.col("words"), lambda w: F.xxhash64(w))
    out = out.withColumn("n_words", n.cast("long")).withColumn("hashes", hashes)
    triple = F.zip_with(F.zip_with(F.slice("hashes", 1, F.greatest(n - 2, F.lit(0))), F.slice("hashes", 2, F.greatest(n - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b)), F.slice("hashes", 3, F.greatest(n - 2, F.lit(0))), lambda a, c: F.xxhash64(a, c))
    out = out.withColumn("windows", F.when(n >= 3, triple))
    return out.drop("words", "hashes")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, for each row of docs."""
    out = _measured(docs)
    repeated = F.col("windows").isNotNull() & (F.size(F.array_distinct("windows")) < F.size("windows"))

    keyed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Neighbours by zipping the sorted array with itself moved by one place.
    pairs = F.filter(F.zip_with(F.slice("keyed", 1, F.size("keyed") - 1), F.slice("keyed", 2, F.size("keyed") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
    places = F.array_sort(F.array_distinct(F.flatten("pairs")))
    count = F.aggregate("places", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")))["n"]
    out = out.withColumn("keyed", F.when(repeated, keyed)).withColumn("pairs", pairs).withColumn("places", places)
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(F.when(F.col("places").isNotNull(), count), F.lit(0)).cast("long").alias("n_repeat_words"))


def with_rates(stats: DataFrame) -> DataFrame:
    n = F.greatest("n_words", F.lit(1))
    return stats.withColumns({x: weight * F.col(count) / n for x, (count, weight) in RATES.items()} | {"word_length": F.col("word_chars") / n})


def fences(stats: DataFrame) -> DataFrame:
    """lang, source, and the fences max_<rate>, min_word_length, max_word_length: one row a language and source."""
    names = [*RATES, "word_length", "n_words"]
    sketched = checkpointed(stats.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(F.col(x).cast("double"), SKETCH_K).alias(x) for x in names]))

    def limits() -> list[Column]:
        def quantile(x: str, q: float) -> Column:
            return F.kll_sketch_get_quantile_double(x, F.lit(q))

        least = F.lit(1.0) / F.greatest(quantile("n_words", 0.5), F.lit(1.0))
        upper = [F.greatest(quantile(x, 0.9) + FENCE * (quantile(x, 0.9) - quantile(x, 0.5)), weight * least).alias(f"max_{x}") for x, (_, weight) in RATES.items()]
        lo, hi = quantile("word_length", 0.25), quantile("word_length", 0.75)
        return [*upper, (hi + FENCE * (hi - lo)).alias("max_word_length"), (lo - FENCE * (hi - lo)).alias("min_word_length")]

    by_lang = sketched.groupBy("lang").agg(*[F.kll_merge_agg_double(x).alias(x) for x in names])
    by_lang = small_or_shuffled(checkpointed(by_lang.select(F.col("lang").alias("of"), F.struct(*limits()).alias("wide"))))
    own = sketched.select("lang", "source", (F.col("n") / (F.col("n") + PRIOR)).alias("weight"), F.struct(*limits()).alias("own"))
    both = own.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left")
    fenced = [*[f"max_{x}" for x in (*RATES, "word_length")], "min_word_length"]
    return checkpointed(both.select("lang", "source", *[(F.col("weight") * F.col(f"own.{x}") + (1 - F.col("weight")) * F.col(f"wide.{x}")).alias(x) for x in fenced]))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, for each row of docs.

    docs has doc_id, text, lang and source; other columns are ignored.
    """
    stats = with_rates(checkpointed(measured(docs)))
    limits = small_or_shuffled(fences(stats)).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = F.lit(True)
    for x, (count, weight) in RATES.items():
        fine = fine & (F.col(count) - ERRORS * F.sqrt(count) <= F.col(f"max_{x}") * F.col("n_words") / weight)
    fine = fine & F.col("word_length").between(F.col("min_word_length"), F.col("max_word_length"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(fine, F.lit(True))).alias("kept"))
