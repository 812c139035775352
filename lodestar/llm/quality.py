"""Quality rules with adaptive thresholds, in DataFrame expressions only.

The measures of each document that passes the base rule go into log-linear histograms per language and
source. Such a histogram is a mergeable quantile sketch: merging adds counts, and a quantile is within
1/32 of the exact value. A group's fences stand off its median by a multiple of its own spread on either
side; its quantiles are drawn towards those of the merged sketch as if that were ``PRIOR`` further
documents, so a small or a bad source can't make its own rules. The fences are joined back.

Null or empty texts have no words and fail the base rule. Null languages and sources are groups of
their own. Repeated rows are judged one by one, ties can't occur, texts of any length are read whole, and
columns of other names than doc_id, text, lang and source are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import attach, materialise

#: Per rule, the percentages whose quantiles show the spread below and above the median: above, no
#: more than may be expected of clean documents. And how far a fence stands off without any spread: per
#: mille of symbols per word character, duplicate lines per line, repeated words per word; ten times
#: the mean word length.
SPREADS = {"symbol": (5, 85), "dup_line": (5, 97), "repeat": (5, 95), "word_len": (5, 95)}
GUARDS = {"symbol": 20, "dup_line": 150, "repeat": 60, "word_len": 15}
#: A fence is so many times the spread beyond the quantile.
STRETCH = 3
#: Documents that the merged sketch counts for in every group.
PRIOR = 50

SPACES = "\\x20\\x09-\\x0D"


def words_of(text: Column) -> Column:
    spaced = F.regexp_replace(text, "[\\x09-\\x0D]", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once: SQL has no let, a lambda over one element is one."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words inside windows of ``size`` words that occur twice or more in the array.

    Windows are compared by a 64-bit hash. Only arrays that have a repeat are sorted.
    """

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (size - 1))
        return F.transform(starts, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(size)]))

    def repeats(h: Column) -> Column:
        """Places whose hash equals a neighbour's after sorting, in order."""
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return bind(
            pairs,
            lambda p: F.sort_array(
                F.transform(
                    F.filter(
                        p,
                        lambda x, k: ((k > 0) & (x["h"] == F.get(p, k - 1)["h"])) | ((k < F.size(p) - 1) & (x["h"] == F.get(p, k + 1)["h"])),
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def spanned(places: Column) -> Column:
        """How many words the windows that start at ``places`` cover together."""
        steps = F.transform(places, lambda p, k: F.when(k == 0, F.lit(size)).otherwise(F.least(F.lit(size), p - F.get(places, k - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(repeats(h), spanned))

    return F.when(F.size(words) < size, F.lit(0)).otherwise(bind(hashes(words), count))


def measures(documents: DataFrame) -> DataFrame:
    """Per document: lang, source and the whole-text counts that the rules use."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    return (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("__text"))
        .select("doc_id", "lang", "source", "__text", words_of(F.col("__text")).alias("__words"), lines.alias("__lines"))
        .select(
            "doc_id",
            "lang",
            "source",
            F.size("__words").cast("long").alias("n_words"),
            F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
            (F.length("__text") - F.length(F.regexp_replace("__text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            F.size("__lines").cast("long").alias("n_lines"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("__words")).cast("long").alias("n_repeat_words"),
        )
    )


def rates() -> dict[str, Column]:
    """The integer measures that the sketches hold."""
    return {
        "symbol": F.expr("1000 * n_symbols div greatest(word_chars, 1)"),
        "dup_line": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
        "repeat": F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
        "word_len": F.expr("10 * word_chars div greatest(n_words, 1)"),
    }


def bin_of(value: Column) -> Column:
    """Log-linear bin of a whole number: exact below 64, then 32 bins an octave."""
    octave = F.length(F.bin(value)) - 6
    return F.when(value < 64, value.cast("int")).otherwise((64 + (octave - 1) * 32 + F.call_function("shiftright", value, octave) - 32).cast("int"))


def bin_top(number: Column) -> Column:
    """The largest value of a bin."""
    octave = F.floor((number - 64) / 32).cast("int") + 1
    low = F.call_function("shiftleft", (F.pmod(number - 64, F.lit(32)) + 33).cast("long"), octave)
    return F.when(number < 64, number.cast("long")).otherwise(low - 1)


def sketches(measured: DataFrame) -> DataFrame:
    """One histogram bin per row: lang, source, rule, bin, n. Adding n merges sketches."""
    found = measured.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), bin_of(v).alias("bin")) for k, v in rates().items()])).alias("x"))
    return found.groupBy("lang", "source", F.col("x.rule").alias("rule"), F.col("x.bin").alias("bin")).agg(F.count("*").alias("n"))


def per_rule(values: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(F.col("rule") == k, F.lit(v)) for k, v in values.items()])


def quantiles(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and rule: low, mid and high, the tops of the first bins that reach the rule's percentages, and total."""
    group = Window.partitionBy(*keys, "rule")
    run = bins.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    shares = {"low": per_rule({k: v[0] for k, v in SPREADS.items()}), "mid": F.lit(50), "high": per_rule({k: v[1] for k, v in SPREADS.items()})}
    reached = [bin_top(F.min(F.when(F.col("upto") * 100 >= F.col("total") * share, F.col("bin")))).alias(name) for name, share in shares.items()]
    return run.groupBy(*keys, "rule").agg(*reached, F.first("total").alias("total"))


def fences(bins: DataFrame) -> DataFrame:
    """Per lang and source the columns <rule>_low and <rule>_high."""
    names = ("low", "mid", "high")
    merged = quantiles(bins.groupBy("rule", "bin").agg(F.sum("n").alias("n")), []).select("rule", *[F.col(c).alias(f"all_{c}") for c in names])
    guard = per_rule(GUARDS)
    own = quantiles(bins, ["lang", "source"]).join(F.broadcast(merged), "rule").withColumn("guard", guard)  # a row per rule
    for c in names:  # a group's quantiles count up to twice the merged ones
        own = own.withColumn(c, F.expr(f"(total * least({c}, 2 * all_{c} + guard) + {PRIOR} * all_{c}) div (total + {PRIOR})"))
    ends = {"low": F.expr(f"low - {STRETCH} * (mid - low) - guard"), "high": F.expr(f"high + {STRETCH} * (high - mid) + guard")}
    return own.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == k, end)).cast("long").alias(f"{k}_{c}") for k in SPREADS for c, end in ends.items()])


def judge(documents: DataFrame) -> DataFrame:
    """Per document: the counts, base_failed, and kept: no base failure and all measures within its group's fences."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = materialise(measures(documents).withColumn("base_failed", failed))
    limits = fences(sketches(measured.where("not base_failed"))).withColumnsRenamed({"lang": "__lang", "source": "__source"})
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    inside = reduce(lambda x, y: x & y, [v.between(F.col(f"{k}_low"), F.col(f"{k}_high")) for k, v in rates().items()])
    ends = [f"{k}_{c}" for k in SPREADS for c in ("low", "high")]
    return attach(measured, limits, same, "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(~F.col("base_failed") & inside, F.lit(False)).alias("kept"), *ends)
