"""Operator 8: quality rules with risk-controlled thresholds, in DataFrame functions only.

Base measures come from every whole text.  For each rule (a measure that is bad when high) and each
stratum (language), labelled good documents are a holdout: at a cutoff that rejects k of n of them,
the exact binomial probability P(Bin(n, alpha) <= k) is the p-value of "this cutoff rejects more
than alpha of the good".  Cutoffs are tried from the most lenient to the strictest, each against
delta / (rules * strata * cutoffs); the strictest before the first that can't be certified is used, and
a rule without a certified cutoff rejects nothing.  With alpha = RISK / rules, at most RISK of a
stratum's good documents are rejected by all rules together, with probability 1 - DELTA.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written

#: Share of a stratum's good documents that all rules together may reject, and the chance of error.
RISK, DELTA = 0.02, 0.05
#: Cutoffs of each rule, lenient first: the document is rejected if its measure is above.
GRID: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeat_word_share": (0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "chars_per_word": (30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0),
}
WINDOW = 8


def _shifted(a: Column, by: int) -> Column:
    """hash(a[i], a[i + by]) of every i that has both."""
    n = F.greatest(F.size(a) - by, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + by), n), lambda x, y: F.xxhash64(x, y))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more; sorts (hash, place) so equal windows are neighbours."""

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    sorted_ = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    idx = F.element_at(F.transform(F.array(sorted_), places), 1)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(idx, start, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])


def measures(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and the base measures; one narrow pass, no shuffle.

    Each array is a column before it is used twice, so that it is computed once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(*keep, text.alias("_t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"))
    d = d.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("_l"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    base = [*keep, "n_words", "word_chars", "n_symbols"]
    d = d.select(*base, F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), _shifted(F.col("_h"), 1).alias("_h"))
    base += ["n_lines", "n_dup_lines"]
    for by in (2, 4):  # hashes of 4 words, then of 8
        d = d.select(*base, _shifted(F.col("_h"), by).alias("_h"))
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.select(*base, F.when(again, _covered(F.col("_h"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    return d.select(
        "*",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / per_word).alias("symbols_per_word"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / per_word).alias("repeat_word_share"),
        (F.col("word_chars") / per_word).alias("chars_per_word"),
    )


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in logarithms; 1 where k is at or above the mean, being never small there."""
    start = n * F.log1p(F.lit(-p))
    odds = F.log(F.lit(p / (1 - p)))

    def add(a: Column, i: Column) -> Column:
        term = a["t"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(a["s"], term)
        return F.struct(term.alias("t"), (top + F.log(F.exp(a["s"] - top) + F.exp(term - top))).alias("s"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.exp(F.aggregate(steps, F.struct(start.alias("t"), start.alias("s")), add, lambda a: a["s"]))
    return F.when(k >= n * p, 1.0).otherwise(tail)


def thresholds(measured: DataFrame, good: DataFrame, id_col: str, stratum_col: str) -> DataFrame:
    """(stratum, one cutoff per rule; null where none is certified).

    ``good`` holds the ids of good labelled documents.  One pass counts, per stratum, how many are
    above each cutoff: a fixed number of sums, combined in tasks before the shuffle.
    """
    held = measured.join(good.select(F.col(id_col).alias("_good")).distinct(), F.col(id_col) == F.col("_good"), "left_semi")
    counts = [F.sum((F.col(rule) > c).cast("long")).alias(f"{rule}_{i}") for rule, grid in GRID.items() for i, c in enumerate(grid)]
    per = held.groupBy(F.col(stratum_col).alias("stratum")).agg(F.count("*").alias("n"), *counts)
    strata = F.greatest(F.max("m"), F.lit(1))
    m = per.agg(F.count("*").alias("m")).agg(strata.alias("strata"))  # one row
    alpha = RISK / len(GRID)
    level = F.lit(DELTA) / (F.lit(float(sum(map(len, GRID.values())))) * F.col("strata"))
    per = per.join(F.broadcast(m), F.lit(True))  # a single number
    # each test is a column of its own, so that it is computed once
    tested = per.select("stratum", *[(binomial_at_most(F.col(f"{rule}_{i}"), F.col("n"), alpha) <= level).alias(f"{rule}_{i}") for rule, grid in GRID.items() for i in range(len(grid))])
    columns = []
    for rule, grid in GRID.items():
        # a cutoff holds if it and all more lenient ones pass: the number of passes before the first failure says which
        passes = F.array(*[F.col(f"{rule}_{i}") for i in range(len(grid))])
        first_failure = F.array_position(passes, False)
        n = F.when(first_failure == 0, len(grid)).otherwise(first_failure - 1).cast("int")
        columns.append(F.get(F.array(*map(F.lit, grid)), n - 1).alias(f"cut_{rule}"))
    return tested.select("stratum", *columns)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Measures and verdict of every document.

    Result, a row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and the measures that the rules use.  Null text has no words and fails the
    base rules; a null stratum is a stratum of its own; without labels no rule is certified and only
    the base rules reject; a document with several labels is good if all say so; ids in labels
    without a document are ignored; an empty table gives no rows; other columns aren't read.
    """
    measured = written(measures(docs, [id_col, stratum_col], text_col))
    good = labels.groupBy(id_col).agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("q")).filter("q = 1")
    cut = thresholds(measured, good, id_col, stratum_col)
    found = measured.join(cut, F.col(stratum_col).eqNullSafe(F.col("stratum")), "left")
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False)) for r in GRID])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return found.select(id_col, *names, (~F.col("base_failed") & ~bad).alias("kept"), *GRID)
