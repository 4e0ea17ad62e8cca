"""Operator 7: quality rules, in DataFrame functions only.

Base rules look at counts of a text. The learned rule compares two multinomials over hashed
word 1- and 2-grams, with every document of the corpus counted: the raw corpus and the
trusted target. A document's score is the mean of log p(target) - log p(raw) over its
n-grams, so long texts weigh no more than short ones, and it is kept when the score reaches
a fixed threshold. Both models have ``buckets`` entries whatever the corpus, counted by
partial sums in every task, so neither a hot word nor a hot document moves much data.

The windows that recur in a text come from one sort of its window hashes (64-bit), so the
work stays n log n for texts of any length.

Edge cases: a null text has no words and fails the base rule; a text of fewer than three
words has no windows; an empty table gives no rows; repeated rows are judged alike, each on
its own; a label counts once per document id; without any trusted document nothing is
learned, and the base rule alone decides; other columns are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1 << 14
THRESHOLD = -0.06
MIN_WORDS = 50

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body`` over ``value`` as a bound variable: evaluated once per row, also where the
    body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def ngram_buckets(w: Column, buckets: int) -> Column:
    """Buckets of the lower-cased 1-grams and 2-grams of a word array."""
    def grams(hashed: Column) -> Column:
        pair = F.transform(hashed, lambda h, i: F.pmod(F.xxhash64(h, F.get(hashed, i + 1)), F.lit(buckets)).cast("int"))
        return F.concat(F.transform(hashed, lambda h: F.pmod(h, F.lit(buckets)).cast("int")),
                        F.slice(pair, F.lit(1), F.greatest(F.size(hashed) - 1, F.lit(0))))
    return let(F.transform(w, lambda x: F.xxhash64(F.lower(x))), grams)


def repeated_words(w: Column) -> Column:
    """Number of words that lie in a three-word window found at least twice."""
    def per_window(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def recurring(s: Column) -> Column:
        hit = F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def counted(w: Column) -> Column:
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(
            let(F.sort_array(per_window(w)), lambda s: let(recurring(s), covered)))
    return counted(w)


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def bucket_counts(docs: DataFrame, labels: DataFrame, key: str, text_col: str, buckets: int) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all documents and over the trusted ones."""
    trusted = labels.where(F.col("quality") == 1).select(F.col(key).alias("__k")).distinct()
    src = docs.select(F.col(key).alias("__k"), F.col(text_col).alias("__text"))
    # labels grow with the corpus, so they are never broadcast: one plan at every size
    marked = src.join(trusted.withColumn("__t", F.lit(1)).hint("merge"), "__k", "left")
    grams = marked.select(F.coalesce("__t", F.lit(0)).alias("t"), F.explode(ngram_buckets(words(F.col("__text")), buckets)).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))


def log_ratios(counts: DataFrame, buckets: int) -> list[float]:
    """log p(target) - log p(raw) per bucket (``buckets`` rows). The raw model adds one to
    every count; the target model takes the raw one as its prior, with the weight of
    ``buckets`` n-grams, so a bucket that says little moves no score."""
    raw, target = [1] * buckets, [0] * buckets
    for r in counts.collect():
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    n_raw, n_target = sum(raw), sum(target)
    p = [r / n_raw for r in raw]
    return [math.log((t + buckets * q) / (n_target + buckets)) - math.log(q) for t, q in zip(target, p)]


def score(w: Column, ratios: list[float]) -> Column:
    """Mean log ratio over the n-grams; 0 without words."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one constant
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.greatest(F.size(g), F.lit(1))
    return let(ngram_buckets(w, len(ratios)), total)


def rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text",
          buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the base counts, base_failed, score and kept."""
    ratios = log_ratios(bucket_counts(docs, labels, key, text_col, buckets), buckets)
    text = F.col(text_col)
    solid = F.length(F.translate(text, SPACES, ""))
    base = docs.select(
        F.col(key),
        let(words(text), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), score(w, ratios).alias("score"))).alias("__w"),
        F.coalesce(solid, F.lit(0)).cast("long").alias("word_chars"),
        F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0)).cast("long").alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"))
    out = base.select(key, F.col("__w.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                      F.col("__w.n_repeat_words").alias("n_repeat_words"), F.col("__w.score").alias("score"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
