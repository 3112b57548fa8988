"""Quality rules (9), native: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words and word pairs fall into ``buckets`` by xxhash64. Two multinomials over the buckets are counted, one over the
trusted documents and one over all documents; a document's score is the sum of log(p_target / p_raw) over its
features, divided by their number plus ``shrink`` (so that a few words can't carry a verdict). A document is kept if
no base rule fails and its score reaches ``threshold``, a fixed number. Everything is DataFrame functions; what
reaches the driver is two counts a bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm import base

BUCKETS, SHRINK, THRESHOLD = 16_384, 64, -0.035
#: Pseudo-counts a bucket, dealt out as the raw corpus is, that a target count is smoothed with.
PRIOR = 50
#: Trusted rows used at most: the first by a hash of their id. A bound on what is broadcast.
TARGET_ROWS = 20_000
WINDOW = 5
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def features(words: Column, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbours."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)))
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.pmod(F.xxhash64(F.get(words, i - 1), F.get(words, i)), F.lit(buckets))))
    return F.concat(single, F.coalesce(pairs, F.array().cast("array<bigint>")))


def _let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def repeated_words(windows: Column, width: int = WINDOW) -> Column:
    """Words covered by windows (hashes, in order) that occur twice or more. Sorting, not pairs: n log n at any length."""
    paired = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = _let(paired, lambda s: F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull()))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(F.sort_array(again), start, lambda a, i: F.struct((i + width).alias("end"), (a["total"] + i + width - F.greatest(i, a["end"])).alias("total")), lambda a: a["total"])
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered)


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to (doc_id, text, ...)."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, SPACES) != "")
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n_words") - WINDOW), lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW)))))
    counted = (
        docs.withColumn("text", F.coalesce(text, F.lit("")))
        .withColumn("words", words_of(text))
        .withColumn("n_words", F.size("words"))
        .withColumns({"windows": F.coalesce(windows, F.array().cast("array<bigint>")), "lines": lines})
        .withColumns(
            {
                "n_words": F.col("n_words").cast("long"),
                "word_chars": F.length(_without(text, SPACES)).cast("long"),
                "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
                "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
                "n_repeat_words": repeated_words(F.col("windows")),
            }
        )
    )
    return counted.drop("windows", "lines").withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def fit(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(p_target / p_raw) of each bucket over (doc_id, text) rows; the target is smoothed towards the raw corpus.

    ``target_ids`` (doc_id, at most TARGET_ROWS rows, as ``trusted_ids`` gives them) is broadcast. Without any trusted
    document all ratios are 0.
    """
    marked = docs.join(F.broadcast(target_ids.withColumn("trusted", F.lit(1))), "doc_id", "left")
    words = marked.select("trusted", words_of(F.coalesce("text", F.lit(""))).alias("words"))
    counts = words.select("trusted", F.explode(features(F.col("words"), buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target")).collect()
    raw, target = [1] * buckets, [0] * buckets
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    n_raw, n_target, prior = sum(raw), sum(target), PRIOR * buckets
    return [round(math.log((t * n_raw / r + prior) / (n_target + prior)), 5) for t, r in zip(target, raw, strict=True)]


def trusted_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """doc_id of rows labelled quality 1, one each; of more than ``rows``, those with the least hashes."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return base.least_hashes(good, rows, "doc_id")


def _settled(df: DataFrame) -> DataFrame:
    """The same rows, behind a generator that filters aren't pushed through: pushed into a lambda, they would split the text once a word."""
    return df.select(F.explode_outer(F.array(F.struct("*"))).alias("settled")).select("settled.*")


def score(rated: DataFrame, weights: list[float], shrink: int = SHRINK, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and kept to the result of ``base_rules``."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")  # folded into a literal
    found = features(F.col("words"), len(weights))
    total = F.aggregate(found, F.lit(0.0), lambda a, b: a + F.get(table, b.cast("int")))
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(0)) + shrink
    return _settled(rated.withColumn("score", total / n).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop("words"))


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    One row per input row. A null text has no words and fails the base rules, as an empty one does. Repeated rows and
    null ids are rated like others. Other columns aren't read; an empty table gives none.
    """
    rows = base.id_and_text(docs, id_col, text_col)
    weights = fit(rows, trusted_ids(labels))
    return score(base_rules(rows), weights).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(base.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
