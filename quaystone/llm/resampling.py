"""Target-distribution importance resampling (13): documents drawn in proportion to how much likelier the target makes them.

Runs of words are features, hashed into ``buckets``. Each document's buckets are one array, made by higher-order functions and kept on
shared storage, so that each text is split once. The corpus' and the target's totals a bucket are all that shuffles before the
draw: at most ``buckets`` rows a task. They give each bucket's gain, and a document's weight is an aggregate over its array that looks each
gain up in one literal array, with no row a word. Weighted sampling without replacement adds Gumbel noise, fixed by the
document's id, and takes the highest scores. Ranks come from one range shuffle of four numbers a document and a row count a partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm import base

BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Characters between words: all of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Lower-cased words; of a null text, none. Only words with other than ASCII characters need a translation letter by letter."""
    low = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != ""), low)


def bucket_array(words: Column, buckets: int = BUCKETS, longest: int = LONGEST) -> Column:
    """The bucket of each run of 1 to ``longest`` words, joined by a space: crc32 modulo ``buckets``."""
    bucket = lambda run: F.pmod(F.crc32(run.cast("binary")), F.lit(buckets)).cast("int")

    def runs(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))
        return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<int>"))

    parts = [F.transform(words, bucket), *(runs(n) for n in range(2, longest + 1))]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def totals(arrays: DataFrame) -> DataFrame:
    """bucket, n: over all arrays. Each task sends a row a bucket at most."""
    return arrays.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gain_table(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket: s of S raw features, t of T target features, B buckets."""
    counted = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    merged = counted.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # ``buckets`` rows at most
    s, t = [0] * buckets, [0] * buckets
    for r in merged:
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return [math.floor(1000 * math.log((t[i] + 1.0) * all_s / ((s[i] + 1.0) * all_t))) for i in range(buckets)]


def weight(bucket_col: str, gains: list[int]) -> Column:
    """The sum of the gains of an array of buckets, 0 of an empty one. The table is folded into a literal."""
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")
    return F.aggregate(bucket_col, F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256 of ``seed:doc_id``. A null id counts as the empty text."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, longest: int = LONGEST, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per input row; rank (from 1, highest score first) is null where undrawn.

    Of the N documents with at least ``min_words`` words floor(percent N / 100) are drawn; ties go to the smaller doc_id (null last), then
    to fewer features; rows that still tie are alike, and each has a rank of its own. A null or empty text has no features and weight 0.
    Repeated rows all count and are ranked each; other columns aren't read; an empty table gives none, and an empty target gains that only
    know the corpus. Counts cover all rows of both tables. What reaches the driver is two counts a bucket and a count a partition.
    """
    spark = docs.sparkSession
    words = words_of(F.col("text"))
    split = base.id_and_text(docs, id_col, text_col).select("doc_id", words.alias("words"))
    named = split.select("doc_id", F.size("words").cast("long").alias("n_words"), bucket_array(F.col("words"), buckets, longest).alias("buckets"), F.rand(seed).alias("alike"))
    arrays = base.materialise(named, "buckets")
    wanted = target.select(bucket_array(words_of(target[target_text].cast("string")), buckets, longest).alias("buckets"))
    gains = gain_table(totals(arrays), totals(wanted), buckets)
    scored = arrays.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight("buckets", gains).alias("weight"), "alike")
    scored = base.materialise(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")

    long_enough = scored.where(F.col("n_words") >= min_words)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "alike")
    placed = long_enough.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = base.materialise(placed.select("doc_id", "n_features", "weight", "score", F.shiftright("place", 33).cast("int").alias("part"), F.col("place").bitwiseAND(2**33 - 1).alias("nth")), "placed")
    before, sizes = [], sorted(map(tuple, placed.groupBy("part").agg(F.count("*")).collect()))  # a row a partition
    n = 0
    for part, size in sizes:
        before.append((part, n))
        n += size
    rank = F.col("before") + F.col("nth") + 1
    ranked = placed.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part")
    drawn = ranked.select("doc_id", "n_features", "weight", "score", F.when(rank <= percent * n // 100, rank).alias("rank"))
    return drawn.union(scored.where(F.col("n_words") < min_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(base.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: DuckDB has no crc32: it is folded byte by byte over each distinct word, by the usual table of the reversed polynomial.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i))"
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + r"'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents), m AS (SELECT {_WORDS} AS words FROM benchmark),
 w AS (SELECT doc_id, unnest(words) AS word FROM d), mw AS (SELECT unnest(words) AS word FROM m),
 bytes AS (SELECT word, list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(hex(word), 2 * i - 1, 2))::BIGINT) AS b FROM (SELECT word FROM w UNION SELECT word FROM mw)),
 crc AS MATERIALIZED (SELECT word, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, (SELECT {_CRC_TABLE} AS t)),
 s AS (SELECT bucket, count(*) AS s FROM w JOIN crc USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM mw JOIN crc USING (word) GROUP BY 1),
 g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1.0::DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
 p AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM w JOIN crc USING (word) JOIN g USING (bucket) GROUP BY 1),
 r AS (SELECT d.doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u FROM d LEFT JOIN p USING (doc_id)),
 z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM r),
 k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= {MIN_WORDS})
 SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM k) * {PERCENT} // 100 THEN rank END AS rank FROM z LEFT JOIN k USING (doc_id)"""
