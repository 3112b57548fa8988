"""Language ID (5) by language-bitmask n-gram filters.

Training counts the character trigrams of each language over all labelled texts (exact, packed into 63 bits).
A language holds the trigrams that make up at least ``least_share`` of its text and whose share there is at least
``least_ratio`` of their largest share in any language; by the first bound a language has at most 1/least_share of
them. They are inserted into a bit-sliced Bloom filter: each slot is a bitmask over languages, and the AND of a
trigram's slots is the set of all languages that (may) hold it. A text's language is the one with the largest
popcount after correction for the filter's false positives: (hits/n - fp) / (1 - fp).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm import base
from quaystone.llm.words import mix

UNKNOWN = "und"
LEAST_SHARE, LEAST_RATIO, PROBES = 2e-5, 0.2, 3
#: Trigrams that a task gathers before it sends their counts on.
GATHERED = 1_500_000


def _letters_table() -> np.ndarray:
    """For each code point: 0 for what isn't a letter (one separator for all of it), else its lower-case code point."""
    table = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_table: list[np.ndarray] = []


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the trigrams of letters and word edges of all texts, and the index of each one's text.

    Runs of other characters are one separator; a trigram has a letter in its middle or two letters.
    """
    if not _table:
        _table.append(_letters_table())
    joined = "\x00\x00".join(["", *texts.to_pylist(), ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts.to_pylist()], np.int64) + 2
    owner = np.append(np.repeat(np.arange(len(lengths)), lengths), [len(lengths)] * 2)
    codes = _table[0][points]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)  # squeeze runs of separators
    codes, owner = codes[keep].astype(np.int64), owner[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
    whole = codes[1:-1] != 0  # texts are apart by a separator, so its neighbours are the same text's or separators
    return keys[whole], owner[1:-1][whole]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) batches to (lang, gram, n): the counts of one partition, added up before they are shuffled."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush(lang: str, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, n, len(keys)).astype(np.int64)

    def rows() -> Iterator[pa.RecordBatch]:
        for name, (keys, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    for batch in base.slices(batches):
        langs = np.array(batch.column(0).to_pylist(), object)
        keys, owner = trigrams(batch.column(1).fill_null(""))
        names, of = np.unique(langs.astype(str), return_inverse=True)
        for k, name in enumerate(names):
            new, n = np.unique(keys[of[owner] == k], return_counts=True)
            if name in total:
                new, n = flush(name, np.concatenate([total[name][0], new]), np.concatenate([total[name][1], n]))
            total[name] = new, n
        if sum(len(keys) for keys, _ in total.values()) > GATHERED:
            yield from rows()
            total.clear()
    yield from rows()


@dataclass
class LanguageFilter:
    languages: list[str]
    slots: np.ndarray  # (slots, words): bit l of the 64-bit words is language l
    false_positive: np.ndarray  # per language
    reach: dict[str, float] = field(default_factory=dict)  # the share of each language's labelled trigrams that it holds

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> LanguageFilter:
        """A filter with 16 slots or more for each trigram of the language that has most."""
        languages = sorted(grams)
        most = max([1, *(len(g) for g in grams.values())])
        size = 1 << max(12, int(16 * most - 1).bit_length())
        slots = np.zeros((size, -(-max(1, len(languages)) // 64)), np.uint64)
        for k, lang in enumerate(languages):
            for at in _slots(grams[lang], size):
                np.bitwise_or.at(slots[:, k // 64], at, np.uint64(1 << k % 64))
        filled = np.array([(slots[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean() for k in range(len(languages))])
        return cls(languages, slots, filled**PROBES)

    def containing(self, keys: np.ndarray) -> np.ndarray:
        """Per key, the bitmask of the languages that hold it."""
        found = None
        for at in _slots(keys, len(self.slots)):
            found = self.slots[at] if found is None else found & self.slots[at]
        return found

    def shares(self, keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) corrected shares of held trigrams, and the number of trigrams of each text."""
        found = self.containing(keys)
        total = np.bincount(owner, minlength=n)
        shares = np.empty((n, len(self.languages)))
        for k in range(len(self.languages)):
            bits = (found[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            hits = np.bincount(owner, bits.astype(np.float64), n)
            fp = self.false_positive[k]
            shares[:, k] = np.clip((hits / np.maximum(total, 1) - fp) / (1 - fp), 0, 1)
        return shares, total


def _slots(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    h = mix(keys.astype(np.uint64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for j in range(PROBES):
        with np.errstate(over="ignore"):
            yield ((h + np.uint64(j) * step) & np.uint64(size - 1)).astype(np.int64)


def train(docs: DataFrame, least_share: float = LEAST_SHARE, least_ratio: float = LEAST_RATIO, lang_col: str = "lang", text_col: str = "text") -> LanguageFilter:
    """Learn from every row that has a label. Counting is pre-aggregated by partition; what reaches the driver is bounded
    by languages x 1/least_share trigrams. Rows with a null label or text teach nothing; no labelled rows give a
    filter without languages, which calls every text ``und``."""
    base.small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).where("lang is not null and text is not null")
    counts = base.materialise(rows.mapInArrow(_counts, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # a row a language
    shares = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    largest = shares.where(F.col("share") >= least_share).groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("in"), F.max("share").alias("most"))
    held = largest.select("gram", F.explode(F.filter("in", lambda x: x["share"] >= least_ratio * F.col("most"))).alias("x")).select("gram", "x.*")
    found = held.toArrow()
    langs, keys = np.array(found.column("lang").to_pylist(), object), found.column("gram").to_numpy()
    model = LanguageFilter.build({name: keys[langs == name] for name in set(langs.tolist())})
    share = found.column("share").to_numpy()
    model.reach = {name: float(share[langs == name].sum()) for name in model.languages}
    return model


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (the text's share of trigrams that its language holds, corrected; 0 for ``und``).

    Null and empty texts and texts without letters are ``und``. Equal shares go to the first language by name. One row
    per input row, repeated rows and null ids included. ``keep``: all columns of the input and ``lang_pred``,
    ``lang_score`` instead (columns of these names are replaced).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        m = shared.value
        keys, owner = trigrams(texts)
        if not m.languages:
            return pa.array([UNKNOWN] * len(texts), pa.string()), np.zeros(len(texts))
        shares, total = m.shares(keys, owner, len(texts))
        best = shares.argmax(axis=1)
        names = np.array([*m.languages, UNKNOWN], object)
        return pa.array(names[np.where(total > 0, best, len(m.languages))].tolist(), pa.string()), np.where(total > 0, shares[np.arange(len(best)), best], 0.0)

    if keep:
        rest = docs.drop("lang_pred", "lang_score")
        schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
        text_at = rest.columns.index(text_col)

        def run_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in base.slices(batches, text_col):
                lang, score = predict(batch.column(text_at).fill_null(""))
                yield pa.RecordBatch.from_arrays([*batch.columns, lang, pa.array(score)], names=schema.names)

        return rest.mapInArrow(run_kept, schema)

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.slices(batches):
            lang, score = predict(batch.column(1).fill_null(""))
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, pa.array(score)], names=schema.names)

    return base.id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(base.fold_of() != 0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir)
    model = train(training_rows(docs))
    return identify(docs, model).select("doc_id", (base.fold_of() == 0).alias("held_out"), "lang_pred", "score")
