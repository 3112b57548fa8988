"""LM scoring (6): log-frequency Bloom filters of quantised n-gram counts, probed level by level.

Groups. Texts are dealt into groups of some megabytes, as they are read; a group keeps its tokens as numbers of its distinct words.
Words and pairs are 64-bit hashes, and hash ranges are *shards*, as many as keep each one's entries bounded. A group asks each shard
once for its distinct words and pairs of that range, with its own counts in training texts: so even the commonest n-gram is
one entry a group, and one shuffle both counts and asks.

Filters. A shard adds up the groups' counts. Words are answered exactly. Pairs go into the shard's log-frequency Bloom filter, sized from
its entries: an n-gram at quantised level L is inserted once for each level 1..L, so its level is read back by probing level
after level until one is absent. Pairs of ``LEAST_SHARE`` of all training tokens or more, 1/LEAST_SHARE of them at most, are
in one filter that is broadcast to all workers (16 MB at most); all others stay in the shards' filters, which grow with the corpus and so
have no bound for a broadcast. Nothing is left out.

Model. P(w | h) = (q(hw) + PRIOR * P(w)) / (c(h) + PRIOR), P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), for a text's first token P(w);
q is the quantised count (exact up to 19), c an exact one, V the number of distinct training words. With one unseen word, the
probabilities add up to 1 but for quantisation and false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm import base
from quaystone.llm.words import END_WORD, mix, word_hashes

#: Share of the training tokens from which a pair is in the broadcast filter, and weight of the word's own probability.
LEAST_SHARE, PRIOR = 1e-6, 2.0
#: Ratio of the count levels beyond 19, probes a level, bits of a filter for each level of an entry.
LEVEL, PROBES, LEVEL_BITS = 1.1, 2, 24
#: Bytes of text in a group, about, and entries that a shard gets from all groups, about.
GROUP_BYTES, SHARD = 8 << 20, 1 << 19
#: The level that stands for a pair of the broadcast filter.
HOT = 65_535


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each text with the end token last, and n+1 offsets."""
    raw, offsets = base.text_buffer(texts)
    words, first = word_hashes(raw, offsets)
    return np.insert(words, first[1:], END_WORD), first + np.arange(len(first))


def pair_keys(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (previous, word) for all tokens but each text's first, and their places among the tokens."""
    inner = np.ones(len(tokens), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    with np.errstate(over="ignore"):
        return mix(mix(tokens[at - 1] + np.uint64(0x51ED270B)) ^ tokens[at]), at


class LogFrequencyFilter:
    """Quantised counts of ``least`` or more in a Bloom filter of at least LEVEL_BITS bits for each level of an entry."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, least: int = 1):
        lows = [max(1, least)]
        while lows[-1] < 1 << 60:
            lows.append(max(lows[-1] + 1, int(lows[-1] * LEVEL)))
        self.lows = np.array(lows, np.int64)
        levels, j = np.searchsorted(self.lows, counts, side="right"), 1
        bits = max(64, LEVEL_BITS * int(levels.sum()))
        self.mask = np.uint64((1 << (bits - 1).bit_length()) - 1)
        self.bits = np.zeros(int(self.mask) + 1 >> 3, np.uint8)
        keys, levels = keys[levels > 0], levels[levels > 0]
        while len(keys):
            for at in self._places(keys, j):
                np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            j += 1
            keys, levels = keys[levels >= j], levels[levels >= j]

    def _places(self, keys: np.ndarray, j: int) -> Iterator[np.ndarray]:
        for k in range(PROBES):
            with np.errstate(over="ignore"):
                yield mix(keys + np.uint64(j * PROBES + k) * np.uint64(0x9E3779B97F4A7C15)) & self.mask

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Levels, 0 for absent keys: one membership probe a level, until one fails."""
        level, live, j = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        while len(live) and j <= len(self.lows):
            there = np.ones(len(live), bool)
            for at in self._places(keys[live], j):
                there &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            live = live[there]
            level[live] = j
            j += 1
        return level

    def counts_of(self, levels: np.ndarray) -> np.ndarray:
        """The middle of each level's whole numbers; 0 for level 0."""
        return _middles(self.lows)[levels]


def _middles(lows: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.sqrt(lows[:-1] * (lows[1:] - 1.0)), lows[-1:]])


_NO_KEYS = np.zeros(0, np.uint64)
_EMPTY = LogFrequencyFilter(_NO_KEYS, np.zeros(0, np.int64))


def _pack(values: np.ndarray) -> bytes:
    """Shuffles compress little of numbers as they are."""
    return pa.compress(values.tobytes(), "zstd", asbytes=True)


def _unpack(raw: bytes, n: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(dtype).itemsize, "zstd", asbytes=True), dtype) if n else np.zeros(0, dtype)


_GROUP = T.StructType([T.StructField("group", T.LongType()), T.StructField("doc_id", T.ArrayType(T.LongType())), T.StructField("trained", T.ArrayType(T.BooleanType())), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("words", T.BinaryType()), T.StructField("places", T.BinaryType()), T.StructField("n_trained", T.LongType()), T.StructField("entries", T.LongType())])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, trained) to groups: the sorted hashes of their distinct words, and each token's place among them."""
    parts, size, sent = [], 0, 0

    def send(sent: int) -> pa.RecordBatch:
        ids = [i for p in parts for i in p[0]]
        trained = np.concatenate([p[1] for p in parts])
        tokens, lengths = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        words, places = np.unique(tokens, return_inverse=True)
        first = np.append(0, np.cumsum(lengths))
        entries = len(words) + len(np.unique(pair_keys(tokens, first)[0]))
        one = [TaskContext.get().partitionId() << 32 | sent, ids, trained.tolist(), lengths.tolist(), words.tobytes(), _pack(places.astype(np.int32)), int(lengths[trained].sum()), entries]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, _ARROW_GROUP, strict=True)], names=_GROUP.names)

    for batch in base.slices(batches):
        tokens, first = tokens_of(batch.column(1))
        parts.append((batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool), tokens, np.diff(first)))
        size += batch.column(1).nbytes
        if size >= GROUP_BYTES:
            yield send(sent)
            parts, size, sent = [], 0, sent + 1
    if parts:
        yield send(sent)


_ARROW_GROUP = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


class _Group:
    """A row of the table of groups, opened."""

    def __init__(self, row: dict):
        self.doc_id, self.trained, self.lengths = row["doc_id"], np.array(row["trained"], bool), np.array(row["lengths"], np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.places = _unpack(row["places"], int(self.lengths.sum()), np.int32)
        self.first = np.append(0, np.cumsum(self.lengths))
        keys, self.inner = pair_keys(self.words[self.places], self.first)
        self.pairs, self.pair_places = np.unique(keys, return_inverse=True)


_ASKED = T.StructType([T.StructField("shard", T.LongType()), T.StructField("group", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("word_counts", T.BinaryType()), T.StructField("high", T.BinaryType()), T.StructField("low", T.BinaryType()), T.StructField("pair_counts", T.BinaryType())])


def _ask(bits: int):
    """A row for each group and shard: the group's words and pairs in the shard's range of hashes, sorted, and their training counts.

    Of a pair's hash, the 48 bits below the shard's own are sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([s << 64 - bits for s in range(1, 1 << bits)], np.uint64)
        for batch in batches:
            for row in batch.to_pylist():
                g = _Group(row)
                learned = np.repeat(g.trained, g.lengths)
                word_counts = np.bincount(g.places[learned], minlength=len(g.words)).astype(np.int32)
                pair_counts = np.bincount(g.pair_places[learned[g.inner]], minlength=len(g.pairs)).astype(np.int32)
                rest = (g.pairs << np.uint64(bits)) >> np.uint64(16)
                high, low = (rest >> np.uint64(16)).astype(np.uint32), rest.astype(np.uint16)
                w, p = (np.concatenate([[0], np.searchsorted(x, bounds), [len(x)]]) for x in (g.words, g.pairs))
                some = np.flatnonzero((w[1:] > w[:-1]) | (p[1:] > p[:-1]))
                columns = [
                    pa.array(some, pa.int64()),
                    pa.array(np.full(len(some), row["group"]), pa.int64()),
                    *(pa.array([f(x[at[s] : at[s + 1]]) for s in some], pa.binary()) for x, at, f in ((g.words, w, np.ndarray.tobytes), (word_counts, w, _pack), (high, p, np.ndarray.tobytes), (low, p, np.ndarray.tobytes), (pair_counts, p, _pack))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_ASKED.names)

    return run


_ANSWER = T.StructType([T.StructField("group", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("word_counts", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("levels", T.BinaryType()), T.StructField("n_pairs", T.LongType()), T.StructField("distinct", T.LongType()), T.StructField("hot", T.ArrayType(T.LongType())), T.StructField("hot_counts", T.ArrayType(T.LongType()))])


def _answer(bits: int, least: int):
    """All that a shard is asked, to a row for each group (aligned with what it asked), and one (without a group) of what the model needs from the shard."""

    def run(asked: pa.Table) -> pa.Table:
        shard, groups = asked.column("shard")[0].as_py(), asked.column("group").to_pylist()
        column = lambda name, dtype: [np.frombuffer(x, dtype) for x in asked.column(name).to_pylist()]
        words, high, low = column("words", np.uint64), column("high", np.uint32), column("low", np.uint16)
        n_words, n_pairs = [len(x) for x in words], [len(x) for x in high]
        counted = lambda name, sizes: np.concatenate([_unpack(x, n, np.int32) for x, n in zip(asked.column(name).to_pylist(), sizes, strict=True)])
        known, at = np.unique(np.concatenate(words), return_inverse=True)
        totals = np.bincount(at, counted("word_counts", n_words), len(known)).astype(np.int64)
        exact = np.split(totals[at], np.cumsum(n_words)[:-1])
        rest = np.concatenate(high).astype(np.uint64) << np.uint64(16) | np.concatenate(low).astype(np.uint64)
        pairs, at = np.unique(rest, return_inverse=True)
        pair_totals = np.bincount(at, counted("pair_counts", n_pairs), len(pairs)).astype(np.int64)
        hot = pair_totals >= least
        store = LogFrequencyFilter(pairs[~hot], pair_totals[~hot])
        levels = np.where(hot, HOT, store.probe(pairs)).astype(np.uint16)
        levels = np.split(levels[at], np.cumsum(n_pairs)[:-1])
        null = [None]
        rows = [[*groups, None], [shard] * (len(groups) + 1), [*map(_pack, exact), None], [*n_words, None], [*map(_pack, levels), None], [*n_pairs, None], null * len(groups) + [int((totals > 0).sum())], null * len(groups) + [hot_keys(shard, pairs[hot], bits).astype(np.int64).tolist()], null * len(groups) + [pair_totals[hot].tolist()]]
        return pa.table([pa.array(x, t) for x, t in zip(rows, _ARROW_ANSWER, strict=True)], names=_ANSWER.names)

    return run


_ARROW_ANSWER = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def hot_keys(shard, rest: np.ndarray, bits: int) -> np.ndarray:
    """The key of a pair in the broadcast filter: its shard and the 48 bits below, mixed."""
    with np.errstate(over="ignore"):
        return mix(rest + mix(np.asarray(shard, np.uint64) + np.uint64(0x2545F491)) * np.uint64(2 * bits + 1))


_SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("trained", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def plain_probability(counts: np.ndarray, n: int, distinct: int) -> np.ndarray:
    return (counts + 0.5) / (n + 0.5 * (distinct + 1))


def _score(bits: int, n: int, distinct: int, broadcast):
    """A group and its answers to a row a text."""

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        shards = answers.column("shard").to_numpy()
        order = np.argsort(shards)
        word_counts, n_words, levels, n_pairs = (answers.column(x).to_pylist() for x in ("word_counts", "n_words", "levels", "n_pairs"))
        counts = np.concatenate([np.zeros(0, np.int64), *(_unpack(word_counts[i], n_words[i], np.int64) for i in order)])
        level = np.concatenate([np.zeros(0, np.uint16), *(_unpack(levels[i], n_pairs[i], np.uint16) for i in order)]).astype(np.int64)
        for row in group.to_pylist():
            g = _Group(row)
            hot = level == HOT
            times = _EMPTY.counts_of(np.where(hot, 0, level))
            if hot.any():
                store = broadcast.value
                keys = g.pairs[hot]
                times[hot] = store.counts_of(store.probe(hot_keys(keys >> np.uint64(64 - bits), (keys << np.uint64(bits)) >> np.uint64(16), bits)))
            c = counts[g.places]
            p = plain_probability(c, n, distinct)
            plain, context = np.log10(p), c[g.inner - 1]
            p[g.inner] = (times[g.pair_places] + PRIOR * p[g.inner]) / (np.maximum(context, times[g.pair_places]) + PRIOR)
            add = lambda x, g=g: np.add.reduceat(x, g.first[:-1])  # noqa: E731  (no text is without a token)
            out.append(pa.table([pa.array(g.doc_id, pa.int64()), pa.array(g.trained), pa.array(g.lengths), pa.array(add((c > 0).astype(np.int64))), pa.array(add(plain)), pa.array(add(np.log10(p)))], names=_SCORED.names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], f.type) for f in _ARROW_SCORED], schema=_ARROW_SCORED)

    return run


_ARROW_SCORED = pa.schema([("doc_id", pa.int64()), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def train_and_score(docs: DataFrame, trained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score, score: all rows, by a model learned from those where ``trained`` (a column of doc_id) holds.

    A null or empty text is its end token alone. Repeated rows, and rows with equal or null ids, count and are scored each for itself.
    Other columns aren't read; an empty table gives none; without training rows all counts are 0. To the driver go
    sums, and pairs for the broadcast filter: at most 1/LEAST_SHARE, and half the tokens of a small corpus.
    """
    spark = docs.sparkSession
    rows = base.id_and_text(docs, id_col, text_col).withColumn("trained", F.coalesce(trained, F.lit(False)))
    groups = base.materialise(rows.mapInArrow(_groups, _GROUP), "groups", compression="zstd")
    n, entries = groups.agg(F.coalesce(F.sum("n_trained"), F.lit(0)), F.coalesce(F.sum("entries"), F.lit(0))).first()
    shards = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // SHARD))
    bits, least = (shards - 1).bit_length(), max(2, int(np.ceil(LEAST_SHARE * n)))
    asked = groups.mapInArrow(_ask(bits), _ASKED)
    answers = base.materialise(asked.groupBy("shard").applyInArrow(_answer(bits, least), _ANSWER), "answers")
    model = answers.where("group is null")
    distinct = model.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    hot = model.where(F.size("hot") > 0).select(F.explode(F.arrays_zip("hot", "hot_counts")).alias("x")).select("x.*").toArrow()
    store = LogFrequencyFilter(hot.column(0).to_numpy().astype(np.uint64), hot.column(1).to_numpy(), least)
    score = _score(bits, n, distinct, spark.sparkContext.broadcast(store))
    told = answers.where("group is not null").drop("distinct", "hot", "hot_counts")
    scored = groups.groupBy("group").cogroup(told.groupBy("group")).applyInArrow(score, _SCORED)
    return scored.select("doc_id", "trained", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = train_and_score(base.documents(spark, sf_dir), base.fold_of() != 1)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
