"""Document fingerprints (12): an improbable-feature digest in chained Bloom filters, after published similarity digests.

Features are the windows of ``WIDTH`` bytes of a text. A window's entropy falls into one of BINS bins; a first pass counts the bins over the
whole corpus, and the rarer a bin is there, the more a window of it says (windows of very low entropy, runs of one sign and the like,
say least). Of each ``SPAN`` neighbouring windows the rarest, leftmost on a tie, gets a vote; windows with VOTES votes or more are the text's
features. Distinct ones go, in order, into Bloom filters of 2,048 bits with FILL features each, chained as the text goes on.

The likeness of two fingerprints compares each filter of the one with fewer features with the best match among the other's: the bits that
both have, less what chance gives filters of that density and two standard deviations, over the most they could share; the mean is weighted by
features. Equal fingerprints have likeness 1.

The edited text of the contract takes its second half from the next document. Documents are put in order by one range shuffle of texts;
a task goes through its range once and carries one document over from batch to batch. The first and last documents of the ranges,
one pair a partition, are joined afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quaystone.llm import base
from quaystone.llm.words import mix

WIDTH, SPAN, VOTES = 32, 32, 8  # a span isn't longer than a window, so it can't begin in a text of few windows and reach the next text
BINS, LEAST_BIN = 1024, 103
BITS, HASHES, FILL = 2048, 5, 128
#: Bytes that are looked at together, besides a margin.
SEGMENT = 1 << 18
_TOP = 1 << 20  #: c log2 c of a whole window of one byte value, in the tables


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """c log2 c, scaled to integers, for counts up to WIDTH, and its steps. Integers add up exactly in any order."""
    c = np.arange(WIDTH + 1, dtype=np.float64)
    whole = np.round(np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0.0) * _TOP / (WIDTH * np.log2(WIDTH))).astype(np.int32)
    return whole, np.append(0, np.diff(whole)).astype(np.int32)


_WHOLE, _STEP = _tables()


def entropy_bins(raw: np.ndarray) -> np.ndarray:
    """The entropy bin, 0 (one value) to BINS (all different), of each window of WIDTH bytes of the buffer.

    A window's sum changes by the step of the byte that leaves and of the one that comes; the counts these depend on are sums of
    comparisons of the buffer with itself, shifted by 1 to WIDTH - 1.
    """
    n = len(raw) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    ahead, behind = np.ones(len(raw), np.uint8), np.ones(len(raw), np.uint8)
    for d in range(1, WIDTH):
        same = raw[:-d] == raw[d:]
        ahead[:-d] += same
        behind[d:] += same
    sums = np.empty(n, np.int32)
    sums[0] = _WHOLE[np.bincount(raw[:WIDTH], minlength=256)].sum()
    if n > 1:
        np.cumsum(_STEP[behind[WIDTH:]] - _STEP[ahead[: n - 1]], out=sums[1:])
        sums[1:] += sums[0]
    return (_TOP - sums) >> 10


def segments(offsets: np.ndarray, margin: int) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, with margin from, with margin to) of the buffer's bytes, SEGMENT at a time."""
    end = int(offsets[-1])
    for a in range(0, end, SEGMENT):
        b = min(end, a + SEGMENT)
        yield a, b, max(0, a - margin), min(end, b + margin)


def bin_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many windows inside a text fall into each bin."""
    counts = np.zeros(BINS + 1, np.int64)
    for a, b, _, to in segments(offsets, WIDTH - 1):
        bins = entropy_bins(raw[a:to])[: b - a]
        inside = np.ones(len(bins), bool)
        for e in offsets[np.searchsorted(offsets, a + 1) : np.searchsorted(offsets, a + len(bins) + WIDTH)]:  # windows that cross a text's end
            inside[max(0, e - a - WIDTH + 1) : max(0, e - a)] = False
        counts += np.bincount(bins[inside], minlength=BINS + 1)
    return counts


def ranks(counts: np.ndarray) -> np.ndarray:
    """A rank from 0 for each bin, the rarest first; equal counts by bin; bins under LEAST_BIN last."""
    order = np.lexsort((np.arange(BINS + 1), counts, np.arange(BINS + 1) < LEAST_BIN))
    out = np.empty(BINS + 1, np.int64)
    out[order] = np.arange(BINS + 1)
    return out


def chosen(raw: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in the buffer) of the chosen windows, in order. Texts of WIDTH bytes or more have at least one.

    A text with fewer than SPAN windows has one span, of all. Where no window gets VOTES votes, the one with most is chosen (leftmost).
    """
    n_texts = len(offsets) - 1
    length = np.diff(offsets)
    places, best = [], np.full(n_texts, -1, np.int64)  # votes << 40 | (2^40 - 1 - place), of texts with few spans
    low = (1 << 40) - 1
    for a, b, from_, to in segments(offsets, SPAN + WIDTH):
        bins = entropy_bins(raw[from_:to])
        n = len(bins)
        if n == 0:
            continue
        text = np.repeat(np.arange(n_texts), np.diff(np.clip(offsets, from_, from_ + n)))
        last = offsets[text + 1] - WIDTH  # the last window of the text
        place = np.arange(from_, from_ + n)
        key = np.where(place <= last, rank[bins], 1 << 20) << 20 | np.arange(n)
        least = key
        step = 1
        while step < SPAN:  # the least of 2, 4, ... neighbours
            wider = least.copy()
            wider[:-step] = np.minimum(least[:-step], least[step:])
            least, step = wider, 2 * step
        few = length[text] - WIDTH + 1 < SPAN
        spans = (place + SPAN - 1 <= last) | (few & (place == offsets[text]) & (place <= last))
        votes = np.bincount(least[spans] & ((1 << 20) - 1), minlength=n)
        own = (place >= a) & (place < b) & (votes > 0)
        at = np.flatnonzero(own)
        places.append(place[at[votes[at] >= VOTES]])
        np.maximum.at(best, text[at], votes[at] << 40 | (low - place[at]))
    picked = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
    of = np.searchsorted(offsets, picked, side="right") - 1
    without = np.ones(n_texts, bool)
    without[of] = False
    more = np.flatnonzero(without & (best >= 0))
    picked, of = np.concatenate([picked, low - (best[more] & low)]), np.concatenate([of, more])
    order = np.lexsort((picked, of))
    return of[order], picked[order]


def feature_hashes(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows at these places."""
    if not len(places):
        return np.zeros(0, np.uint64)
    out = np.zeros(len(places), np.uint64)
    for a in range(0, len(places), 1 << 16):
        cut = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, WIDTH)[places[a : a + (1 << 16)]]).view("<u8")
        h = np.zeros(len(cut), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(cut.shape[1]):
                h = mix(h ^ cut[:, j]) + np.uint64(j + 1)
        out[a : a + (1 << 16)] = mix(h)
    return out


def _short_hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


class Fingerprint:
    """Features a filter, and the filters' bits as 64-bit words, a row each."""

    __slots__ = ("bits", "counts")

    def __init__(self, counts: np.ndarray, bits: np.ndarray):
        self.counts, self.bits = counts, bits

    def __str__(self) -> str:
        """``features:bits in hex``, a filter after the other, joined by full stops; of an empty text, empty."""
        return ".".join(f"{n}:{b.tobytes().hex()}" for n, b in zip(self.counts.tolist(), self.bits, strict=True))

    @classmethod
    def parse(cls, said: str) -> Fingerprint:
        parts = [x.split(":") for x in said.split(".") if x]
        bits = np.frombuffer(bytes.fromhex("".join(x[1] for x in parts)), "<u8").reshape(len(parts), BITS // 64)
        return cls(np.array([int(x[0]) for x in parts], np.int64), bits)


def fingerprints(raw: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> list[Fingerprint]:
    """A fingerprint for each text of the buffer. A text of fewer than WIDTH bytes is one feature, an empty one has none."""
    n_texts = len(offsets) - 1
    of, places = chosen(raw, offsets, rank)
    h = feature_hashes(raw, places)
    short = np.flatnonzero((np.diff(offsets) < WIDTH) & (np.diff(offsets) > 0))
    if len(short):
        of = np.concatenate([of, short])
        h = np.concatenate([h, np.array([_short_hash(raw[offsets[i] : offsets[i + 1]].tobytes()) for i in short], np.uint64)])
        order = np.argsort(of, kind="stable")
        of, h = of[order], h[order]
    order = np.lexsort((np.arange(len(h)), h, of))  # each text's distinct features, at their first place
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    kept = np.sort(order[new])
    of, h = of[kept], h[kept]
    n_features = np.bincount(of, minlength=n_texts)
    first_feature = np.append(0, np.cumsum(n_features))
    nth = np.arange(len(h)) - first_feature[of]
    n_filters = -(-n_features // FILL)
    first = np.append(0, np.cumsum(n_filters))
    row = first[of] + nth // FILL
    bits = np.zeros((int(first[-1]), BITS), bool)
    for j in range(HASHES):
        bits[row, ((h >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1, bitorder="little").view("<u8") if len(bits) else np.zeros((0, BITS // 64), np.uint64)
    counts = np.bincount(row, minlength=len(bits))
    return [Fingerprint(counts[first[i] : first[i + 1]], packed[first[i] : first[i + 1]]) for i in range(n_texts)]


def likeness(x: Fingerprint, y: Fingerprint) -> float:
    """0 to 1, the same both ways round. Two fingerprints without features are alike, one without and one with aren't."""
    if not len(x.counts) or not len(y.counts):
        return float(len(x.counts) == len(y.counts))
    if (x.counts.sum(), x.bits.tobytes()) > (y.counts.sum(), y.bits.tobytes()):
        x, y = y, x
    size_y = np.bitwise_count(y.bits).sum(axis=1).astype(np.float64)
    total = 0.0
    for n, b in zip(x.counts.tolist(), x.bits, strict=True):
        size, best = float(np.bitwise_count(b).sum()), 0.0
        for a in range(0, len(y.bits), 4096):
            other = size_y[a : a + 4096]
            both = np.bitwise_count(b[None, :] & y.bits[a : a + 4096]).sum(axis=1)
            chance = size * other / BITS
            chance = chance + 2.0 * np.sqrt(chance * (1 - size / BITS) * (1 - other / BITS))
            most = np.minimum(size, other)
            best = max(best, float(((both - chance) / np.maximum(most - chance, 1e-9)).clip(0.0, 1.0).max()))
        total += n * best
    return round(min(1.0, total / float(x.counts.sum())), 6)


def rarity(docs: DataFrame) -> np.ndarray:
    """Ranks of the entropy bins, counted over all texts of (doc_id, text). Each task sends BINS + 1 rows."""
    schema = T.StructType([T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS + 1, np.int64)
        for batch in base.slices(batches):
            counts += bin_counts(*base.text_buffer(batch.column(0)))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=schema.names)

    counts = np.zeros(BINS + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, schema).groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS + 1 rows at most
        counts[r["bin"]] = r["n"]
    return ranks(counts)


def fingerprint(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint: one row per input row, without a shuffle. A null text counts as empty and has the empty fingerprint.

    Repeated rows have equal fingerprints, null ids are kept, other columns aren't read, an empty table gives none. Very long texts are
    looked at a segment at a time, with the same result. Only fingerprints under the same ranks compare.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(f) for f in fingerprints(*base.text_buffer(batch.column(1)), rank)], pa.string())], names=schema.names)

    return base.id_and_text(docs, id_col, text_col).mapInArrow(make, schema)


#: How results lie between two steps: digests and filters as bytes, which take half the room of their text.
_PACKED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_digest", T.BinaryType()),
        *(T.StructField(f"{x}_{y}", k) for x in ("own", "edited") for y, k in (("counts", T.ArrayType(T.IntegerType())), ("bits", T.BinaryType()))),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)
_KINDS = [to_arrow_type(f.dataType) for f in _PACKED]


def _unpacked(packed: DataFrame) -> DataFrame:
    """The contract's columns, with fingerprints as ``Fingerprint`` writes them."""
    size = BITS // 8
    told = lambda x: F.array_join(F.transform(f"{x}_counts", lambda n, i: F.concat(n.cast("string"), F.lit(":"), F.lower(F.hex(F.substring(F.col(f"{x}_bits"), i * size + 1, F.lit(size)))))), ".")
    return packed.select("doc_id", "n_chars", F.lower(F.hex("edited_digest")).alias("edited_sha256"), told("own").alias("fingerprint"), told("edited").alias("edited_fingerprint"), "near_edited", "near_next")


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many first code points of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return base.text_buffer(pa.array(texts, pa.large_string()))


def _compared(ids: list, texts: list[str], following: list[str], own: list[Fingerprint], next_: list[Fingerprint], rank: np.ndarray) -> list[pa.Array]:
    """Columns of _PACKED for documents and the texts that follow them."""
    other = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    made = fingerprints(*_buffer(other), rank)
    filters = [x for fs in (own, made) for x in ([f.counts.tolist() for f in fs], [f.bits.tobytes() for f in fs])]
    columns = [ids, [len(t) for t in texts], [hashlib.sha256(x.encode()).digest() for x in other], *filters, [likeness(a, b) for a, b in zip(own, made, strict=True)], [likeness(a, b) for a, b in zip(own, next_, strict=True)]]
    return [pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per input row.

    The next document is the one after it by descending doc_id (null last; rows that share an id by a hash of their texts; rows that are alike in
    both follow one another), after the last the first, so a single document follows itself. Null texts count as empty. Repeated rows
    give a row each, other columns aren't read, an empty table gives none. ``rank``: see ``rarity``, which is counted over
    all of ``docs`` where it isn't given. What reaches the driver is a count a bin and the numbers of the partitions.
    """
    spark = docs.sparkSession
    rows = base.id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rank = rarity(rows) if rank is None else rank
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("end", T.StringType()), T.StructField("text", T.StringType()), *_PACKED])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None

        def boundary(end: str, doc_id, text: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([end]), pa.array([text]), pa.array([doc_id], pa.int64()), *(pa.nulls(1, k) for k in _KINDS[1:])], names=schema.names)

        for batch in base.slices(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            made = fingerprints(*base.text_buffer(batch.column(1)), rank)
            if held is None:
                yield boundary("first", ids[0], texts[0])
            else:
                ids, texts, made = [held[0], *ids], [held[1], *texts], [held[2], *made]
            held = ids[-1], texts[-1], made[-1]
            if len(ids) > 1:
                columns = _compared(ids[:-1], texts[:-1], texts[1:], made[:-1], made[1:], rank)
                n = len(ids) - 1
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), *columns], names=schema.names)
        if held is not None:
            yield boundary("last", held[0], held[1])

    order = (F.desc_nulls_last("doc_id"), F.xxhash64("text"), "alike")  # the last spreads very many alike rows over tasks
    sorted_ = rows.withColumn("alike", F.rand(7)).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = base.materialise(sorted_.mapInArrow(walk, schema), "compared", compression="zstd")
    parts = sorted(r["part"] for r in found.where("end = 'first'").select("part").collect())  # a number a partition
    result = found.where("end is null").select(*_PACKED.names)
    if not parts:
        return _unpacked(result)
    follows = F.broadcast(spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int"))
    firsts = found.where("end = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    pairs = found.where("end = 'last'").select("part", "doc_id", "text").join(follows, "part").join(firsts, "next").select("doc_id", "text", "following")

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.slices(batches):
            ids, texts, following = (batch.column(i).to_pylist() for i in range(3))
            own, next_ = fingerprints(*_buffer(texts), rank), fingerprints(*_buffer(following), rank)
            yield pa.RecordBatch.from_arrays(_compared(ids, texts, following, own, next_, rank), names=_PACKED.names)

    return _unpacked(result.union(pairs.mapInArrow(join_ends, _PACKED)))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(base.documents(spark, sf_dir))
