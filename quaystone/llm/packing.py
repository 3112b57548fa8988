"""Best-fit packing (1) by exact-complement hashing over the histogram of piece lengths.

Only lengths matter, and there are at most ``capacity`` of them, so the plan is made from their counts alone: for
the longest piece left, an index of single lengths, pair sums and triple sums finds one, two or three available
lengths that fill its gap exactly, and as many copies of that combination as the counts allow are consumed at
once. What no combination completes is placed by best fit, also in groups of equal sequences. The plan's size
is bounded by the capacity, not by the documents.

Pieces take their places by rank: a piece's rank among those of its length (a rank within its partition, written
with it, plus a prefix sum of the partitions' counts) falls into one interval of the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm import base, bpe

CAPACITY, END_ID = 2048, 0


class ComplementIndex:
    """Which available lengths, pairs and triples of them sum to a gap. Sums are bit sets; hits are checked against the counts."""

    def __init__(self, counts: dict[int, int]):
        self.counts = counts
        self._refresh()

    def _refresh(self) -> None:
        self.lengths = sorted((v for v, n in self.counts.items() if n > 0), reverse=True)
        self.single = sum(1 << v for v in self.lengths)
        self.pair = 0
        for v in self.lengths:
            self.pair |= self.single << v
        self.stale = False

    def _enough(self, pattern: tuple[int, ...]) -> bool:
        return all(self.counts.get(v, 0) >= n for v, n in Counter(pattern).items())

    def _pair(self, pattern: tuple[int, ...], gap: int) -> tuple[int, ...] | None:
        if not self.pair >> gap & 1:
            return None
        for v in self.lengths:
            if 2 * v < gap:
                break
            if v < gap and self.single >> (gap - v) & 1 and self._enough(found := (*pattern, v, gap - v)):
                return found
        return None

    def fill(self, length: int, gap: int) -> tuple[int, ...] | None:
        """The pattern (length, ...) that fills the gap exactly with one, two or three more; the longest partners first."""
        if self.stale:
            self._refresh()
        if self.single >> gap & 1 and self._enough(found := (length, gap)):
            return found
        if found := self._pair((length,), gap):
            return found
        for v in self.lengths:
            if 3 * v < gap:
                break
            if v < gap and (found := self._pair((length, v), gap - v)):
                return found
        return None

    def consume(self, pattern: tuple[int, ...]) -> int:
        need = Counter(pattern)
        times = min(self.counts[v] // n for v, n in need.items())
        for v, n in need.items():
            self.counts[v] -= n * times
            self.stale |= not self.counts[v]
        return times


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, number of such sequences), from the number of pieces of each length."""
    index, plan, rest = ComplementIndex(dict(counts)), [], {}
    for length in sorted(counts, reverse=True):
        while index.counts[length] > 0:
            found = (length,) if length == capacity else index.fill(length, capacity - length)
            if found is None:
                rest[length] = index.counts[length]
                index.counts[length] = 0
                index.stale = True
            else:
                plan.append((found, index.consume(found)))
    return plan + _best_fit(rest, capacity)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first; equal open sequences are one group."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in groups:
            groups[gap] = []
            insort(gaps, gap)
        groups[gap].append((pattern, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                pattern, times = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap], gaps[at]
            else:
                gap, pattern, times = capacity, (), left
            each = gap // length
            full = min(times, left // each)
            if full:
                put((*pattern, *[length] * each), full)
                left -= full * each
            if full < times and left and left < each:
                put((*pattern, *[length] * left), 1)
                full, left = full + 1, 0
            if full < times and pattern:
                put(pattern, times - full)
    return [x for found in groups.values() for x in found]


def _intervals(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 44 | first rank), and for each the first sequence and the offset."""
    taken: Counter = Counter()
    keys, sequences, offsets, sequence = [], [], [], 0
    for pattern, times in plan:
        at = 0
        for length in pattern:
            keys.append(length << 44 | taken[length])
            sequences.append(sequence)
            offsets.append(at)
            taken[length] += times
            at += length
        sequence += times
    order = np.argsort(np.array(keys, np.int64))
    return tuple(np.array(x, np.int64)[order] for x in (keys, sequences, offsets))


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and rank: the piece's place among those of its length in its partition."""
    path = tokenizer_path or bpe.default_path()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, part, seen = bpe.load(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for batch in base.slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist(), strict=True):
                ids = np.concatenate([engine.encode(text), end]).astype("<u4", copy=False)
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)] if len(ids) > capacity else [0]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b]), seen[b - a]))
                    seen[b - a] += 1
            ids_, *columns = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            *columns, rank = (pa.array(c, t) for c, t in zip(columns, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), *columns, pa.array(np.full(len(rows), part, np.int32)), rank], names=schema.names)

    return base.id_and_text(docs, id_col, text_col).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document's pieces, each in one place.

    A null or empty text is the end id alone. Each input row is packed, repeated rows and null ids too; which of
    equally long pieces takes which place is arbitrary. An empty table gives none. Other columns aren't read.
    """
    cut = base.materialise(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    per_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(_intervals(plan_sequences(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(starts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    schema = T.StructType([*cut.select("doc_id", "piece", "start", "length", "ids_crc32").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = plan.value
        for batch in batches:
            key = batch.column(3).to_numpy() << 44 | batch.column(5).to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])], names=schema.names)

    return ranked.mapInArrow(place, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(base.documents(spark, sf_dir))
