"""BPE encoding and decoding (8): content-defined chunks, each encoded once, with exact repair of the joins.

A rolling hash over a window of bytes cuts a text where the hash's low bits are zero, so that equal passages
give equal chunks wherever they stand. A worker encodes each chunk once (bounded memory) and reuses its ids for all
texts that it meets, in any task. A chunk's ids are split at *anchors*: places where a letter, number or other character is
followed by one of another kind (but for a letter after an apostrophe). There the library's pre-tokens always end,
whatever stands around, so the ids between a chunk's first and last anchor hold in any text. At a join, the window from the left
chunk's last anchor but one to the right chunk's second is encoded again. Where it doesn't begin and end with the chunks' own
ids of those outer segments, it grows by an anchor on the side that differs, until both sides agree exactly; a chunk
without two anchors is taken into the window whole, and if the anchors run out the text is encoded as a whole.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quaystone.llm import base, bpe
from quaystone.llm.words import _byte_values, _power_tables, mix

#: Bytes of the rolling window, the mean and least length of a chunk, and bytes of chunks that a worker keeps.
WINDOW, MEAN_BYTES, LEAST_BYTES, KEPT_BYTES = 32, 1024, 256, 48 << 20


def cut_places(raw: np.ndarray, offsets: np.ndarray, mean: int = MEAN_BYTES, least: int = LEAST_BYTES) -> list[np.ndarray]:
    """Per text, the places of its chunks' ends (the last is the text's length), always between two characters."""
    n = len(raw)
    if n >= WINDOW:
        up, down = _power_tables(n + 1)
        with np.errstate(over="ignore"):
            sums = np.empty(n + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_byte_values()[raw] * up[:n], out=sums[1:])
            rolled = mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: n - WINDOW + 1])
        found = np.flatnonzero(rolled & np.uint64(mean - 1) == 0) + WINDOW
        found = found[found < n]
        while (inside := raw[found] & 0xC0 == 0x80).any():  # move on to where a character begins
            found = found + inside
            found = found[found < n]
    else:
        found = np.zeros(0, np.int64)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        ends, last = [], a
        for f in found[np.searchsorted(found, a + WINDOW) : np.searchsorted(found, b)]:
            if f - last >= least:
                ends.append(f - a)
                last = f
        out.append(np.array([*ends, b - a], np.int64))
    return out


#: Kinds of characters. Those that aren't in Unicode 3.2, or beyond its first plane, are of no known kind: libraries may differ on them.
UNSURE, LETTER, NUMBER, OTHER, SPACE = range(5)


@lru_cache(1)
def _kinds() -> np.ndarray:
    kinds, old = np.zeros(0x110000, np.uint8), unicodedata.ucd_3_2_0
    for i in range(0x10000):
        now, before = unicodedata.category(chr(i)), old.category(chr(i))
        if now[0] == before[0] and now[0] != "C":
            kinds[i] = LETTER if now[0] == "L" else NUMBER if now[0] == "N" else SPACE if now[0] == "Z" else OTHER
    kinds[[*range(0x09, 0x0E), 0x85]] = SPACE
    return kinds


def anchors(chunk: str, unsure: str = "") -> np.ndarray:
    """Byte places in ``chunk`` where pre-tokens end in any surroundings. ``unsure``: characters next to which there is none."""
    points = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[points]
    if unsure:
        kinds = np.where(np.isin(points, np.frombuffer(unsure.encode("utf-32-le"), np.uint32)), np.uint8(UNSURE), kinds)
    left, right = kinds[:-1], kinds[1:]
    found = (left != right) & (left != UNSURE) & (right != UNSURE) & (left != SPACE) & ~((points[:-1] == ord("'")) & (right == LETTER))
    ends = np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))
    return ends[:-1][found]


@dataclass
class Chunk:
    ids: np.ndarray  # between the first and the last anchor
    anchors: np.ndarray  # byte places in the chunk
    marks: np.ndarray  # how many of the ids stand before each anchor

    def between(self, a: int, b: int) -> np.ndarray:
        return self.ids[self.marks[a] : self.marks[b]]


class ChunkEncoder:
    """Encodes texts by their chunks. ``encoded_bytes`` counts what an engine was given, ``reused_bytes`` what kept ids stand for."""

    def __init__(self, engine: bpe.ByteBpe):
        self.engine, self.kept, self.joins, self.size, self.joins_size = engine, {}, {}, 0, 0
        self.encoded_bytes = self.reused_bytes = 0
        self.lengths = np.zeros(1 + max([*engine.token_bytes, *engine.special.values()]), np.int64)
        for i, b in [*engine.token_bytes.items(), *((i, t.encode()) for t, i in engine.special.items())]:
            self.lengths[i] = len(b)
        # a change of kind within a special token's string is no anchor: it has one of these at its side
        self.unsure = "".join(sorted({c for t in engine.special for c in t if _kinds()[ord(c)] != LETTER}))

    def _ids(self, raw: bytes) -> np.ndarray:
        self.encoded_bytes += len(raw)
        return self.engine.encode(raw.decode())

    def chunk(self, raw: bytes) -> Chunk | None:
        """None without two anchors."""
        if raw in self.kept:
            value = self.kept[raw]
            self.reused_bytes += int(value.anchors[-1] - value.anchors[0]) if value else 0
            return value
        if self.size > KEPT_BYTES:
            self.kept.clear()
            self.size = 0
        at, value = anchors(raw.decode(), self.unsure), None
        if len(at) > 1:
            ids = self._ids(raw[at[0] : at[-1]])
            value = Chunk(ids, at, np.searchsorted(np.append(0, np.cumsum(self.lengths[ids])), at - at[0]))
        self.kept[raw] = value
        self.size += 200 + len(raw) + (value.ids.nbytes + 16 * len(at) if value else 0)
        return value

    def window(self, raw: bytes) -> np.ndarray:
        if len(raw) > 512:
            return self._ids(raw)
        ids = self.joins.get(raw)
        if ids is None:
            if self.joins_size > KEPT_BYTES // 4:
                self.joins.clear()
                self.joins_size = 0
            ids = self.joins[raw] = self._ids(raw)
            self.joins_size += 200 + len(raw) + ids.nbytes
        return ids

    def encode(self, raw: bytes, ends: np.ndarray) -> np.ndarray:
        """Ids of a text from its chunks, whose ends are given."""
        chunks = [(at, c) for at, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) if (c := self.chunk(raw[at:end]))]
        parts, left, taken = [], None, 0  # taken: the anchor of the left chunk up to which its ids are in parts
        for right in [*chunks, None]:
            found = self._join(raw, left, taken, right)
            if found is None:
                return self._ids(raw)
            own, middle, resumed = found
            parts += [own, middle]
            left, taken = right, resumed
        return np.concatenate(parts)

    def _join(self, raw: bytes, left, taken: int, right) -> tuple[np.ndarray, np.ndarray, int] | None:
        """(left's ids from ``taken`` on, the repaired ids, the anchor from which right's ids hold); None if no window agrees."""
        i, j = len(left[1].anchors) - 1 if left else 0, 0
        none = np.zeros(0, np.uint32)
        while True:
            before = left[1].between(i - 1, i) if left and i > taken else none
            after = right[1].between(j, j + 1) if right else none
            begin = left[0] + int(left[1].anchors[i - (i > taken)]) if left else 0
            end = right[0] + int(right[1].anchors[j + 1]) if right else len(raw)
            ids = self.window(raw[begin:end]) if begin < end else none
            starts, stops = np.array_equal(ids[: len(before)], before), np.array_equal(ids[len(ids) - len(after) :], after)
            if starts and stops and len(ids) >= len(before) + len(after):
                return left[1].between(taken, i) if left else none, ids[len(before) : len(ids) - len(after)], j
            if not starts or stops:
                i -= 1
            if not stops:
                j += 1
            if i < taken or (right and j + 1 >= len(right[1].anchors)):
                return None


class Decoder:
    """Ids to text as ``decode(ids, skip_special_tokens=False)`` gives it: bytes joined, invalid UTF-8 replaced."""

    def __init__(self, engine: bpe.ByteBpe):
        size = 1 + max([*engine.token_bytes, *engine.special.values()])
        table = [b""] * size
        for i, b in engine.token_bytes.items():
            table[i] = b
        for s, i in engine.special.items():
            table[i] = s.encode()
        self.of, self.decimal = table.__getitem__, [str(i) for i in range(size)].__getitem__

    def text(self, ids: list[int]) -> str:
        return b"".join(map(self.of, ids)).decode("utf-8", "replace")


_state: dict[str, tuple[ChunkEncoder, Decoder]] = {}
_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def _encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], Decoder]]:
    if path not in _state:
        engine = bpe.load(path)
        _state[path] = ChunkEncoder(engine), Decoder(engine)
    encoder, decoder = _state[path]
    for batch in base.slices(batches):
        raw, offsets = base.text_buffer(batch.column(1))
        whole = raw.tobytes()
        cuts = cut_places(raw, offsets)
        yield batch, [encoder.encode(whole[a:b], ends) for a, b, ends in zip(offsets[:-1], offsets[1:], cuts, strict=True)], decoder


def encode_decode(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), decoded (string).

    One row per input row, repeated rows and null ids included. A null text counts as empty: no ids, an empty text.
    An empty table gives none; other columns are not read and can't clash. No shuffle.
    """
    path = tokenizer_path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, decoder in _encoded(path, batches):
            first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(first, values), pa.array([decoder.text(x.tolist()) for x in ids], pa.string())], names=_SCHEMA.names)

    return base.id_and_text(docs, id_col, text_col).mapInArrow(run, _SCHEMA)


def digests(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_decode``, with digests in place of the ids and texts: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = tokenizer_path or bpe.default_path()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch, ids, decoder in _encoded(path, batches):
            lists = [x.tolist() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in lists], pa.int64()),
                    pa.array([sha(",".join(map(decoder.decimal, x)).encode()) for x in lists], pa.string()),
                    pa.array([sha(decoder.text(x).encode()) for x in lists], pa.string()),
                ],
                names=schema.names,
            )

    return base.id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(base.documents(spark, sf_dir)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


__all__ = ["ChunkEncoder", "Decoder", "anchors", "cut_places", "digests", "encode_decode", "op8_bpe"]
