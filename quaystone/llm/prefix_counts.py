"""Token counts (3): prefix dynamic programming gives the exact token count of every prefix of every text.

Within a pre-token, BPE has the prefix property: the encoding of its first i bytes is the encoding of some shorter
prefix plus one last token, and that token is the only one whose junction with its predecessor is stable.
``count[i] = count[i - len(token)] + 1`` therefore runs over the bytes once. Each pre-token's table is kept
(bounded) and reused. What a text's prefix changes in the split itself is put right exactly: a white-space run that
now ends the text, a contraction cut in two, and a special string cut in two.

The result keeps, per text, the change of the count at each code point (16-bit); sums of them answer
"how many tokens has the prefix of k characters" and "the longest prefix within a budget" without re-encoding.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm import base, bpe

#: Characters on which this pattern and the library's agree (checked one by one in the tests); other texts are split by the library.
_SAFE_ONLY = re.compile("[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ–—‘’“”•…€]")
_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: The library's white space (Unicode's White_Space property; a fixed set).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES, _BLANK = re.compile(f"[{_SPACE}]{{2}}"), re.compile(f"[{_SPACE}]+")
#: Pre-tokens whose tables a worker keeps.
KEPT_TABLES = 400_000


class PrefixTables(dict):
    """pre-token -> 16-bit changes of the token count at each of its characters (little-endian bytes)."""

    def __init__(self, engine: bpe.ByteBpe):
        super().__init__()
        self.engine, self.ranks = engine, engine.ranks
        #: last three bytes -> lengths of the tokens that end so, longest first, then 2 and 1
        lengths: dict[bytes, set[int]] = {}
        for token in engine.ranks:
            if len(token) > 2:
                lengths.setdefault(token[-3:], set()).add(len(token))
        self.ending = {tail: (*sorted(found, reverse=True), 2, 1) for tail, found in lengths.items()}
        self.stable: dict[int, bool] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) > KEPT_TABLES:
            self.clear()
            self.stable.clear()
        raw = piece.encode()
        counts = self.byte_counts(raw)
        if len(raw) != len(piece):  # keep the counts where a character ends
            ends = [i for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]
            counts = [0, *(counts[i] for i in ends)]
        if piece[0] == "'" and len(piece) == 3 and piece in ("'re", "'ve", "'ll"):
            counts[2] = 2  # cut in two, it isn't a contraction: a quote and a letter
        value = struct.pack(f"<{len(counts) - 1}h", *map(sub, counts[1:], counts))
        if len(piece) < 256:
            self[piece] = value
        return value

    def byte_counts(self, raw: bytes) -> list[int]:
        """The token count of each byte prefix, 0 first, by the recurrence alone: the pre-token itself is never encoded.

        The library's encoder is asked about junctions of two tokens only, each pair once.
        """
        n, ranks, stable, ending = len(raw), self.ranks, self.stable, self.ending
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        for i in range(1, n + 1):
            for length in ending.get(raw[i - 3 : i] if i > 2 else b"", (2, 1)):
                j = i - length
                if j < 0 or (token := ranks.get(raw[j:i])) is None:
                    continue
                if j:
                    pair = last[j] << 32 | token
                    ok = stable.get(pair)
                    if ok is None:
                        ok = stable[pair] = self.engine.encode_piece(self.engine.token_bytes[last[j]] + raw[j:i]) == [last[j], token]
                    if not ok:
                        continue
                counts[i], last[i] = counts[j] + 1, token
                break
        return counts


def _pieces(text: str, engine: bpe.ByteBpe) -> list[str]:
    if _SAFE_ONLY.search(text) is None:
        return _SPLIT.findall(text)
    return [text[s:e] for _, (s, e) in engine.library.pre_tokenizer.pre_tokenize_str(text)]


def _plain_changes(text: str, tables: PrefixTables) -> np.ndarray:
    """Changes of the count at each character of a text without special strings."""
    pieces = _pieces(text, tables.engine)
    out = np.frombuffer(b"".join(map(tables.__getitem__, pieces)), "<i2")
    if _SPACES.search(text) is None:
        return out
    out, at = out.copy(), 0
    for before, piece in zip(pieces, pieces[1:], strict=False):
        at += len(before)
        if _BLANK.match(piece) and _BLANK.fullmatch(before):
            # the prefix that ends here has the run as one pre-token; from the next character on it is two
            apart = np.frombuffer(tables[before], "<i2").sum(dtype=int) + np.frombuffer(tables[piece], "<i2")[0]
            change = np.frombuffer(tables[before + piece[0]], "<i2").sum(dtype=int) - apart
            out[at] += change
            out[at + 1] -= change
    return out


def prefix_changes(text: str, tables: PrefixTables) -> np.ndarray:
    """Change of the token count at each character: entry k-1 takes the count from k-1 to k characters."""
    special = tables.engine.special
    if not any(s in text for s in special):
        return _plain_changes(text, tables)
    parts, pattern = [], re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
    at = 0
    for m in pattern.finditer(text):
        plain = _plain_changes(text[at : m.start()], tables)
        # a special string cut short is ordinary text, and joins the text before it
        begin = plain.sum(dtype=int)
        cut = [_plain_changes(text[at : m.start() + k], tables).sum(dtype=int) for k in range(1, len(m[0]))]
        parts += [plain, np.diff([begin, *cut, begin + 1]).astype("<i2")]
        at = m.end()
    return np.concatenate([*parts, _plain_changes(text[at:], tables)]).astype("<i2")


_tables: dict[str, PrefixTables] = {}


def prefix_token_counts(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", budgets: tuple[int, ...] = (), places: tuple[int, ...] = (), changes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens, chars_within_<budget>..., tokens_in_first_<place>..., prefix_changes (binary: little-endian 16-bit, one per code point).

    ``budgets``: the characters of the longest prefix of at most so many tokens; ``places``: the tokens of the prefix of so many characters (of
    the whole text, if it is shorter); both are read off the prefix table. ``changes``: with the column prefix_changes, which answers any such
    question later. One row per input row. A null or empty text has no bytes, tokens or changes; repeated rows and equal or null
    ids give a row each; an empty table gives none. Only the id and the text are read, so other columns can't clash.
    No shuffle: each partition is worked on where it is read.
    """
    path = tokenizer_path or bpe.default_path()
    longs = ["n_bytes", "n_chars", "n_tokens", *(f"chars_within_{b}" for b in budgets), *(f"tokens_in_first_{p}" for p in places)]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", *longs)] + [T.StructField("prefix_changes", T.BinaryType())] * changes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = bpe.load(path)
        tables = _tables.setdefault(path, PrefixTables(engine))
        for batch in base.slices(batches):
            texts = batch.column(1).fill_null("")
            _, offsets = base.text_buffer(texts)
            tabled = [prefix_changes(t, tables) for t in texts.to_pylist()]
            totals = [int(c.sum(dtype=np.int64)) for c in tabled]
            answers = [[longest_within(c, b) if n > b else len(c) for c, n in zip(tabled, totals, strict=True)] for b in budgets]
            answers += [[int(c[:p].sum(dtype=np.int64)) for c in tabled] for p in places]
            columns = [batch.column(0), pa.array(np.diff(offsets)), *(pa.array(x, pa.int64()) for x in ([len(c) for c in tabled], totals, *answers))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([c.tobytes() for c in tabled], pa.binary())] * changes, names=schema.names)

    return base.id_and_text(docs, id_col, text_col).mapInArrow(count, schema)


def longest_within(changes: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens (a longer prefix can have fewer tokens than a shorter one)."""
    counts = np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


@F.pandas_udf(T.LongType())
def tokens_of_prefix(changes, n_chars):
    """Tokens of the prefix of ``n_chars`` characters (of the whole text, if it is shorter), from ``prefix_changes``."""
    import pandas as pd

    return pd.Series([None if c is None or k is None else int(np.frombuffer(c, "<i2")[: int(k)].sum(dtype=np.int64)) for c, k in zip(changes, n_chars, strict=True)], dtype="Int64")


@F.pandas_udf(T.LongType())
def longest_prefix(changes, budget):
    """Characters of the longest prefix that has at most ``budget`` tokens, from ``prefix_changes``."""
    import pandas as pd

    return pd.Series([None if c is None or b is None else longest_within(np.frombuffer(c, "<i2"), int(b)) for c, b in zip(changes, budget, strict=True)], dtype="Int64")


def over_limit(n_tokens: Column, limit: int = 1024) -> Column:
    return n_tokens > limit


#: The query's limit, in tokens, and the place it counts the tokens up to, in characters.
LIMIT, PLACE = 1024, 1000


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_token_counts(base.documents(spark, sf_dir), budgets=(LIMIT,), places=(PLACE,), changes=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", over_limit(F.col("n_tokens"), LIMIT).alias("over_limit"), "n_chars", f"chars_within_{LIMIT}", f"tokens_in_first_{PLACE}")
