"""Token counts, chunked BPE, token files and packing against the tokenizers library."""

import glob
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaystone.llm import bpe, chunk_reuse, packing, prefix_counts, token_files
from quaystone.llm.words import shingle_hashes, word_hashes

FRAGMENTS = ["a", "the", " ", "  ", "\n", "\n\n", "'", "'re", "'s", "'ll", "é", "日本", "1", "23", "!", "?!", "<|endoftext|>", "<|", "\t", "ß", " ", " ", "½", "_", "😀", " 'v", "ing", " tion", "\x1c", "\x85"]


@pytest.fixture(scope="module")
def engine():
    return bpe.load(bpe.default_path())


def library_ids(engine, text):
    return engine.library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(FRAGMENTS), max_size=14).map("".join))
def test_every_prefix_count(text):
    engine = bpe.load(bpe.default_path())
    changes = prefix_counts.prefix_changes(text, prefix_counts.PrefixTables(engine))
    assert [0, *np.cumsum(changes)] == [len(library_ids(engine, text[:k])) for k in range(len(text) + 1)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(FRAGMENTS), max_size=150).map("".join))
def test_chunks_agree_with_the_library(text):
    engine = bpe.load(bpe.default_path())
    raw = np.frombuffer(text.encode(), np.uint8)
    cuts = chunk_reuse.cut_places(raw, np.array([0, len(raw)]), mean=16, least=1)[0]
    ids = chunk_reuse.ChunkEncoder(engine).encode(text.encode(), cuts)
    assert ids.tolist() == library_ids(engine, text)
    assert chunk_reuse.Decoder(engine).text(ids.tolist()) == engine.library.decode(ids.tolist(), skip_special_tokens=False)


def test_safe_characters_split_as_the_library_does(engine):
    for c in map(chr, [*range(0x250), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2022, 0x2026, 0x20AC]):
        if prefix_counts._SAFE_ONLY.search(c) is None:
            text = f"a{c}b 1{c}2 !{c}? {c}{c} {c}a {c}1"
            assert prefix_counts._SPLIT.findall(text) == [text[s:e] for _, (s, e) in engine.library.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))


def test_fast_engine_is_used_and_agrees(engine):
    assert engine.core is not None
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x370, 0x1100), rng.randrange(0x3000, 0xD000), rng.randrange(0x10000, 0x11000)])) for _ in range(12))
        assert engine.encode(text).tolist() == library_ids(engine, text)


HAN = "".join(chr(0x4E00 + i * 7919 % 5000) + ("。" if i % 17 == 16 else "，" if i % 17 == 8 else "") for i in range(8000))
CYRILLIC = (lambda rng: " ".join("".join(chr(rng.randrange(0x430, 0x450)) for _ in range(rng.randrange(2, 9))) for _ in range(3000)))(random.Random(3))


@pytest.mark.parametrize("text", [" ".join(f"word{i * 7919 % 1000}" for i in range(2000)), HAN, CYRILLIC], ids=["latin", "han", "cyrillic"])
def test_copies_are_encoded_once(engine, text):
    """A second copy, in other surroundings, is encoded at its joins and in its first chunk alone."""
    encoder, encoded = chunk_reuse.ChunkEncoder(engine), []
    for around in ("", "Some other beginning. "):
        whole = (around + text).encode()
        before = encoder.encoded_bytes
        ids = encoder.encode(whole, chunk_reuse.cut_places(np.frombuffer(whole, np.uint8), np.array([0, len(whole)]))[0])
        assert ids.tolist() == library_ids(engine, around + text)
        encoded.append(encoder.encoded_bytes - before)
    assert encoded[1] < 0.2 * encoded[0] and encoder.reused_bytes > 0.8 * len(text.encode())


def test_text_without_anchors_is_not_counted_as_reused(engine):
    encoder, text = chunk_reuse.ChunkEncoder(engine), "".join(chr(0x4E00 + i * 7919 % 5000) for i in range(3000)).encode()
    for _ in range(2):
        encoder.encode(text, chunk_reuse.cut_places(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0])
    assert encoder.reused_bytes == 0 and encoder.encoded_bytes >= 2 * len(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*FRAGMENTS, "日", "。", "ка", "١", "́", "אב", "|", "<|endoftext|>a", "'t", "!'s"]), max_size=12).map("".join))
def test_pre_tokens_end_at_anchors(text):
    engine = bpe.load(bpe.default_path())
    encoder = chunk_reuse.ChunkEncoder(engine)
    raw = text.encode()
    for at in chunk_reuse.anchors(text, encoder.unsure):
        assert [*engine.encode(raw[:at].decode()), *engine.encode(raw[at:].decode())] == library_ids(engine, text)


def test_window_grows_until_both_sides_agree(engine):
    """Kept ids that don't hold at a join aren't used there."""
    encoder, text = chunk_reuse.ChunkEncoder(engine), "one two three four five six seven eight nine ten "
    raw = (text * 2).encode()
    encoder.encode(raw, np.array([len(text), 2 * len(text)]))
    kept = encoder.kept[text.encode()]
    kept.ids = kept.ids.copy()
    kept.ids[kept.marks[1] - 1] += 1  # the first segment, which is at the right of the join
    joined = encoder._join(raw, (0, kept), 0, (len(text), kept))
    assert joined[2] > 0 and joined[1].tolist() == library_ids(engine, raw[kept.anchors[-1] : len(text) + kept.anchors[joined[2]]].decode())


def test_token_counts(docs, none, engine, texts):
    got = prefix_counts.prefix_token_counts(docs).collect()
    want = Counter((t[0], len((t[1] or "").encode()), len(t[1] or ""), len(library_ids(engine, t[1]))) for t in texts)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_chars"], r["n_tokens"]) for r in got) == want
    assert prefix_counts.prefix_token_counts(none).count() == 0


def test_totals_come_from_the_recurrence(engine):
    """The encoder is asked about two tokens side by side, never about a pre-token."""
    tables, asked = prefix_counts.PrefixTables(engine), []

    class Listening:
        ranks, token_bytes, special, library = engine.ranks, engine.token_bytes, engine.special, engine.library

        def encode_piece(self, raw):
            asked.append(bytes(raw))
            return engine.encode_piece(raw)

    tables.engine = Listening()
    for word in ("internationalisation", " Donaudampfschifffahrt", "日本語のテキスト", "qqqqzzzzxxxxvvvv", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"):
        raw = word.encode()
        want = [0, *(len(engine.encode_piece(raw[:i])) for i in range(1, len(raw) + 1))] if word.isascii() else None
        counts = tables.byte_counts(raw)
        assert counts[-1] == len(engine.encode_piece(raw)) and (want is None or counts == want)
        assert raw not in asked or len(engine.encode_piece(raw)) <= 2
    assert asked and len(asked) == len(tables.stable) == len({k for k in tables.stable})
    assert all(any(a[:i] in engine.ranks and a[i:] in engine.ranks for i in range(1, len(a))) for a in asked)


def test_budgets_and_places(spark, docs, texts, engine):
    got = prefix_counts.prefix_token_counts(docs, budgets=(5, 1024), places=(0, 17), changes=False)
    assert got.columns == ["doc_id", "n_bytes", "n_chars", "n_tokens", "chars_within_5", "chars_within_1024", "tokens_in_first_0", "tokens_in_first_17"]
    want = Counter()
    for t in texts:
        text = t[1] or ""
        counts = np.append(0, np.cumsum(prefix_counts.prefix_changes(text, prefix_counts.PrefixTables(engine)))) if len(text) > 300 else [len(library_ids(engine, text[:k])) for k in range(len(text) + 1)]
        within = [max(i for i, c in enumerate(counts) if c <= b) if b < counts[-1] else len(text) for b in (5, 1024)]
        want[t[0], *within, 0, len(library_ids(engine, text[:17]))] += 1
    assert Counter((r["doc_id"], *r[4:]) for r in got.collect()) == want


def test_questions_about_prefixes(spark, engine):
    text = "The quick brown foxes' tails   were  red<|endoftext|>and blue."
    rows = prefix_counts.prefix_token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    for k in (0, 7, 30, len(text), 500):
        assert rows.select(prefix_counts.tokens_of_prefix("prefix_changes", F.lit(k))).first()[0] == len(library_ids(engine, text[:k]))
    for budget in (0, 3, 9, 100):
        k = rows.select(prefix_counts.longest_prefix("prefix_changes", F.lit(budget))).first()[0]
        assert k == max(i for i in range(len(text) + 1) if len(library_ids(engine, text[:i])) <= budget)


def test_encode_decode(docs, none, engine, texts):
    rows = chunk_reuse.encode_decode(docs).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in rows) == Counter((t[0], tuple(ids := library_ids(engine, t[1])), engine.library.decode(ids, skip_special_tokens=False)) for t in texts)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = chunk_reuse.digests(docs).collect()
    assert Counter(map(tuple, digests)) == Counter((t[0], len(ids := library_ids(engine, t[1])), sha(",".join(map(str, ids))), sha(t[1] or "")) for t in texts)
    assert chunk_reuse.encode_decode(none).count() == 0 and chunk_reuse.digests(none).count() == 0


def test_token_files(spark, docs, none, engine, texts, tmp_path):
    path = token_files.write_token_files(docs, str(tmp_path / "t"))
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((t[0] for t in texts), key=lambda i: -1 if i is None else i)
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter((t[0], (*library_ids(engine, t[1]), 2)) for t in texts)
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_files.token_checksums(spark, path).collect()}
    assert crc == {(r["doc_id"], r["start"]): zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows}
    assert "ids" not in token_files.read_token_files(spark, path).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1][:80]
    assert token_files.read_token_files(spark, token_files.write_token_files(none, str(tmp_path / "e"))).count() == 0


def test_token_file_layout(spark, docs, tmp_path, monkeypatch):
    """Delta-encoded integers, dictionary ids, several pages and row groups, and their indexes."""
    import pyarrow.parquet as pq

    monkeypatch.setitem(token_files.LAYOUT, "parquet.block.size", str(64 << 10))
    path = token_files.write_token_files(docs, str(tmp_path / "layout"))
    groups = 0
    for file in glob.glob(f"{path}/tokens/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        groups = max(groups, meta.num_row_groups)
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema.split(".")[0]: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
            assert "RLE_DICTIONARY" in columns["ids"].encodings or "DELTA_BINARY_PACKED" in columns["ids"].encodings
            assert any("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "start_in_block"))
    assert groups > 1


def check_packed(rows, texts, engine, capacity=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for t in texts:
        ids = np.array([*library_ids(engine, t[1]), 0], "<u4")
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(t[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    return len(by_sequence)


def test_packing(docs, none, engine, texts):
    rows = packing.pack(docs).collect()
    tokens = sum(len(library_ids(engine, t[1])) + 1 for t in texts)
    assert check_packed(rows, texts, engine) <= -(-tokens // 2048) + 1
    assert packing.pack(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plan_places_every_piece_once(lengths):
    counts = Counter(lengths)
    plan, used = packing.plan_sequences(counts, 64), Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 64 and times > 0
        used.update({v: times * n for v, n in Counter(pattern).items()})
    assert used == counts
    first_fit, bins = sorted(lengths, reverse=True), []
    for v in first_fit:
        place = next((i for i, b in enumerate(bins) if b >= v), None)
        if place is None:
            bins.append(64 - v)
        else:
            bins[place] -= v
    assert sum(n for _, n in plan) <= len(bins) + 1


def test_complements_fill_exactly():
    plan = packing.plan_sequences(Counter({2000: 3, 48: 1, 30: 5, 18: 5, 16: 9}), 2048)
    assert all(sum(p) == 2048 for p, _ in plan if 2000 in p)


def test_word_hashes_follow_the_words():
    texts = ["The  the\tTHE x", "", " a b ", "one"]
    raw = "".join(texts).encode()
    words, first = word_hashes(np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert first.tolist() == [0, 4, 4, 6, 7]
    assert len(set(words[:3].tolist())) == 1 and len(set(words.tolist())) == 5
    h, at = shingle_hashes(words, first, 3)
    assert at.tolist() == [0, 2, 2, 3, 4] and len(set(h.tolist())) == 4
