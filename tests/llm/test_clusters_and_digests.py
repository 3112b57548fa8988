"""Centroid clustering, document fingerprints and importance resampling, each by a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quaystone.llm import base, centroids, fingerprints, registry, resampling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Centroid clustering


def brute_kmeans(rows, k, rounds, dimensions, scale):
    """Python integers, every distance."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centre = [v for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for j in range(len(centre)):
            own = [v for (_, v), c in zip(kept, found, strict=True) if c == j]
            if own:
                centre[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(i, near(v)) for i, v in kept]
    total = Counter()
    for _, (d, j) in last:
        total[j] += d
    return sorted((str(i), j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, centre[j])).encode()).hexdigest()) for i, (d, j) in last)


def vectors(rng, n, d, spread):
    middles = rng.normal(0, 1, (5, d))
    return [(i, (middles[i % 5] * spread + rng.normal(0, 0.2, d)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_clusters_by_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    rows = vectors(rng, 300, 64, spread)
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 63 + [None]), (304, [0.5] * 63 + [float("nan")]), (305, [0.5] * 63 + [float("inf")]), (None, [0.25] * 64), (None, [-0.25] * 64), (7, [0.0] * 64), *[(400 + i, rows[0][1]) for i in range(40)], (5, rows[5][1]), (5, rows[5][1])]
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<float>, v string, cluster int, distance int").repartition(3)
    got = centroids.cluster(table)
    want = brute_kmeans([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 16, 3, 64, 64)
    assert sorted((str(r[0]), *r[1:6]) for r in got.collect()) == want
    share = got.first()["exact_share"]
    assert 1 / 16 <= share < 0.4


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(1, [0.1, -0.1]), (2, [0.1, -0.1]), (3, [5.0, 5.0])], schema)
    got = sorted(tuple(r)[:3] for r in centroids.cluster(few, dimensions=2, segment=2).collect())
    assert got == [(r[0], *r[1:3]) for r in [(int(i), j, d) for i, j, d, *_ in brute_kmeans([(1, [0.1, -0.1]), (2, [0.1, -0.1]), (3, [5.0, 5.0])], 16, 3, 2, 64)]]
    assert centroids.cluster(spark.createDataFrame([], schema)).count() == 0
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [1.0, 2.0])], schema)
    assert [r["vec_id"] for r in centroids.cluster(huge, dimensions=2, segment=2).collect()] == [2]
    with pytest.raises(ValueError):
        centroids.cluster(few, dimensions=2, segment=3)


def test_bounds_never_screen_out_the_nearest():
    rng = np.random.default_rng(9)
    for size in (1, 100, 2**26):
        v = rng.integers(-size, size + 1, (500, 64))
        v[100:200] = v[0] + rng.integers(-1, 2, (100, 64))  # nearly alike
        centre = v[rng.choice(500, 16, replace=False)]
        cluster, distance, n = centroids.assign(v, *centroids.compress(v), centre)
        every = ((v[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2)
        assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all() and 500 <= n <= 8000


# Fingerprints


def brute_bins(data):
    w = fingerprints.WIDTH
    top = 1 << 20
    weigh = lambda c: round(c * math.log2(c) * top / (w * math.log2(w)))
    return [(top - sum(weigh(c) for c in Counter(data[i : i + w]).values())) >> 10 for i in range(len(data) - w + 1)]


def brute_features(data, rank):
    """Places of the chosen windows of one text, from the definition."""
    r = [rank[b] for b in brute_bins(data)]
    if not r:
        return []
    votes, spans = Counter(), range(len(r) - fingerprints.SPAN + 1) if len(r) >= fingerprints.SPAN else [0]
    for s in spans:
        part = r[s : s + fingerprints.SPAN]
        votes[s + part.index(min(part))] += 1
    found = sorted(p for p, n in votes.items() if n >= fingerprints.VOTES)
    return found or [min(votes, key=lambda p: (-votes[p], p))]


def some_texts(texts):
    return [(t[1] or "").encode() for t in texts if len(t[1] or "") < 3000] + [b"x" * 400, b"ab" * 300, bytes(range(32)), b"0123456789" * 5]


def test_bins_and_features_by_brute_force(texts, monkeypatch):
    data = some_texts(texts)
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    whole = Counter(b for d in data for b in brute_bins(d))
    for segment in (fingerprints.SEGMENT, 150):  # texts that are longer than a segment give the same
        monkeypatch.setattr(fingerprints, "SEGMENT", segment)
        counts = fingerprints.bin_counts(raw, offsets)
        assert {i: n for i, n in enumerate(counts.tolist()) if n} == whole
        rank = fingerprints.ranks(counts)
        of, places = fingerprints.chosen(raw, offsets, rank)
        want = [(i, offsets[i] + p) for i, d in enumerate(data) for p in brute_features(d, rank)]
        assert list(zip(of.tolist(), places.tolist(), strict=True)) == want
    assert sorted(rank.tolist()) == list(range(fingerprints.BINS + 1)) and rank[: fingerprints.LEAST_BIN].min() > rank[fingerprints.LEAST_BIN :].max()


def test_filters_and_likeness(texts):
    data = [*some_texts(texts), b"short", b"", b"".join(hashlib.sha256(str(i).encode()).hexdigest().encode() for i in range(200))]
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    rank = fingerprints.ranks(fingerprints.bin_counts(raw, offsets))
    made = fingerprints.fingerprints(raw, offsets, rank)
    for d, f in zip(data, made, strict=True):
        places = brute_features(d, rank)
        distinct = list(dict.fromkeys(d[p : p + fingerprints.WIDTH] for p in places)) or ([d] if d else [])
        assert f.counts.tolist() == [len(distinct[i : i + fingerprints.FILL]) for i in range(0, len(distinct), fingerprints.FILL)]
        sizes = np.bitwise_count(f.bits).sum(axis=1)
        assert all(0 < s <= n * fingerprints.HASHES for s, n in zip(sizes, f.counts, strict=True))
        again = fingerprints.Fingerprint.parse(str(f))
        assert str(again) == str(f) and fingerprints.likeness(f, again) == 1.0
        alone = fingerprints.fingerprints(np.frombuffer(d, np.uint8), np.array([0, len(d)]), rank)[0]
        assert str(alone) == str(f)  # whatever stands beside it
    rng = random.Random(1)
    for _ in range(300):
        x, y = rng.choice(made), rng.choice(made)
        assert fingerprints.likeness(x, y) == fingerprints.likeness(y, x) and 0 <= fingerprints.likeness(x, y) <= 1
    assert len(made[-1].counts) > 2 and str(made[-2]) == "" and fingerprints.likeness(made[-2], made[-1]) == 0


def test_next_documents(spark, docs, texts, none):
    got = fingerprints.compare_with_next(docs).collect()
    assert len(got) == len(texts)
    order = sorted(((t[0] is not None, t[0] or 0, t[1] or "") for t in texts), key=lambda x: (x[0], x[1]), reverse=True)
    rank = fingerprints.rarity(base.id_and_text(docs))
    make = lambda t: fingerprints.fingerprints(*base.text_buffer(pa.array([t])), rank)[0]
    plain = {t[0] for t in texts if sum(u[0] == t[0] for u in texts) == 1}  # ids that occur once, and are followed by one that does
    by_id, checked = {r["doc_id"]: r for r in got}, 0
    for i, (named, doc_id, text) in enumerate(order):
        follows = order[(i + 1) % len(order)]
        if not named or doc_id not in plain or follows[1] not in plain or not follows[0]:
            continue
        half = len(text) // 2
        other = text[: len(text) - half] + follows[2][:half]
        r, own, changed, beside = by_id[doc_id], make(text), make(other), make(follows[2])
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), hashlib.sha256(other.encode()).hexdigest(), str(own), str(changed))
        assert (r["near_edited"], r["near_next"]) == (fingerprints.likeness(own, changed), fingerprints.likeness(own, beside))
        checked += 1
    assert checked > len(order) * 0.8
    first, last = by_id[order[0][1]], [r for r in got if r["doc_id"] is None]
    assert first["n_chars"] == len(order[0][2]) and len(last) == 2
    end = {hashlib.sha256((t[: len(t) - len(t) // 2] + f[: len(t) // 2]).encode()).hexdigest() for t in ("two words", "") for f in ("two words", "", order[0][2])}
    assert {r["edited_sha256"] for r in last} <= end  # the last is followed by the first
    alike = {}
    for r in got:
        alike.setdefault(r["fingerprint"], set()).add(r["n_chars"])
    assert {r["fingerprint"] for r in got if r["n_chars"] == 0} == {""}
    assert fingerprints.compare_with_next(none).count() == 0
    one = fingerprints.compare_with_next(spark.createDataFrame([(1, "Alone in the table.")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    made = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs, rank).collect()}
    assert all(made[r["doc_id"]] == r["fingerprint"] for r in got if r["doc_id"] in plain)


def test_many_alike_rows_spread(spark):
    rows = spark.range(3000).selectExpr("cast(7 as long) as doc_id", "repeat('the same again and again ', 20) as text")
    got = fingerprints.compare_with_next(rows)
    assert got.count() == 3000 and {(r["near_next"]) for r in got.select("near_next").distinct().collect()} == {1.0}


def test_edited_is_nearer_than_the_next(spark, sf):
    rows = registry.queries()["op12_fingerprints"](spark, sf).where("n_chars > 300").collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.97 * len(rows)
    assert 0.35 < np.mean([r["near_edited"] for r in rows]) < 0.7 and np.median([r["near_next"] for r in rows]) < 0.02


# Resampling

BETWEEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_resample(rows, target, buckets=10000, longest=1, percent=10, min_words=20, seed=2024):
    def found(text):
        w = BETWEEN.findall((text or "").translate(LOW))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(found(text)[1])
    for text in target:
        t.update(found(text)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for doc_id, text in rows:
        w, f = found(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(f), weight, score, None, len(w)])
    order = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = i + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10000, 10), (2, 97, 40), (3, 10000, 100), (1, 10000, 0)])
def test_resampling_by_brute_force(spark, docs, texts, longest, buckets, percent):
    target = ["The target Text of prose, and so on.", None, "", "été ça 日本語 été"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs, table, percent=percent, buckets=buckets, longest=longest)
    assert Counter(map(tuple, got.collect())) == brute_resample([t[:2] for t in texts], target, buckets, longest, percent)


def test_resampling_of_ties_and_nothing(spark, docs, texts, none):
    empty = spark.createDataFrame([], "text string")
    assert Counter(map(tuple, resampling.resample(docs, empty).collect())) == brute_resample([t[:2] for t in texts], [])
    assert resampling.resample(none, docs).count() == 0
    alike = spark.range(500).selectExpr("cast(null as long) as doc_id", "repeat('one two three ', 10) as text")
    got = resampling.resample(alike, empty).select("rank", "weight").collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 51)) and len({r["weight"] for r in got}) == 1


def test_literal_arrays_and_pushed_columns(spark, sf, capsys):
    """Scoring has no generator and no exchange."""
    arrays = spark.createDataFrame([(1, [0, 5, 5]), (2, [])], "doc_id long, buckets array<int>")
    scored = arrays.select("doc_id", resampling.weight("buckets", list(range(10))).alias("w"))
    assert {r["doc_id"]: r["w"] for r in scored.collect()} == {1: 10, 2: 0}
    scored.explain("formatted")
    said = capsys.readouterr().out
    assert "Generate" not in said and "Exchange" not in said and "split(" not in said
