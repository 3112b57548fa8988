"""Jaccard components, connected components and nearest neighbours by brute force; the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quaystone.llm import jaccard, neighbours, packing
from quaystone.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    """(doc_id, size, component) of each (doc_id, text)."""
    sets, parent = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    return Counter((d, len(sets[i]), min(least[root(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_edge_cases(docs, texts, none, k, percent):
    got = Counter(map(tuple, jaccard.jaccard_components(docs, k, percent).collect()))
    assert got == brute_components([t[:2] for t in texts], k, percent)
    assert jaccard.jaccard_components(none, k, percent).count() == 0


@pytest.mark.parametrize(("block", "nodes", "pivots"), [(jaccard.BLOCK_SHINGLES, jaccard.BLOCK_NODES, jaccard.PIVOTS), (900, 1000, 1), (jaccard.BLOCK_SHINGLES, 3, 2)])
def test_families_around_the_threshold(spark, monkeypatch, block, nodes, pivots):
    """Copies with few to many edits, chains, a passage that all share; also with blocks so small that clusters are cut up."""
    for name, value in (("BLOCK_SHINGLES", block), ("BLOCK_NODES", nodes), ("PIVOTS", pivots)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(8)
    passage, rows = [f"p{i}" for i in range(50)], []
    for family in range(6):
        origin = [f"f{family}w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(25):
            copy = list(origin)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows += [" ".join([*(f"o{rng.randrange(10**6)}" for _ in range(40)), *passage, *(f"o{rng.randrange(10**6)}" for _ in range(40))]) for _ in range(60)]
    rows += [" ".join(passage)] * 5
    chain = [f"c{i}" for i in range(80)]
    for i in range(12):
        rows.append(" ".join(chain[i : i + 60]))
    numbered = list(enumerate(rows))
    df = spark.createDataFrame(numbered, "doc_id long, text string").repartition(5)
    for k, percent in ((3, 90), (5, 80)):
        assert Counter(map(tuple, jaccard.jaccard_components(df, k, percent).collect())) == brute_components(numbered, k, percent)


def test_parts_lose_no_link():
    """Any pair over the threshold shares a signature."""
    rng = np.random.default_rng(2)
    classes, nothing = jaccard.Classes(80), np.zeros(jaccard.COMMON_BITS // 64, np.uint64)
    for common in (nothing, ~nothing):
        for _ in range(150):
            n = int(rng.integers(4, 120))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop, add = rng.integers(0, n // 5 + 1, 2)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            key, whose = jaccard.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), common, classes)
            assert set(key[whose == 0].tolist()) & set(key[whose == 1].tolist())


def test_connected_components(spark):
    rng, n = random.Random(4), 300
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(50, n), rng.randrange(50, n)) for _ in range(180)] + [(5, 5), (7, None)]
    parent = {i: i for i in range(n)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if b is not None and a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_nearest(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        s[i] = -np.inf
        order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_nearest_recall_and_order(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32))
    x = np.concatenate([centres[rng.integers(0, 12, 2400)] + 0.7 * rng.normal(size=(2400, 32)), np.tile(rng.normal(size=32), (300, 1))])
    ids = rng.permutation(len(x)).astype(np.int64)
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, part string")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got[r["query_id"]].append(r)
    want = brute_nearest(ids, x, 20)
    assert set(got) == set(want)
    hits, score = 0, {int(i): v for i, v in zip(ids, x, strict=True)}
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert rows == sorted(rows, key=lambda r: (-r["score"], r["vec_id"]))
        assert all(abs(r["score"] - (score[q] * score[r["vec_id"]]).sum()) < 1e-9 and r["vec_id"] != q for r in rows)
        hits += len({r["vec_id"] for r in rows} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def recall(spark, ids, x, k=20):
    """Recall of ``nearest``, whose rows are checked to be as many as there are candidates for."""
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=k).collect():
        got[r["query_id"]].append(r["vec_id"])
    want = brute_nearest(ids, x, k)
    assert {q: len(v) for q, v in got.items()} == {q: min(k, len(ids) - 1) for q in want if len(ids) > 1}
    return np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / len(want[q]) for q in want]) if len(ids) > 1 else 1.0


@pytest.mark.parametrize("n", [1, 2, 20, 21, 30, 60, 700, 3000])
@pytest.mark.parametrize("d", [8, 64])
def test_nearest_at_every_size(spark, n, d):
    """Vectors without any clusters, the hardest case."""
    x = np.random.default_rng(n + d).normal(size=(n, d))
    assert recall(spark, np.arange(n), x) >= 0.9


def test_nearest_in_two_levels(spark, monkeypatch):
    for name, value in (("LARGE_PART", 150), ("LEAF", 40), ("BLOCK", 64)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + 0.5 * rng.normal(size=(4000, 16))
    built = []
    monkeypatch.setattr(neighbours.Tree, "__post_init__", lambda self, f=neighbours.Tree.__post_init__: (f(self), built.append(self))[0])
    assert recall(spark, np.arange(4000), x) >= 0.9
    assert built[0].below and len(built[0].first) - 1 < built[0].first[-1]
    rows = x[:50]
    assert np.allclose(built[0].probabilities(rows).sum(axis=1), 1) and (built[0].leaf(rows) < built[0].first[-1]).all()


@pytest.mark.parametrize("n", [500, 2000, 20_000])
def test_clustered_vectors_are_routed_to_few_leaves(monkeypatch, n):
    """Under half of the vectors are opened at every size, with recall of 0.9 or more; a query opens no more than its probability and k + 1 ask for."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(max(10, n // 100), 64))[rng.integers(0, max(10, n // 100), n)] + 0.3 * rng.normal(size=(n, 64))
    tree = neighbours.Tree(neighbours.Router.fit(x[rng.permutation(n)[: neighbours.SAMPLE]], neighbours.part_count(n)), {})
    leaf = tree.leaf(x)
    held = np.bincount(leaf, minlength=int(tree.first[-1]))
    q = np.arange(0, n, 20)[:200]
    routes = tree.routes(x[q], neighbours.MASS, held, 21)
    score = x[q] @ x.T
    score[np.arange(len(q)), q] = -np.inf
    hits = [np.isin(leaf[np.argpartition(-s, 20)[:20]], r).mean() for s, r in zip(score, routes, strict=True)]
    opened = [held[r].sum() / n for r in routes]
    assert np.mean(hits) >= 0.9 and np.mean(opened) < 0.5
    assert all(held[r].sum() > 20 for r in routes)


def test_recall_on_the_given_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    assert recall(spark, ids, x) >= 0.9


def test_nearest_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (20, [2.0, 0.0]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("shared", [None, 7])
def test_rows_without_an_id_of_their_own(spark, monkeypatch, shared):
    """5,000 rows with null ids, or with one id: texts are written once a node, not once a pair of rows."""
    rng = random.Random(3)
    origin = [[f"w{rng.randrange(10**6)}" for _ in range(40)] for _ in range(50)]
    rows = []
    for i in range(5_000):
        words = list(origin[i % 50])
        if i % 3:
            words[rng.randrange(40)] = f"x{i % 600}"
        rows.append((shared, " ".join(words)))
    written, materialise = {}, jaccard.base.materialise

    def counted(df, name, **options):
        out = materialise(df, name, **options)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard.base, "materialise", counted)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 5, 80).collect()
    assert len(got) == 5_000 and {r["component_id"] for r in got} == {shared}
    assert written["texts"] == written["members"] <= len({t for _, t in rows})


def test_balanced_parts():
    x = np.random.default_rng(3).normal(size=(600, 16)).astype(np.float32)
    part = neighbours.balanced_parts(x, neighbours.neighbour_graph(x, 8), 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1.15 * 75) and part.min() >= 0


def test_pipeline_stages(spark, docs, texts, tmp_path):
    sf_dir = str(tmp_path)
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(t[0], 1) for t in texts if t[0] is not None and t[0] >= 10], "doc_id long, quality int").write.parquet(f"{sf_dir}/labels.parquet")
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf_dir)
        assert out.columns == docs.columns
        out.write.parquet(f"{sf_dir}/{name}")
        now = spark.read.parquet(f"{sf_dir}/{name}")
        left.append([tuple(r)[:2] for r in now.collect()])
    assert now.select("lang_pred", "tie").distinct().collect() == docs.select("lang_pred", "tie").distinct().collect()
    language, quality_, joined = left
    assert not any(t is None or not t.strip() for _, t in language) and len(language) >= 80
    assert all(len(WORD.findall(t)) >= 10 for _, t in quality_)
    groups = brute_components(quality_, 5, 80)
    assert Counter(d for d, _ in joined) == Counter(d for d, _, c in groups if d == c)
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    again = packing.pack(now).collect()
    key = lambda rows: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(packed) == key(again) and len(packed) >= len(joined)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "jaccard_join", "packing"]


def test_one_row_of_each_group_stays(spark):
    """Rows that share an id or have none are compared like others; extra columns stay."""
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join([*words[:59], "x"]), " ".join(reversed(words))
    rows = [(7, " ".join(words), "a"), (7, near, "b"), (9, near, "c"), (None, near, "d"), (3, other, "e"), (3, other, "e"), (None, "n " + other + " m", "f"), (None, "alone in the world", "g"), (5, None, "h"), (6, None, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tie string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), r["tie"]) for r in kept if r["doc_id"] != 7) == [("3", "e"), ("5", "h"), ("6", "i"), ("None", "g")]
    assert [r["tie"] in "ab" for r in kept if r["doc_id"] == 7] == [True]


def test_pipeline_without_rows(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
