"""Approximate nearest neighbours (4) by learned partitions.

On a bounded sample: the graph of nearest neighbours by inner product is cut into balanced parts (seeded by spread-out
centres under a capacity, then refined by moving nodes to the part that most of their neighbours are in, where there is room).
A softmax classifier learns from each sampled vector where its neighbours lie. A part that holds many vectors of the table is cut
again in the same way, from a sample of its own and by its own classifier, so that leaves grow in number with the table, not only
in size. The classifiers assign every vector to its most probable leaf, and route a query to its most probable leaves until
they hold ``mass`` of the probability and more vectors than are asked for (or there is none left). Their vectors are ranked exactly, in
double precision.

Leaves are cut into blocks of bounded size, so one very common vector fills several tasks; a query meets each block of its leaves
once and keeps its best there, and the blocks' bests are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm import base

#: Vectors of the sample (those with the least hashes of their ids), and numbers in it at most.
SAMPLE, SAMPLE_NUMBERS = 10_000, 4_000_000
NEIGHBOURS, MASS, BLOCK = 12, 0.94, 16_384
#: Vectors of the table from which a part is cut again, about so many to a leaf, and leaves of a part at most.
LARGE_PART, LEAF, LEAVES = 65_536, 16_384, 64


def part_count(n: int) -> int:
    """Parts of the first level for n vectors: about sqrt(n)/4, a power of two from 4 to 256 (what the sample can teach)."""
    return int(2 ** np.clip(np.round(np.log2(max(1.0, np.sqrt(n) / 4))), 2, 8))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """(n, k) nearest others by inner product, in blocks."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int64)
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.15, seed: int = 7) -> np.ndarray:
    """A part for each node of the graph, no part with more than ``slack`` times the mean."""
    n, rng = len(x), np.random.default_rng(seed)
    room = int(np.ceil(slack * n / parts))
    centres = x[rng.choice(n, parts, replace=n < parts)]
    for _ in range(8):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    likeness = x @ centres.T
    part, used = np.full(n, -1), np.zeros(parts, np.int64)
    for i in np.argsort(-likeness.max(axis=1)):
        for p in np.argsort(-likeness[i]):
            if used[p] < room:
                part[i], used[p] = p, used[p] + 1
                break
    from_, to = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (from_, part[to]), 1)
        np.add.at(votes, (to, part[from_]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if used[best[i]] < room:
                used[part[i]] -= 1
                used[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if moved < n // 200:
            break
    return part


def fit_softmax(x: np.ndarray, target: np.ndarray, steps: int = 250, rate: float = 0.05, decay: float = 1e-5) -> np.ndarray:
    """Weights (d + 1, parts) of a softmax towards target distributions, by Adam on all rows."""
    xb = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    w = np.zeros((xb.shape[1], target.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = xb.T @ (_softmax(xb @ w) - target) / len(xb) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float64)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


@dataclass
class Router:
    weights: np.ndarray
    scale: float

    @classmethod
    def fit(cls, sample: np.ndarray, parts: int) -> Router:
        norms = np.linalg.norm(sample, axis=1)
        scale = float(np.median(norms)) if len(norms) else 1.0
        x = (sample / (scale or 1.0)).astype(np.float32)
        if len(x) < 4 * parts:
            return cls(np.zeros((x.shape[1] + 1, 1)), scale)  # one part: every query meets all
        graph = neighbour_graph(x, NEIGHBOURS)
        part = balanced_parts(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), graph, parts)
        target = np.zeros((len(x), parts), np.float32)
        np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0 / (graph.shape[1] + 1))
        target[np.arange(len(x)), part] += 1.0 / (graph.shape[1] + 1)
        return cls(fit_softmax(x, target), scale)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax((x / (self.scale or 1.0)) @ self.weights[:-1] + self.weights[-1])


@dataclass
class Tree:
    """Routers of one level or two: leaves are numbered part by part."""

    top: Router
    below: dict[int, Router]  # of parts that are cut again

    def __post_init__(self):
        parts = self.top.weights.shape[1]
        self.first = np.append(0, np.cumsum([self.below[p].weights.shape[1] if p in self.below else 1 for p in range(parts)]))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each leaf: its part's probability times its own in the part."""
        p = self.top.probabilities(x)
        if not self.below:
            return p
        return np.hstack([p[:, [i]] * self.below[i].probabilities(x) if i in self.below else p[:, [i]] for i in range(p.shape[1])])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The most probable leaf of the most probable part."""
        part = self.top.probabilities(x).argmax(axis=1)
        out = self.first[part]
        for i in np.unique(part):
            if i in self.below:
                out[part == i] += self.below[i].probabilities(x[part == i]).argmax(axis=1)
        return out

    def routes(self, x: np.ndarray, mass: float, held: np.ndarray, least: int) -> list[np.ndarray]:
        """Each query's most probable leaves, until they hold ``mass`` and ``least`` vectors. held: vectors of each leaf."""
        out = []
        for a in range(0, len(x), 100):
            p = self.probabilities(x[a : a + 100])
            order = np.argsort(-p, axis=1, kind="stable")
            p, n = np.take_along_axis(p, order, axis=1), held[order]
            opened = ((np.cumsum(p, axis=1) - p < mass) | (np.cumsum(n, axis=1) - n < least)).sum(axis=1)
            out += [o[:k] for o, k in zip(order, opened, strict=True)]
        return out


def usable(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best_of(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best others, ties to smaller ids. Scores don't depend on where a vector stands."""
    out: tuple[list, list, list] = ([], [], [])
    if not len(ids):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
    reach = np.linalg.norm(vectors, axis=1).max()
    step = max(1, 4_000_000 // len(ids))
    for a in range(0, len(query_ids), step):
        rough = queries[a : a + step] @ vectors.T
        rough[query_ids[a : a + step, None] == ids[None, :]] = -np.inf
        for q_id, q, row in zip(query_ids[a : a + step], queries[a : a + step], rough, strict=True):
            least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
            at = np.flatnonzero((row >= least - 1e-9 * reach * np.linalg.norm(q)) & (row > -np.inf))
            exact = np.zeros(len(at))
            for c, x in zip(q, vectors[at].T, strict=True):  # component by component, as a plain loop adds them
                exact += c * x
            order = np.lexsort((ids[at], -exact))[:k]
            out[0].append(np.full(len(order), q_id))
            out[1].append(ids[at][order])
            out[2].append(exact[order])
    return tuple(np.concatenate([*x, np.zeros(0, t)]).astype(t) for x, t in zip(out, (np.int64, np.int64, np.float64), strict=True))


def _second_level(rows: DataFrame, top: Router, n: int, most: int) -> dict[int, Router]:
    """Classifiers of the parts with more than LARGE_PART vectors, each fitted in a task on about ``most`` vectors of its part."""
    if n <= LARGE_PART or top.weights.shape[1] == 1:
        return {}
    schema = T.StructType([T.StructField("part", T.IntegerType()), *rows.schema.fields])
    router = rows.sparkSession.sparkContext.broadcast(top)

    def part(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(router.value.probabilities(_matrix(batch.column(1))).argmax(axis=1).astype(np.int32)), *batch.columns], names=schema.names)

    parted = rows.select("vec_id", "v").mapInArrow(part, schema)
    large = {r["part"]: r["n"] for r in parted.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > LARGE_PART).collect()}  # 256 at most
    if not large:
        return {}
    leaves = {p: int(2 ** np.clip(np.round(np.log2(c / LEAF)), 1, np.log2(LEAVES))) for p, c in large.items()}
    least = F.create_map(*(F.lit(x) for p, c in large.items() for x in (p, min(2**63 - 1, int(-(2**63) + min(1.0, most / c) * 2**64)))))
    sampled = parted.where(F.xxhash64("vec_id", F.lit(2)) <= least[F.col("part")])  # null, so none, for other parts

    def fit(vectors: pa.Table) -> pa.Table:
        p = vectors.column("part")[0].as_py()
        order = np.argsort(vectors.column("vec_id").to_numpy())  # the same whatever the partitions
        r = Router.fit(_matrix(vectors.column("v"))[order], leaves[p])
        return pa.table([pa.array([p], pa.int32()), pa.array([r.weights.shape[1]], pa.int32()), pa.array([r.scale]), pa.array([r.weights.astype(np.float32).tobytes()])], names=["part", "leaves", "scale", "weights"])

    fitted = sampled.groupBy("part").applyInArrow(fit, "part int, leaves int, scale double, weights binary").collect()
    return {r["part"]: Router(np.frombuffer(r["weights"], np.float32).reshape(-1, r["leaves"]).astype(np.float64), r["scale"]) for r in fitted}


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, mass: float = MASS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best found by inner product, ties to the smaller vec_id.

    ``is_query`` is a condition on the column vec_id. Null ids, and vectors that are null, empty, zero or hold null
    or non-finite components, take no part, nor do vectors of another than the most common length (on a tie the shorter).
    Rows that repeat a vec_id count once, with the least vector. A query gets fewer than k rows only if there are fewer candidates.
    Other columns aren't read; an empty table gives none. To the driver go the samples of the first level, the classifiers of the
    second (LEAVES times 256 columns at most) and a count a leaf.
    """
    spark = vectors.sparkSession
    base.small_batches(spark)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    repeated = rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    if not repeated.isEmpty():
        repeated = base.materialise(repeated, "repeated")
        once = rows.join(repeated, "vec_id", "left_anti").select("vec_id", "v")
        rows = base.materialise(once.union(rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))), "vectors")
    lengths = sorted(rows.groupBy(F.size("v").alias("d")).count().collect(), key=lambda r: (-r["count"], r["d"]))  # a row a length
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = lengths[0]["d"], lengths[0]["count"]
    rows = rows.where(F.size("v") == d)
    most = max(1, min(SAMPLE, SAMPLE_NUMBERS // d))
    sample = base.least_hashes(rows, most, "vec_id").select("v").toArrow()
    top = Router.fit(_matrix(sample.column(0)), part_count(n))
    tree = spark.sparkContext.broadcast(Tree(top, _second_level(rows, top, n, most)))

    placed_schema = T.StructType([T.StructField("leaf", T.IntegerType()), *rows.schema.fields])

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(tree.value.leaf(_matrix(batch.column(1))).astype(np.int32)), *batch.columns], names=placed_schema.names)

    placed = base.materialise(rows.select("vec_id", "v").mapInArrow(place, placed_schema), "placed")
    counted = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf
    held = np.array([counted.get(i, 0) for i in range(int(tree.value.first[-1]))])
    def route(batches):
        for batch in batches:
            if batch.num_rows:
                found = tree.value.routes(_matrix(batch.column(1)), mass, held, k + 1)
                take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int32)), *(c.take(take) for c in batch.columns)], names=placed_schema.names)

    blocks = F.broadcast(spark.createDataFrame([(i, -(-c // BLOCK)) for i, c in counted.items()], "leaf int, blocks int"))  # a row a leaf
    candidates = placed.join(blocks, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v")
    routed = rows.where(is_query).select("vec_id", "v").mapInArrow(route, placed_schema)
    queries = routed.join(blocks, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v")
    found_schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = best_of(left.column("vec_id").to_numpy(), _matrix(left.column("v")), right.column("vec_id").to_numpy(), _matrix(right.column("v")), k)
        return pa.table([pa.array(f) for f in found], names=found_schema.names)

    found = candidates.groupBy("leaf", "block").cogroup(queries.groupBy("leaf", "block")).applyInArrow(search, found_schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
