"""Centroid clustering (11) with block-norm screening: exact integer k-means that skips most exact distances.

A vector is compressed once: to a code of LEVELS levels a component, times the vector's own step, and to the norm of what the codes leave over in each
segment. The inner product of vector and centroid is that of code and centroid, plus that of the rest and the centroid, which by
Cauchy and Schwarz is at most the sum over segments of the two norms' products. So codes, norms and the centroids' segment norms bound each
squared distance from below. In a round a vector gets an exact distance to the centroid that its code is nearest to; only centroids whose
bound doesn't exceed it get one too. Distances are sums of 64-bit integers; bounds are lowered by more than their rounding error, so that
no nearest centroid is ever screened out.

A round sends the centroids to the tasks and a sum a cluster back from each; vectors never shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm import base

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
SEGMENT, LEVELS = 8, 31
#: Scaled components lie below this in size, so that a squared distance is below 2^63.
LARGEST = 2**27


def compress(v: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Codes (int8), and each vector's step followed by its segments' norms of v - step * code, rounded up (single precision)."""
    step = np.maximum(1, -(-2 * np.abs(v).max(axis=1, initial=0) // LEVELS))
    codes = np.floor_divide(2 * v + step[:, None], 2 * step[:, None])
    rest = (v - step[:, None] * codes).astype(np.float64).reshape(len(v), v.shape[1] // segment, segment)
    norms = np.sqrt((rest * rest).sum(axis=2)) * (1 + 1e-6)
    return codes.astype(np.int8), np.concatenate([step[:, None], norms], axis=1).astype(np.float32)


def assign(v: np.ndarray, codes: np.ndarray, short: np.ndarray, centroids: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (ties to the smaller number), its squared distance, and how many exact distances that took.

    v: integers; codes, short: ``compress(v)``; centroids: integers.
    """
    n, k = len(v), len(centroids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    c = centroids.astype(np.float64)
    parts = c.reshape(k, -1, segment)
    norms_c, size_c = np.sqrt((parts * parts).sum(axis=2)) * (1 + 1e-9), (c * c).sum(axis=1)
    size = (v.astype(np.float64) ** 2).sum(axis=1)
    step, norms = np.round(short[:, :1].astype(np.float64)), short[:, 1:].astype(np.float64)
    near_by = size[:, None] + size_c[None, :] - 2.0 * step * (codes.astype(np.float64) @ c.T)
    bound = near_by - 2.0 * (norms @ norms_c.T) - 1e-9 * (size[:, None] + size_c[None, :]) - 1e-3
    exact = lambda rows, which: ((v[rows] - centroids[which]) ** 2).sum(axis=1)
    first = near_by.argmin(axis=1)
    distance = np.full((n, k), np.iinfo(np.int64).max)
    every = np.arange(n)
    distance[every, first] = near = exact(every, first)
    open_ = bound <= near[:, None]
    open_[every, first] = False
    rows, which = np.nonzero(open_)
    for a in range(0, len(rows), 1 << 14):  # bounded memory
        some = slice(a, a + (1 << 14))
        distance[rows[some], which[some]] = exact(rows[some], which[some])
    cluster = distance.argmin(axis=1)
    return cluster, distance[every, cluster], n + len(rows)


def _vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def prepare(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, segment: int = SEGMENT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (integers floor(scale x)), codes, short (its compressed form): rows whose vector can be clustered."""
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("codes", T.ArrayType(T.ByteType())), T.StructField("short", T.ArrayType(T.FloatType()))])
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("x")).where(F.size("x") == dimensions)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1), dimensions)  # nulls are NaN
            with np.errstate(invalid="ignore", over="ignore"):
                v = np.floor(scale * x)
                fit = np.isfinite(x).all(axis=1) & (np.abs(v) < LARGEST).all(axis=1)
            v = v[fit].astype(np.int64)
            lists = lambda m, kind: pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.astype(kind).ravel()))
            codes, short = compress(v, segment)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fit)), lists(v, np.int32), lists(codes, np.int8), lists(short, np.float32)], names=schema.names)

    return rows.mapInArrow(scaled, schema)


def first_centroids(prepared: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the least sha256 of ``seed:vec_id``; on a tie (rows that share an id) the lesser vector."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = prepared.select(named.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()  # ``clusters`` rows
    return np.array([r["v"] for r in rows], np.int64)


def new_centroids(prepared: DataFrame, centroids: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors; an empty cluster's centroid stays. Each task sends a row a cluster."""
    k, d = centroids.shape
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    sent = prepared.sparkSession.sparkContext.broadcast(centroids)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = _vectors(batch.column(0), d).astype(np.int64)
                cluster, _, _ = assign(v, _vectors(batch.column(1), d), _vectors(batch.column(2), 1 + d // segment), sent.value, segment)
                n += np.bincount(cluster, minlength=k)
                order = np.argsort(cluster, kind="stable")
                there, at = np.unique(cluster[order], return_index=True)
                sums[there] += np.add.reduceat(v[order], at, axis=0)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * d, pa.array(sums[some].ravel()))], names=schema.names)

    found = prepared.select("v", "codes", "short").mapInArrow(summed, schema)
    parts = found.select("cluster", "n", F.posexplode("sums").alias("i", "part"))
    totals = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()  # k d rows
    out = centroids.copy()
    for r in totals:
        out[r["cluster"], r["i"]] = int(r["total"]) // r["n"]
    return out


def assigned(prepared: DataFrame, centroids: np.ndarray, segment: int = SEGMENT) -> DataFrame:
    """vec_id, cluster, distance, n_exact: the nearest centroid, and (on a batch's first row) the exact distances that the batch took."""
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("n_exact", T.LongType())])
    sent = prepared.sparkSession.sparkContext.broadcast(centroids)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = sent.value.shape[1]
                v = _vectors(batch.column(1), d).astype(np.int64)
                cluster, distance, n_exact = assign(v, _vectors(batch.column(2), d), _vectors(batch.column(3), 1 + d // segment), sent.value, segment)
                took = np.zeros(len(v), np.int64)
                took[0] = n_exact
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(took)], names=schema.names)

    return prepared.select("vec_id", "v", "codes", "short").mapInArrow(near, schema)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, segment: int = SEGMENT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, exact_share: one row per vector that takes part.

    Null vectors, vectors of another length than ``dimensions`` or with null or non-finite components take no part, nor do those with a
    component of LARGEST / scale or more, whose squared distances needn't fit 64 bits. A null vec_id counts as the empty text where ids are
    hashed; rows that share an id, and repeated rows, each take part. Ties go to the smaller cluster. With fewer vectors than ``clusters``
    there are as many clusters as vectors; an empty table gives no rows. Other columns aren't read. exact_share: exact distances of the last
    assignment, divided by all pairs of a vector and a centroid. To the driver go the centroids and a sum a cluster.
    """
    spark = vectors.sparkSession
    if dimensions % segment:
        raise ValueError("segments must divide the vector")
    prepared = base.materialise(prepare(vectors, dimensions, scale, segment, id_col, vector_col), "prepared")
    centroids = first_centroids(prepared, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, exact_share double")
    for _ in range(rounds):
        centroids = new_centroids(prepared, centroids, segment)
    found = base.materialise(assigned(prepared, centroids, segment), "assigned")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("d"), F.count("*").alias("n"), F.sum("n_exact").alias("e")).collect()  # a row a cluster
    inertia, pairs = sum(r["d"] for r in sums), len(centroids) * sum(r["n"] for r in sums)
    share = sum(r["e"] for r in sums) / pairs
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    about = spark.createDataFrame([(r["cluster"], r["d"], inertia, digest(centroids[r["cluster"]]), share) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, exact_share double")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "exact_share")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("exact_share")


def _sql() -> str:
    """The rounds as common table expressions: a row a vector and centroid, then a row a cluster and component."""
    distance = "list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k, v AS c FROM v ORDER BY k LIMIT {CLUSTERS})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT row, first(vec_id) AS vec_id, first(v) AS v, min((d, k)) AS best FROM (SELECT v.row, v.vec_id, v.v, c.k, {distance}::BIGINT AS d FROM v, c{r} c) GROUP BY row)")
        if r < ROUNDS:
            parts.append(f"m{r} AS (SELECT k, list(floor_sum ORDER BY i) AS c FROM (SELECT best[2] AS k, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum FROM a{r}, range(1, {DIMENSIONS + 1}) t(i) GROUP BY 1, 2) GROUP BY k)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c)::BIGINT[] AS c FROM c{r} LEFT JOIN m{r} ON c{r}.k = m{r}.k)")
    last = ROUNDS
    return "WITH " + ",\n ".join(parts) + f"""
 SELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} ON k = best[2]"""


SQL = _sql()
