"""Shared plumbing of the training-data operators: shared storage, column clashes, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set once a session without ``spark.checkpoint.dir`` has been given a folder (local masters only).
_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Unset: a temporary folder on a local master, an error elsewhere."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN_DIR.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="quaystone-"))


def new_folder(spark: SparkSession) -> str:
    """A new folder's path in the shared directory."""
    return f"{shared_dir(spark)}/quaystone/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def removed(spark: SparkSession, path: str) -> None:
    """Remove what nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into a new folder of the shared directory and read it back."""
    return written(df, f"{new_folder(df.sparkSession)}/{name}", **options)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows hold whole texts or lists of ids, so Arrow batches of 10,000 rows (Spark's default) would be large: take 1,000, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names: extra columns can't clash."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, concatenated, and the n+1 offsets into them. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most_bytes`` of text at most (a longer single text stands alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def least_hashes(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows (all, if fewer) with the least hashes of ``keys``: a sample that doesn't depend on the partitions.

    A bound on the hash, from a count, lets about 1.5 n rows through first, so that partitions don't send n rows each. Keys that
    repeat very often can leave fewer than n.
    """
    h, total = F.xxhash64(*keys), df.count()
    if total > 2 * n:
        df = df.where(h < int(-(2**63) + 2**64 * 1.5 * n / total))
    return df.orderBy(h, *keys).limit(n)


def fold_of(doc_id: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds
