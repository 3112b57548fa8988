"""Token-ID output (7): Parquet list columns that can be read selectively.

Documents are range-partitioned by id (ties are split by a hash of the text), encoded where they land, and written
in ascending order by Spark's own Parquet writer: ids are list<int> with dictionary encoding, the integer columns
delta-encoded (format version 2), row groups of a set size, and column and offset indexes by page, so that a reader
of a few ids or of the metadata alone skips the other pages and columns. ``start`` is a two-level prefix sum: within
a block (file) it is written in the row, and the blocks' own starts are a small index beside the tokens.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm import base, bpe

#: Parquet settings of the token files.
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write ``path``/tokens (doc_id, block, start_in_block, n_tokens, ids) and ``path``/index (block, n_docs, n_tokens, start).

    A null text is empty: its ids are the end id alone. Null doc_ids come first; rows that share a doc_id stand
    side by side in an order fixed by their texts, and each repeated row is written. An empty table gives empty files.
    """
    tokenizer_path = tokenizer_path or bpe.default_path()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("start_in_block", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, block, before = bpe.load(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        for batch in base.slices(batches):
            ids = [x for t in batch.column(1).fill_null("").to_pylist() for x in (engine.encode(t), end)]
            lengths = np.array([len(x) for x in ids], np.int64).reshape(-1, 2).sum(axis=1)
            first = np.concatenate([[0], np.cumsum(lengths)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(lengths), block, np.int32)), pa.array(before + first[:-1]), pa.array(lengths), pa.ListArray.from_arrays(first.astype(np.int32), np.concatenate(ids).astype(np.int32))], names=schema.names)
            before += int(first[-1])

    tie = F.xxhash64("text")
    ordered = base.id_and_text(docs, id_col, text_col).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(encode, schema).write.options(**LAYOUT).parquet(f"{path}/tokens")
    spark = docs.sparkSession
    blocks = spark.read.schema(schema).parquet(f"{path}/tokens").groupBy("block").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    blocks.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).coalesce(1).write.parquet(f"{path}/index")
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids. Columns not selected and pages ruled out by a filter on doc_id are not read."""
    index = spark.read.parquet(f"{path}/index").select("block", F.col("start").alias("block_start"))
    tokens = spark.read.parquet(f"{path}/tokens")
    return tokens.join(index, "block").select("doc_id", (F.col("block_start") + F.col("start_in_block")).alias("start"), "n_tokens", "ids")


def token_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all read from the files; ids meet no shuffle."""
    base.small_batches(spark)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("start_in_block", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=schema.names)

    tokens = spark.read.parquet(f"{path}/tokens").select("doc_id", "block", "start_in_block", "n_tokens", "ids")
    index = spark.read.parquet(f"{path}/index").select("block", F.col("start").alias("block_start"))
    return tokens.mapInArrow(checksum, schema).join(index, "block").select("doc_id", (F.col("block_start") + F.col("start_in_block")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_files(base.documents(spark, sf_dir), f"{base.shared_dir(spark)}/quaystone/{uuid.uuid4().hex}")
    return token_checksums(spark, path)
