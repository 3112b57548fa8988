from collections import Counter

import pyarrow as pa
import pytest

from quaystone.llm import base, registry


def test_least_hashes_do_not_depend_on_partitions(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    a = {r["doc_id"] for r in base.least_hashes(ids.repartition(7), 50, "doc_id").collect()}
    b = {r["doc_id"] for r in ids.orderBy(__import__("pyspark").sql.functions.xxhash64("doc_id")).limit(50).collect()}
    assert a == b and len(a) == 50
    assert base.least_hashes(ids.limit(60), 50, "doc_id").count() == 50
    assert base.least_hashes(ids.limit(0), 50, "doc_id").count() == 0


def test_slices_keep_all_rows_and_bound_the_text():
    texts = ["x" * n for n in (10, 0, 500, 3, 3, 1000, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(base.slices(iter([batch.slice(1), batch.slice(0, 0)]), most_bytes=100))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(1, 8))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 100 for p in parts)
    raw, offsets = base.text_buffer(batch.column(1).slice(2))
    assert len(raw) == 1507 and offsets.tolist() == [0, 500, 503, 506, 1506, 1507, 1507]


def test_materialise_reads_back_the_same(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "a long, b string")
    again = base.materialise(df, "t")
    assert again.schema == df.schema and sorted(map(tuple, again.collect())) == [(1, None), (2, "b")]
    assert base.materialise(df.limit(0), "t").count() == 0


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want, got = con.sql(registry.oracle_sql()[name]), registry.queries()[name](spark, sf)
    assert Counter(map(tuple, got.collect())) == Counter(want.select(*got.columns).fetchall())


def test_registry_has_one_query_each():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op1_packing", "op2_licenses", "op3_token_counts", "op5_language_id", "op6_lm_scoring", "op7_token_files", "op8_bpe", "op9_quality", "op10_jaccard", "op12_fingerprints", "op13_resampling"])
def test_queries_return_every_document(spark, sf, name):
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    rows = registry.queries()[name](spark, sf).select("doc_id").collect()
    assert {r["doc_id"] for r in rows} == ids and (name == "op1_packing" or len(rows) == len(ids))
