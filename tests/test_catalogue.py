import glob
import os

import duckdb
import pytest

from quaystone.plans import catalogue


def _rows(found, at):
    """Rows as text, in order; null is null, whatever its column's type."""
    return sorted(tuple("null" if r[i] is None else str(r[i]) for i in at) for r in found)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf), duck.sql(catalogue.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    found = _rows(got.collect(), [got.columns.index(c) for c in columns])
    assert found == _rows(want.fetchall(), [want.columns.index(c) for c in columns])
    assert found or name == "optional_filters"  # the smallest tables may have no such part


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
