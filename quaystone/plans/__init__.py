"""The query catalogue over the parquet tables, with SQL for each."""
