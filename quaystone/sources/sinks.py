"""Sinks: CSV, one JSON document, a JSON document a file, appended JSON lines, keyed update, page snapshots, calendars, report and exit code."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.sources.readers import with_ordinal
from quaystone.sources.shared import local_path


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, columns in the frame's order: a file for each partition, so that no task has to hold or send on the others' rows."""
    df.write.options(header=True, quote='"', escape='"').mode("overwrite").csv(path)


def write_json_array(df: DataFrame, path: str, *order: str) -> None:
    """One JSON array in the order given: part files that are it when read one after the other. Null fields are kept, characters aren't escaped.

    Rows are sorted by range and numbered by the counts of the ranges before theirs; none goes through the driver. ``order`` should tell rows
    apart. An empty table is an empty array.
    """
    numbered = with_ordinal(df.orderBy(*order))
    element = F.concat(F.when(F.col("ordinal") > 1, ",").otherwise(""), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    ends = df.sparkSession.createDataFrame([(0, "["), (2**62, "]")], "at long, value string")
    numbered.select(F.col("ordinal").cast("long").alias("at"), element.alias("value")).union(ends).orderBy("at").select("value").write.mode("overwrite").text(path)


def to_json_document(df: DataFrame, *order: str) -> str:
    """A small table as one indented JSON array; null fields are kept and characters aren't escaped."""
    rows = df.orderBy(*order) if order else df
    return json.dumps([json.loads(r["j"]) for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()], ensure_ascii=False, indent=2) + "\n"


#: Files a folder, about: each task of ``write_json_documents`` has a folder of its own.
FILES_A_FOLDER = 1000


def write_json_documents(df: DataFrame, path: str) -> None:
    """One JSON object a file, in a new folder: rows are dealt over tasks, each of which writes a subfolder. Read them with ``nested``.

    Subfolders are committed whole and listed by tasks, so the driver renames no file. In Hadoop's local file system each new file starts
    processes (``chmod`` of the file and of its checksums): on such a path the tasks write the files themselves. A task that is run again
    writes the same documents under the same names, and a file gets its name when it is whole.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-df.count() // FILES_A_FOLDER))
    dealt = df.repartition(tasks, F.xxhash64(F.to_json(F.struct(*df.columns))))
    root = local_path(spark, path)
    if root is None:
        dealt.withColumn("_folder", F.spark_partition_id()).write.option("maxRecordsPerFile", 1).partitionBy("_folder").json(path)
        return
    os.makedirs(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        folder, attempt = f"{root}/_folder={task.partitionId()}", task.taskAttemptId()
        for batch in batches:
            os.makedirs(folder, exist_ok=True)
            for text in batch.column(0).to_pylist():
                with open(f"{folder}/.{n:09d}-{attempt}", "w", encoding="utf-8", newline="") as f:
                    f.write(text + "\n")
                os.replace(f.name, f"{folder}/{n:09d}.json")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    texts = dealt.select(F.to_json(F.struct(*df.columns)).alias("text")).sortWithinPartitions("text")
    texts.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def update_rows(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of ``changes`` replaced in rows of equal key, nulls included. Write it to a new path."""
    new = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key))
    joined = df.join(new, df[key] == F.col("_key"), "left")
    there = F.col("_key").isNotNull()
    return joined.select(*(F.when(there, F.col(f"_new_{c}")).otherwise(df[c]).alias(c) if f"_new_{c}" in new.columns else df[c] for c in df.columns))


def page_snapshot(source_id: Column, url: Column, retrieved_at: Column, html: Column, text: Column) -> Column:
    """A saved page's text with its provenance on top: source, url, date and 16 digits of the page's SHA-256."""
    head = F.format_string("<!-- source: %s\n     url: %s\n     retrieved: %s\n     html sha256: %s -->\n\n", source_id, url, retrieved_at, F.substring(F.sha2(html, 256), 1, 16))
    return F.concat(head, text)


def calendar_document(uid: Column, day: Column, title: Column, details: Column, stamp: Column) -> Column:
    """An all-day iCalendar event: from ``day`` to the day after."""
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(";"), F.lit("\\;")), F.lit(","), F.lit("\\,")), F.lit("\n"), F.lit("\\n"))
    lines = [F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit("PRODID:-//quaystone//reminders//EN"), F.lit("BEGIN:VEVENT")]
    lines += [F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTAMP:"), F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'"))]
    lines += [F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd")), F.concat(F.lit("DTEND;VALUE=DATE:"), F.date_format(F.date_add(day, 1), "yyyyMMdd"))]
    lines += [F.concat(F.lit("SUMMARY:"), plain(title)), F.concat(F.lit("DESCRIPTION:"), plain(details)), F.lit("END:VEVENT"), F.lit("END:VCALENDAR"), F.lit("")]
    return F.array_join(F.array(*lines), "\r\n")


def report_lines(violations: DataFrame) -> DataFrame:
    """line: a printable line a violation, warnings first, in a range sort."""
    ordered = violations.orderBy(F.desc("severity"), "rule", "place", "message")
    return ordered.select(F.concat(F.rpad("severity", F.greatest(F.lit(5), F.length("severity")), F.lit(" ")), F.lit(" "), "place", F.lit(": "), "message").alias("line"))


def exit_code(violations: DataFrame) -> DataFrame:
    """One row: code is 1 if any violation is an error; and how many of each severity there are."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return violations.agg(F.coalesce(F.max((F.col("severity") == "ERROR").cast("int")), F.lit(0)).alias("code"), count("ERROR").alias("errors"), count("WARN").alias("warnings"))


def report(violations: DataFrame) -> tuple[list[str], int]:
    """The lines and the exit code of a check whose violations a person is to read: for few of them."""
    return [r["line"] for r in report_lines(violations).collect()], exit_code(violations).first()["code"]
