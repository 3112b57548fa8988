"""The log of reports as a stream: notes are classified and dropped in flight, repeats left out, and each batch is written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.operators.reports import Classifier, classify, rule_classifier

#: What arrives: an id that the sender sets (a repeat has the same), what happened, the note as written, and when.
NOTE_EVENT = T.StructType([T.StructField(n, k) for n, k in (("report_id", T.StringType()), ("service_id", T.StringType()), ("outcome", T.StringType()), ("note", T.StringType()), ("reported_at", T.TimestampType()))])


def note_stream(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(NOTE_EVENT)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).json(folder)


def classified(notes: DataFrame, late: str = "14 days", classifier: Classifier = rule_classifier) -> DataFrame:
    """report_id, reported_at and a report's columns: each report once, without its note.

    A report that repeats an id within ``late`` of event time is left out, and so is one later than the watermark or without a time. The note is
    a column of nothing that comes after the classifier; the state of the repeats holds ids alone.
    """
    once = notes.where("reported_at is not null").withWatermark("reported_at", late)
    ids = once.select("report_id", "service_id", "outcome", "note", "reported_at", F.to_date("reported_at").alias("day"))
    told = classify(ids, classifier, keep=("report_id", "reported_at"))
    return told.dropDuplicatesWithinWatermark(["report_id"])


def write_once(path: str):
    """A sink for ``foreachBatch``: a batch's rows go into a folder named by its number, which a replay replaces. Readers see ``batch`` as a column."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/batch={number}")

    return write


def append_log(reports: DataFrame, path: str, checkpoint: str):
    """Start the log: processes what is there and stops. A batch that ran before a failure was noted is written again in its own place."""
    return reports.writeStream.foreachBatch(write_once(path)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
