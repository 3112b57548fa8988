"""Reports as a stream: new JSON-lines files, explicit schema, grouped counts by week of arrival with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.sources.schemas import REPORT_EVENT


def report_stream(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(REPORT_EVENT)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).json(folder)


def weekly_groups(reports: DataFrame, late: str = "14 days", threshold: int = 5) -> DataFrame:
    """Counts of reports that didn't go well by service, cause and seven-day window; later reports than ``late`` are left out."""
    bad = reports.where(~F.col("outcome").eqNullSafe("ok")).withWatermark("reported_at", late)
    grouped = bad.groupBy(F.window("reported_at", "7 days", startTime="4 days"), "service_id", "cause")  # windows begin on Mondays
    counted = grouped.agg(F.count("*").alias("count"), F.sum(F.coalesce(F.col("simulated"), F.lit(False)).cast("long")).alias("simulated"))
    return counted.select(F.col("window.start").alias("week_start"), "service_id", "cause", "count", "simulated", (F.col("count") >= threshold).alias("over_threshold"))


def rolling_groups(reports: DataFrame, weeks: int = 4, late: str = "14 days", threshold: int = 5) -> DataFrame:
    """The same counts over the ``weeks`` weeks that end with each week: sliding windows a week apart, as ``windows.rolling_groups`` has them in batch."""
    bad = reports.where(~F.col("outcome").eqNullSafe("ok") & F.col("reported_at").isNotNull()).withWatermark("reported_at", late)
    grouped = bad.groupBy(F.window("reported_at", f"{7 * weeks} days", "7 days", startTime="4 days"), "service_id", "cause")
    counted = grouped.agg(F.count("*").alias("count"), F.sum(F.coalesce(F.col("simulated"), F.lit(False)).cast("long")).alias("simulated"))
    return counted.select(F.date_sub(F.to_date("window.end"), 7).alias("week_start"), "service_id", "cause", "count", "simulated", (F.col("count") >= threshold).alias("over_threshold"))


def write_groups(groups: DataFrame, path: str, checkpoint: str):
    """Closed weeks, once each, as Parquet; processes what is there and stops."""
    return groups.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
