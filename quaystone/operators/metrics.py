"""Panel and design metrics: who is in charge, approvals, key figures, rates, gaps, publication with small groups withheld."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.operators.summaries import percent


def service_bodies(services: DataFrame, bodies: DataFrame) -> DataFrame:
    """Each service with its body; an unknown body is null."""
    return services.select(F.col("id").alias("service_id"), "ente").join(bodies.select(F.col("id").alias("ente"), F.col("name").alias("body"), "role_it"), "ente", "left").select("service_id", "ente", "body", "role_it")


def approvals(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """Groups with ``approved`` from (service_id, cause, approved); undecided ones aren't."""
    return groups.drop("approved").join(decisions.select("service_id", "cause", "approved"), ["service_id", "cause"], "left").withColumn("approved", F.coalesce("approved", F.lit(False)))


def key_figure(table: DataFrame, key: str, value: str, column: str) -> DataFrame:
    """One figure of a summary table: ``column`` where ``key`` is ``value``."""
    return table.where(F.col(key) == value).select(F.lit(value).alias("key"), F.col(column).alias("figure"))


def trace_summary(trace: DataFrame) -> DataFrame:
    """(step, tool, output JSON): how much each step returned: items of an array, ``error``, or one object."""
    shape = F.when(F.get_json_object("output", "$.error").isNotNull(), F.lit("error")).when(F.ltrim("output").startswith("["), F.concat(F.json_array_length("output").cast("string"), F.lit(" items"))).otherwise(F.lit("1 object"))
    return trace.select("step", "tool", shape.alias("returned"))


def on_time_rate(cases: DataFrame, closed: str, due: str, *by: str) -> DataFrame:
    """Share of closed cases that were closed by their due date."""
    return cases.where(F.col(closed).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(closed) <= F.col(due)).cast("double")).alias("on_time_rate"))


def most_requested(reports: DataFrame, cause: str, n: int = 10) -> DataFrame:
    """Services with most reports of one cause, ties by service."""
    return reports.where(F.col("cause") == cause).groupBy("service_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "service_id").limit(n)


def avoided_cost(before_rate: Column, after_rate: Column, appointments: Column, slot_cost: Column) -> Column:
    """An estimate: appointments not wasted, times the cost of a slot; never negative."""
    return F.greatest(before_rate - after_rate, F.lit(0.0)) * appointments * slot_cost


def satisfaction(answers: DataFrame, score: str, *by: str) -> DataFrame:
    """Answers with a score, and their mean."""
    return answers.where(F.col(score).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(score).alias("satisfaction"))


def outcome_gap(answers: DataFrame, group: str, poor: Column, first: str, second: str) -> DataFrame:
    """Percentage of poor answers in two groups, and their difference in points."""
    rate = lambda g: percent(F.count_if(poor & (F.col(group) == g)), F.count_if(F.col(group) == g))
    return answers.agg(rate(first).alias("first_pct"), rate(second).alias("second_pct")).withColumn("gap", F.round(F.col("second_pct") - F.col("first_pct"), 1))


def published(events: DataFrame, by: list[str], day: str, threshold: int = 5) -> DataFrame:
    """Counts by month; groups under the threshold are withheld and exact days don't appear."""
    return events.groupBy(*by, F.trunc(day, "month").alias("month")).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
