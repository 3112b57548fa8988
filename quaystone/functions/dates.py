"""Dates: ISO weeks, ages, reminders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week(day: Column) -> Column:
    """``2026-W53``: the ISO year and week."""
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def is_stale(day: Column, as_of: Column, days: int = 90) -> Column:
    """More than ``days`` before ``as_of``; exactly ``days`` isn't."""
    return F.date_diff(as_of, day) > days


def reminders(day: Column, before: int = 3) -> Column:
    """Two reminders of an appointment: some days before it, and on the day."""
    return F.array(F.struct(F.lit("before").alias("kind"), F.date_sub(day, before).alias("day")), F.struct(F.lit("same-day").alias("kind"), day.cast("date").alias("day")))
