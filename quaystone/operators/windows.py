"""Windows over weeks and times: rolling weekly groups, runs of consecutive weeks, totals and gaps of keys that very many rows share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


THRESHOLD = 5


def week_number(day: Column) -> Column:
    """Weeks since the one of Monday, 5 January 1970: consecutive weeks have consecutive numbers, whatever the year."""
    return F.floor(F.date_diff(day, F.lit("1970-01-05").cast("date")) / 7).cast("int")


def week_start(number: Column) -> Column:
    """The Monday of a week number."""
    return F.date_add(F.lit("1970-01-05").cast("date"), (number * 7).cast("int"))


def rolling_groups(reports: DataFrame, day: str, weeks: int = 4, threshold: int = THRESHOLD, by: tuple[str, ...] = ("service_id", "cause")) -> DataFrame:
    """week_start, by..., count, simulated, over_threshold: reports that didn't go well in the ``weeks`` weeks that end with each week.

    Weeks in which a group has no report of its own, but one in its last ``weeks`` weeks, have a row too, so that a sliding window of a stream
    gives the same rows. Reports are counted by week before anything else: the frame runs over a row a week, however many
    reports a group has. Null keys are groups; reports without a day are left out; a null outcome isn't ``ok``.
    """
    bad = reports.where(~F.col("outcome").eqNullSafe("ok") & F.col(day).isNotNull())
    weekly = bad.groupBy(*by, week_number(F.to_date(day)).alias("week")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("simulated"), F.lit(False)).cast("long")).alias("s"))
    ahead = weekly.select(*by, F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias("later"), "week", "n", "s")
    zero = F.lit(0).cast("long")
    every = ahead.groupBy(*by, (F.col("week") + F.col("later")).alias("week")).agg(*(F.sum(F.when(F.col("later") == 0, F.col(c)).otherwise(zero)).alias(c) for c in ("n", "s")))
    frame = Window.partitionBy(*by).orderBy("week").rangeBetween(-(weeks - 1), 0)
    summed = every.select("week", *by, F.sum("n").over(frame).alias("count"), F.sum("s").over(frame).alias("simulated"))
    return summed.select(week_start(F.col("week")).alias("week_start"), *by, "count", "simulated", (F.col("count") >= threshold).alias("over_threshold"))


def first_crossings(rolling: DataFrame, *by: str) -> DataFrame:
    """by..., week_start: the first week in which a group is over the threshold."""
    return rolling.where("over_threshold").groupBy(*by).agg(F.min("week_start").alias("week_start"))


def runs(df: DataFrame, by: list[str], at: str, largest_gap: int = 1, slice_width: int = 512) -> DataFrame:
    """by..., first, last, n_rows, n_places: maximal runs of rows whose neighbours in ``at`` (an integer) are at most ``largest_gap`` apart.

    Rows are first counted by place, then cut into slices of ``slice_width`` places; runs are found within a slice and stitched
    where one ends and the next begins at most ``largest_gap`` later. So a key with a third of all rows is spread over as many tasks as it
    has slices, and the stitching sees a row a run and slice. Rows whose ``at`` is null are left out; null keys are keys.
    """
    if largest_gap >= slice_width:
        raise ValueError("a slice must be wider than the largest gap")
    places = df.where(F.col(at).isNotNull()).groupBy(*by, F.col(at).cast("long").alias("_at")).agg(F.count("*").alias("_n"))
    return _joined_runs(_joined_runs(places.select(*by, F.floor(F.col("_at") / slice_width).alias("_slice"), F.col("_at").alias("first"), F.col("_at").alias("last"), F.col("_n").alias("n_rows"), F.lit(1).cast("long").alias("n_places")), [*by, "_slice"], largest_gap).drop("_slice"), by, largest_gap)


def _joined_runs(pieces: DataFrame, by: list[str], largest_gap: int) -> DataFrame:
    """Pieces (first, last, n_rows, n_places) that follow each other closely enough are one."""
    order = Window.partitionBy(*by).orderBy("first")
    starts = F.coalesce(F.col("first") - F.lag("last").over(order) > largest_gap, F.lit(True)).cast("int")
    numbered = pieces.withColumn("_new", starts).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy(*by, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n_rows").alias("n_rows"), F.sum("n_places").alias("n_places"))
    return joined.drop("_run")


def sliced(df: DataFrame, by: list[str], order: str, slices: int) -> DataFrame:
    """Adds ``_slice``: the table's range of the number ``order`` cut into ``slices`` equal parts. One pass finds its ends."""
    ends = df.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    if ends["a"] is None or ends["a"] == ends["b"]:
        return df.withColumn("_slice", F.lit(0))
    part = F.floor((F.col(order) - F.lit(ends["a"])) * F.lit(float(slices)) / F.lit(float(ends["b"] - ends["a"])))
    return df.withColumn("_slice", F.greatest(F.lit(0), F.least(F.lit(slices - 1), F.coalesce(part, F.lit(0)))).cast("int"))


def carried_total(df: DataFrame, by: list[str], order: str, amount: str, name: str = "before", slices: int = 64) -> DataFrame:
    """The sum of the amounts of a key's earlier rows, 0 at first; a key with very many rows is spread over ``slices`` tasks.

    A window runs within a slice of a key; what the slices before it hold comes from a row a key and slice.
    """
    cut = sliced(df, by, order, slices)
    sums = cut.groupBy(*by, "_slice").agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(b).alias(f"_by{i}") for i, b in enumerate(by)), F.col("_slice").alias("_of"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    own = Window.partitionBy(*by, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_slice") == F.col("_of")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_by{i}"))
    inner = cut.withColumn("_own", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    return inner.join(sums, same).select(*df.columns, (F.col("_own") + F.col("_carried")).alias(name))


def carried_gap(df: DataFrame, by: list[str], order: str, end: Column, name: str = "gap", slices: int = 64) -> DataFrame:
    """The distance to a key's next value, of its last row to ``end``; a key with very many rows is spread over ``slices`` tasks."""
    cut = sliced(df, by, order, slices)
    later = Window.partitionBy(*by).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut.groupBy(*by, "_slice").agg(F.min(order).alias("_first"))
    firsts = firsts.select(*(F.col(b).alias(f"_by{i}") for i, b in enumerate(by)), F.col("_slice").alias("_of"), F.min("_first").over(later).alias("_following"))
    same = F.col("_slice") == F.col("_of")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_by{i}"))
    inner = cut.withColumn("_next", F.lead(order).over(Window.partitionBy(*by, "_slice").orderBy(order)))
    return inner.join(firsts, same).select(*df.columns, (F.coalesce("_next", "_following", end) - F.col(order)).alias(name))
