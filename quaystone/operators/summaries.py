"""Summaries: shares of a total, counts of fixed categories, stacked splits, ranked tops. Each is one pass with map-side aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """100 * part / whole, rounded; null where whole is 0."""
    return F.round(F.try_divide(100.0 * part, whole), places)


def share_by(df: DataFrame, by: str, amount: Column, chosen: Column, part: str = "part", total: str = "total", share: str = "share_pct") -> DataFrame:
    """Per key the amount where ``chosen`` holds, the whole amount and the percentage."""
    summed = df.groupBy(by).agg(F.coalesce(F.sum(F.when(chosen, amount)), F.lit(0)).alias(part), F.sum(amount).alias(total))
    return summed.withColumn(share, percent(F.col(part), F.col(total)))


def category_counts(df: DataFrame, answer: str, categories: dict[str, str], poor: tuple[str, ...], by: tuple[str, ...] = (), labels: dict[str, str] | None = None) -> DataFrame:
    """Rows, the count of each category (0 if absent) and the percentage of the ``poor`` ones among all rows.

    ``categories`` maps a column name to the answer it counts; answers outside the list count as rows only. ``labels`` are
    constant columns put first.
    """
    counts = [F.count_if(F.col(answer).eqNullSafe(v)).alias(k) for k, v in categories.items()]
    out = df.groupBy(*by).agg(F.count("*").alias("responses"), *counts)
    out = out.withColumn("poor_pct", percent(sum((F.col(c) for c in poor), F.lit(0)), F.col("responses")))
    return out.select(*(F.lit(v).alias(k) for k, v in (labels or {}).items()), *out.columns)


def split_counts(df: DataFrame, splits: dict[str, str], answer: str, categories: dict[str, str], poor: tuple[str, ...]) -> DataFrame:
    """``category_counts`` by several keys at once, stacked under a ``split`` label: one scan with grouping sets."""
    names = list(splits)
    keyed = df.select(*(F.col(column).alias(f"_s{i}") for i, column in enumerate(splits.values())), F.col(answer).alias("_answer"))
    exploded = keyed.select(F.explode(F.array(*(F.struct(F.lit(n).alias("split"), F.col(f"_s{i}").cast("string").alias("group")) for i, n in enumerate(names)))).alias("_k"), "_answer")
    return category_counts(exploded.select("_k.split", "_k.group", "_answer"), "_answer", categories, poor, by=("split", "group"))


def latest(df: DataFrame, period: str) -> DataFrame:
    """Rows of the largest period, compared as text."""
    return df.where(F.col(period).cast("string") == df.agg(F.max(F.col(period).cast("string"))).scalar())


def top_share(df: DataFrame, amount: str, tie: str, n: int = 20) -> DataFrame:
    """The n largest rows with their rank (ties numbered by ``tie``) and percentage of the whole table's amount."""
    top = df.orderBy(F.desc(amount), tie).limit(n)
    order = Window.orderBy(F.desc(amount), tie)  # n rows
    return top.withColumn("rank", F.row_number().over(order)).withColumn("share_pct", percent(F.col(amount), df.agg(F.sum(amount)).scalar()))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def last_per_key(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row a key: the one with the largest ordinal."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("_r")).select(key, "_r.*")


def running_total(df: DataFrame, by: str | None, order: str, amount: str, name: str = "before") -> DataFrame:
    """The sum of the amounts of earlier rows, 0 at first."""
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(amount).over(w), F.lit(0)))


def gap_to_next(df: DataFrame, by: str, order: str, end: Column, name: str = "gap") -> DataFrame:
    """The distance to the next row's value, of the last row to ``end``."""
    return df.withColumn(name, F.coalesce(F.lead(order).over(Window.partitionBy(by).orderBy(order)), end) - F.col(order))
