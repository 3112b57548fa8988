"""Joins on time: the row in force at a moment (as-of), the spans a moment lies in (interval), and the difference of two versions of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Left rows of a key and slice from which they are dealt to several tasks; it grows with the table, so that at most HOT_GROUPS groups are.
MOST_ROWS, HOT_GROUPS = 1_000_000, 1_000


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)))


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, slice_width: str = "month", most_rows: int = MOST_ROWS) -> DataFrame:
    """Each left row with the columns of the latest right row of its key at or before its time (null where there is none).

    Both sides are united and sorted by time, and the last right row so far is carried forward: no pairs are made, whatever the number of
    right rows a key. A key's rows are cut by ``slice_width`` (a unit of ``date_trunc``); what is in force as a slice begins is carried into it
    from a row a key and slice. Where a key and slice still has more than ``most_rows`` left rows, they are dealt to several tasks, and
    the few right rows are copied to each. Of right rows with one time the greatest by their other columns counts. Null keys are equal;
    a left row without a time has none in force, a right row without one never is. ``by`` and the two times are columns of the result;
    the right side's columns must have other names than the left side's.
    """
    rest = [c for c in right.columns if c not in by]
    slice_of = lambda c: F.date_trunc(slice_width, F.col(c).cast("timestamp"))
    r = right.where(F.col(right_time).isNotNull()).select(*by, slice_of(right_time).alias("_slice"), F.col(right_time).cast("timestamp").alias("_at"), F.struct(right_time, *(c for c in rest if c != right_time)).alias("_right"))
    sliced = left.withColumn("_slice", slice_of(left_time))
    keys = [f"_k{i}" for i in range(len(by))]
    groups = sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))

    # What is in force as a slice begins: the last right row of the key's earlier slices, from a row a key and slice.
    lasts = r.groupBy(*by, "_slice").agg(F.max("_right").alias("_last"))
    both = groups.select(*by, "_slice", F.lit(None).cast(r.schema["_right"].dataType).alias("_last")).union(lasts.select(*by, "_slice", "_last"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    merged = both.groupBy(*by, "_slice").agg(F.max("_last").alias("_last"))
    carried = merged.select(*by, "_slice", F.last("_last", ignorenulls=True).over(before).alias("_right")).where("_right is not null and _slice is not null")
    events = r.select(*by, "_slice", "_at", "_right").union(carried.select(*by, "_slice", F.lit(None).cast("timestamp"), "_right"))

    # Hot groups: at most HOT_GROUPS of them, since each holds more than that part of all rows.
    total = left.count()
    most = max(most_rows, total // HOT_GROUPS)
    hot = groups.where(F.col("_n") > most).select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col("_slice").alias("_s"), F.ceil(F.col("_n") / most).cast("int").alias("_parts")) if total > most else None
    deal = lambda df: df.join(F.broadcast(hot), _same([*by, "_slice"], [*keys, "_s"]), "left").drop(*keys, "_s").withColumn("_parts", F.coalesce("_parts", F.lit(1))) if hot is not None else df.withColumn("_parts", F.lit(1))
    row = F.struct(*(F.col(c) for c in left.columns))
    dealt = deal(sliced).select(*by, "_slice", F.floor(F.rand(11) * F.col("_parts")).cast("int").alias("_part"), F.col(left_time).cast("timestamp").alias("_at"), row.alias("_left"))
    copied = deal(events).select(*by, "_slice", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_at", "_right")
    united = dealt.select(*by, "_slice", "_part", "_at", "_left", F.lit(None).cast(r.schema["_right"].dataType).alias("_right")).union(copied.select(*by, "_slice", "_part", "_at", F.lit(None).cast(dealt.schema["_left"].dataType), "_right"))
    upto = Window.partitionBy(*by, "_slice", "_part").orderBy("_at", F.col("_left").isNotNull(), "_right").rowsBetween(Window.unboundedPreceding, 0)
    found = united.withColumn("_right", F.when(F.col("_slice").isNotNull(), F.last("_right", ignorenulls=True).over(upto))).where("_left is not null")
    return found.select("_left.*", *(F.col("_right")[c].alias(c) for c in rest))


def effect_in_force(reports: DataFrame, corrections: DataFrame, day: str = "reported_on") -> DataFrame:
    """service_id, approved_at, n, wrong, days: reports under each correction in force (null: before the first), and the mean days since it.

    ``corrections`` (service_id, approved_at) may hold several a service; a report counts under the latest on its day.
    """
    joined = as_of_join(reports.select("service_id", "outcome", day), corrections.select("service_id", "approved_at"), ["service_id"], day, "approved_at")
    wrong = ~F.col("outcome").eqNullSafe("ok")
    return joined.groupBy("service_id", "approved_at").agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"), F.avg(F.date_diff(day, "approved_at")).alias("days"))


#: A span is cut into buckets of the widest level of which it covers PIECES or more; levels' widths grow by this factor.
PIECES, FACTOR, LEVELS = 8, 8, 12


def interval_join(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, width: int = 1) -> DataFrame:
    """Pairs of a point and a span of its key with start <= at < end; ``at``, ``start`` and ``end`` are integers (days, seconds).

    An equi-join on the key and a time bucket, with the exact test on what meets there; no nested loops. Spans that are long are put into wide
    buckets: level l has buckets of ``width`` * FACTOR^l, and a span goes to the first level at which it touches at most PIECES * FACTOR + 1 of
    them, so it is copied that often at most. A point looks into one bucket of each level that has spans. A span without an end has none
    (open: it goes on for ever), one without a start began before all; empty spans, points without a time and null keys meet nothing.
    """
    ends = spans.agg(F.min(F.least(start, end)).alias("a"), F.max(F.greatest(start, end)).alias("b")).first()
    reach = points.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    if reach["a"] is None:
        reach = {"a": 0, "b": 0}
    low, high = min(x for x in (ends["a"], reach["a"]) if x is not None), max(x for x in (ends["b"], reach["b"]) if x is not None) + 1
    first = F.greatest(F.coalesce(F.col(start), F.lit(low)), F.lit(low)).cast("long")
    past = F.least(F.coalesce(F.col(end), F.lit(high)), F.lit(high)).cast("long")
    s = spans.withColumns({"_first": first, "_past": past}).where("_first < _past")
    length = F.col("_past") - F.col("_first")
    level = F.lit(LEVELS - 1)
    for i in range(LEVELS - 2, -1, -1):
        level = F.when(length <= width * PIECES * FACTOR ** (i + 1), F.lit(i)).otherwise(level)
    s = s.withColumn("_level", level)
    levels = sorted(r[0] for r in s.select("_level").distinct().collect())  # LEVELS at most
    wide = F.lit(width) * F.pow(F.lit(FACTOR), F.col("_level")).cast("long")
    s = s.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_first") / wide), F.floor((F.col("_past") - 1) / wide)))).drop("_first", "_past")
    p = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).where(F.col(at).isNotNull())
    p = p.withColumn("_bucket", F.floor(F.col(at) / wide))
    keys = [*by, "_level", "_bucket"]
    within = (F.coalesce(F.col(start), F.lit(low)) <= F.col(at)) & (F.col(at) < F.coalesce(F.col(end), F.lit(high)))
    return p.join(s, keys).where(within).drop("_level", "_bucket")


def differences(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """change, key..., old_key, fields: rows ``added``, ``removed``, ``changed`` (with the names of changed fields) or ``moved`` between two versions.

    A null-safe full outer join on the key. A removed and an added row of the same content, neither of which repeats in its version's rows of
    that kind, are one row that moved to another key. Rows are compared field by field, nulls being equal; keys are unique in each
    version, and both have the same columns.
    """
    fields = [c for c in old.columns if c not in key]
    content = F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in fields)), {"ignoreNullFields": "false"}), 256)
    side = lambda df, x: df.select(F.struct(*key).alias(f"{x}_key"), content.alias(f"{x}_hash"), F.struct(*fields).alias(x))
    joined = side(old, "old").join(side(new, "new"), F.col("old_key").eqNullSafe(F.col("new_key")), "full_outer")
    unlike = F.array_compact(F.array(*(F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c)) for c in fields)))
    kind = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed")
    told = joined.select(kind.alias("change"), "old_key", "new_key", F.coalesce("new_hash", "old_hash").alias("hash"), F.when(kind == "changed", unlike).alias("fields")).where("change is not null")
    loose = told.where("change <> 'changed'").groupBy("hash").agg(F.count_if(F.col("change") == "added").alias("a"), F.count_if(F.col("change") == "removed").alias("r"), F.max("new_key").alias("to"), F.max("old_key").alias("from"))
    moved = loose.where("a = 1 and r = 1")
    of = lambda c: [F.col(c)[k].alias(k) for k in key]
    stay = told.join(moved.select("hash"), (told["hash"] == moved["hash"]) & (F.col("change") != "changed"), "left_anti")
    plain = stay.select("change", F.coalesce("new_key", "old_key").alias("k"), F.lit(None).cast(told.schema["old_key"].dataType).alias("old_key"), "fields")
    return plain.union(moved.select(F.lit("moved"), F.col("to"), F.col("from"), F.lit(None).cast("array<string>"))).select("change", *of("k"), "old_key", "fields")
