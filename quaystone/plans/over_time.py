"""Queries over weeks, times, versions and publication, with the same in SQL. The operators are those of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.operators import publish, temporal, windows
from quaystone.plans.registry import query

_SERVICE = "'service-' || (user_id % 20)"


def _service(user: str = "user_id"):
    return F.concat(F.lit("service-"), (F.col(user) % 20).cast("string"))


def _reports(t) -> DataFrame:
    """Events as reports, each on its day: purchases went well, every 97th outcome is unknown."""
    return t("events").select(
        _service().alias("service_id"),
        F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_id") % 97 == 0, None).otherwise("missing").alias("outcome"),
        F.col("event_type").alias("cause"),
        (F.col("event_id") % 3 == 0).alias("simulated"),
        F.to_date("ts").alias("day"),
        "event_id",
        "user_id",
        "ts",
    )


_R = f"r AS (SELECT {_SERVICE} AS service_id, CASE WHEN event_type = 'purchase' THEN 'ok' WHEN event_id % 97 = 0 THEN NULL ELSE 'missing' END AS outcome, event_type AS cause, event_id % 3 = 0 AS simulated, cast(ts AS DATE) AS day, event_id, user_id, ts FROM events)"


@query(f"""WITH {_R}, w AS (SELECT service_id, cause, date_trunc('week', day)::DATE AS week, count(*) AS n, count(*) FILTER (simulated) AS s FROM r WHERE outcome IS DISTINCT FROM 'ok' GROUP BY ALL),
 a AS (SELECT service_id, cause, week + 7 * later::INTEGER AS week, sum(CASE WHEN later = 0 THEN n ELSE 0 END) AS n, sum(CASE WHEN later = 0 THEN s ELSE 0 END) AS s FROM w, range(0, 2) x(later) GROUP BY ALL),
 f AS (SELECT service_id, cause, week, sum(n) OVER v AS n, sum(s) OVER v AS s FROM a WINDOW v AS (PARTITION BY service_id, cause ORDER BY week RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW))
 SELECT week AS week_start, service_id, cause, n::BIGINT AS count, s::BIGINT AS simulated, n >= 5 AS over_threshold FROM f""")
def rolling_weeks(t):
    return windows.rolling_groups(_reports(t), "day", weeks=2)


@query(f"""WITH {_R}, w AS (SELECT user_id, date_trunc('week', day)::DATE AS week, count(*) AS n FROM r WHERE outcome IS DISTINCT FROM 'ok' GROUP BY ALL),
 f AS (SELECT user_id, week, sum(n) OVER (PARTITION BY user_id ORDER BY week RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS n FROM w)
 SELECT user_id, min(week) AS week_start FROM f WHERE n >= 5 GROUP BY 1""")
def first_crossing_weeks(t):
    """By user, so that groups are small and cross at different times, or never."""
    rolling = windows.rolling_groups(_reports(t), "day", weeks=2, by=("user_id",))
    return windows.first_crossings(rolling, "user_id")


@query(f"""WITH {_R}, d AS (SELECT user_id, cause, datediff('day', DATE '1970-01-01', day) AS d, count(*) AS n FROM r GROUP BY ALL),
 g AS (SELECT *, d.d - row_number() OVER (PARTITION BY user_id, cause ORDER BY d.d) AS run FROM d)
 SELECT user_id, cause, min(d)::BIGINT AS first, max(d)::BIGINT AS last, sum(n)::BIGINT AS n_rows, count(*) AS n_places FROM g GROUP BY user_id, cause, run""")
def consecutive_days(t):
    """Runs of days with reports of one cause, by user: gaps and islands."""
    return windows.runs(_reports(t).select("user_id", "cause", F.unix_date("day").alias("at")), ["user_id", "cause"], "at")


#: Four corrections a service, some days apart and at different days for each.
_FIXES = "fixes AS (SELECT 'service-' || s AS service_id, DATE '2024-01-02' + (s % 5 + 7 * k)::INTEGER AS approved_at, k::INTEGER AS revision FROM range(20) a(s), range(4) b(k) WHERE s <> 7)"


def _fixes(t) -> DataFrame:
    services = t("events").select((F.col("user_id") % 20).alias("s")).distinct().where("s <> 7")
    many = services.select("s", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return many.select(F.concat(F.lit("service-"), F.col("s").cast("string")).alias("service_id"), F.date_add(F.lit("2024-01-02").cast("date"), (F.col("s") % 5 + 7 * F.col("k")).cast("int")).alias("approved_at"), F.col("k").alias("revision"))


@query(f"WITH {_R}, {_FIXES} SELECT event_id, r.service_id, day, approved_at, revision FROM r ASOF LEFT JOIN fixes ON r.service_id = fixes.service_id AND r.day >= fixes.approved_at")
def correction_in_force(t):
    """Each report with the correction in force on its day; one service has none."""
    return temporal.as_of_join(_reports(t).select("event_id", "service_id", "day"), _fixes(t), ["service_id"], "day", "approved_at", slice_width="week")


@query(f"""WITH {_R}, {_FIXES}, j AS (SELECT r.service_id, outcome, day, approved_at FROM r ASOF LEFT JOIN fixes ON r.service_id = fixes.service_id AND r.day >= fixes.approved_at)
 SELECT service_id, approved_at, count(*) AS n, count(*) FILTER (outcome IS DISTINCT FROM 'ok') AS wrong, round(avg(datediff('day', approved_at, day)), 6)::DOUBLE AS days FROM j GROUP BY 1, 2""")
def correction_effects(t):
    found = temporal.effect_in_force(_reports(t).withColumnRenamed("day", "reported_on"), _fixes(t).drop("revision"))
    return found.withColumn("days", F.round("days", 6))


@query(f"""WITH {_R}, s AS (SELECT c_custkey AS fact, c_custkey % 1500 AS user_id, DATE '2023-12-20' + (c_custkey % 37)::INTEGER AS valid_from,
 CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN DATE '2030-01-01' ELSE DATE '2023-12-20' + (c_custkey % 37 + c_custkey % 11)::INTEGER END AS valid_to FROM customer)
 SELECT fact, count(*) AS n, count(*) FILTER (outcome IS DISTINCT FROM 'ok') AS wrong FROM r JOIN s ON r.user_id = s.user_id AND day >= valid_from AND (valid_to IS NULL OR day < valid_to) GROUP BY 1""")
def reports_in_validity(t):
    """Reports while a fact was valid: short spans, very long ones, open ones."""
    k = F.col("c_custkey")
    start = F.unix_date(F.date_add(F.lit("2023-12-20").cast("date"), (k % 37).cast("int")))
    end = F.when(k % 10 == 0, None).when(k % 9 == 0, F.unix_date(F.lit("2030-01-01").cast("date"))).otherwise(start + (k % 11).cast("int"))
    spans = t("customer").select(k.alias("fact"), (k % 1500).alias("user_id"), start.alias("valid_from"), end.alias("valid_to"))
    points = _reports(t).select("user_id", "outcome", F.unix_date("day").alias("at"))
    joined = temporal.interval_join(points, spans, ["user_id"], "at", "valid_from", "valid_to")
    return joined.groupBy("fact").agg(F.count("*").alias("n"), F.count_if(~F.col("outcome").eqNullSafe("ok")).alias("wrong"))


def _changed(t) -> tuple[DataFrame, DataFrame]:
    """Two versions of the suppliers as facts: some gone, some new, some changed, some under another id."""
    k = F.col("s_suppkey")
    old = t("supplier").select(k.alias("id"), "s_name", F.when(k % 6 != 0, F.col("s_nationkey")).alias("s_nationkey"), "s_acctbal")
    i = F.col("id")
    new = old.where(i % 7 != 0).select(F.when(i % 11 == 0, -i).otherwise(i).alias("id"), "s_name", F.when(i % 5 == 0, None).otherwise(F.col("s_nationkey")).alias("s_nationkey"), F.when(i % 10 == 3, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")).alias("s_acctbal"))
    return old, new.union(old.where(i % 13 == 0).select(1_000_000 + i, F.concat(F.lit("new "), "s_name"), "s_nationkey", "s_acctbal"))


@query("""WITH o AS (SELECT s_suppkey AS id, s_name, CASE WHEN s_suppkey % 6 <> 0 THEN s_nationkey END AS s_nationkey, s_acctbal FROM supplier),
 n AS (SELECT CASE WHEN id % 11 = 0 THEN -id ELSE id END AS id, s_name, CASE WHEN id % 5 = 0 THEN NULL ELSE s_nationkey END AS s_nationkey, CASE WHEN id % 10 = 3 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM o WHERE id % 7 <> 0
  UNION ALL SELECT 1000000 + id, 'new ' || s_name, s_nationkey, s_acctbal FROM o WHERE id % 13 = 0),
 j AS (SELECT o.id AS oid, n.id AS nid, o AS a, n AS b FROM o FULL JOIN n ON o.id = n.id),
 gone AS (SELECT * FROM o WHERE id IN (SELECT id FROM o EXCEPT SELECT id FROM n)), come AS (SELECT * FROM n WHERE id IN (SELECT id FROM n EXCEPT SELECT id FROM o)),
 m AS (SELECT gone.id AS oid, come.id AS nid FROM gone JOIN come ON (gone.s_name, gone.s_nationkey, gone.s_acctbal) IS NOT DISTINCT FROM (come.s_name, come.s_nationkey, come.s_acctbal))
 SELECT 'moved' AS change, nid AS id, oid AS old_id, NULL::VARCHAR AS fields FROM m
 UNION ALL SELECT 'removed', id, NULL, NULL FROM gone WHERE id NOT IN (SELECT oid FROM m) UNION ALL SELECT 'added', id, NULL, NULL FROM come WHERE id NOT IN (SELECT nid FROM m)
 UNION ALL SELECT 'changed', oid, NULL, concat_ws(',', CASE WHEN a.s_name IS DISTINCT FROM b.s_name THEN 's_name' END, CASE WHEN a.s_nationkey IS DISTINCT FROM b.s_nationkey THEN 's_nationkey' END, CASE WHEN a.s_acctbal IS DISTINCT FROM b.s_acctbal THEN 's_acctbal' END)
  FROM j WHERE oid IS NOT NULL AND nid IS NOT NULL AND (a.s_name, a.s_nationkey, a.s_acctbal) IS DISTINCT FROM (b.s_name, b.s_nationkey, b.s_acctbal)""")
def version_differences(t):
    old, new = _changed(t)
    return temporal.differences(old, new, ["id"]).select("change", "id", F.col("old_key.id").alias("old_id"), F.array_join("fields", ",").alias("fields"))


_DIMS = ["service_id", "office", "cause"]
_CUBE = f"""c AS (SELECT service_id, office, cause, grouping(service_id, office, cause)::INTEGER AS level, count(*) AS n, count(*) FILTER (outcome = 'ok') AS n_ok FROM (SELECT *, user_id % 37 AS office FROM ({{0}})) GROUP BY CUBE (service_id, office, cause))"""


def _sql_groups(i: int, d: str, level: int) -> str:
    return f"""g{i} AS (SELECT v, CASE WHEN r = max(r) OVER () AND r % 2 = 1 THEN (r + 1) // 2 - 1 ELSE (r + 1) // 2 END AS g FROM (SELECT {d} AS v, row_number() OVER (ORDER BY n DESC, {d} NULLS FIRST) - 1 AS r FROM c WHERE level = {level}))"""


@query(f"""WITH {_R}, {_CUBE.format("FROM r")}, {_sql_groups(0, "service_id", 3)}, {_sql_groups(1, "office", 5)}, {_sql_groups(2, "cause", 6)},
 b AS (SELECT c.*, CASE WHEN level & 4 <> 0 THEN 0 ELSE g0.g END AS b0, CASE WHEN level & 2 <> 0 THEN 0 ELSE g1.g END AS b1, CASE WHEN level & 1 <> 0 THEN 0 ELSE g2.g END AS b2 FROM c
  LEFT JOIN g0 ON level & 4 = 0 AND service_id IS NOT DISTINCT FROM g0.v LEFT JOIN g1 ON level & 2 = 0 AND office IS NOT DISTINCT FROM g1.v LEFT JOIN g2 ON level & 1 = 0 AND cause IS NOT DISTINCT FROM g2.v),
 w AS (SELECT *, bool_or(n < 5) OVER (PARTITION BY b0, b1, b2) AS withheld FROM b)
 SELECT service_id, office, cause, level, n, round(n_ok / n, 6)::DOUBLE AS closure_rate FROM w WHERE NOT withheld""")
def closure_cube(t):
    """Closure rates by service, office and cause and all their sums, with small cells and those that would give them away withheld."""
    rows = _reports(t).withColumn("office", F.col("user_id") % 37)
    return publish.published_cube(rows, _DIMS, F.col("outcome") == "ok")


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS exact_distinct, true AS distinct_within, true AS median_within, true AS p90_within FROM events GROUP BY 1""")
def merged_sketches(t):
    """Sketches a day, merged: distinct users and percentiles of the value, held against exact ones within three standard errors."""
    events = t("events").select("event_type", "user_id", "value", "ts")
    by_day = publish.day_sketches(events, "ts", ["event_type"], "user_id", "value")
    merged = publish.merged_sketches(by_day, ["event_type"], (0.5, 0.9))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact_distinct"))
    both = events.join(F.broadcast(merged.select("event_type", "percentiles")), "event_type")  # a row an event type
    below = lambda i: F.avg((F.col("value") < F.col("percentiles")[i]).cast("double"))
    upto = lambda i: F.avg((F.col("value") <= F.col("percentiles")[i]).cast("double"))
    rank = both.groupBy("event_type").agg(*(f(i).alias(f"{n}{i}") for n, f in (("lo", below), ("hi", upto)) for i in (0, 1)))
    near = lambda i, p: (F.col(f"lo{i}") - 3 * publish.RANK_ERROR <= p) & (F.col(f"hi{i}") + 3 * publish.RANK_ERROR >= p)
    out = merged.join(exact, "event_type").join(rank, "event_type")
    off = F.abs(F.col("n_distinct") - F.col("exact_distinct")) / F.col("exact_distinct")
    return out.select("event_type", "n", "exact_distinct", (off <= 3 * publish.DISTINCT_ERROR).alias("distinct_within"), near(0, 0.5).alias("median_within"), near(1, 0.9).alias("p90_within"))


@query("""SELECT user_id, event_id, coalesce(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, event_id FROM events)""")
def running_totals_hot(t):
    """As running_totals, with a third of all rows under one key."""
    rows = t("events").select(F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("user_id"), "event_id")
    return windows.carried_total(rows, ["user_id"], "event_id", "event_id")


@query("""SELECT user_id, event_id, (coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 1000000) - event_id)::BIGINT AS gap FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, event_id FROM events)""")
def gaps_hot(t):
    rows = t("events").select(F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("user_id"), "event_id")
    return windows.carried_gap(rows, ["user_id"], "event_id", F.lit(1_000_000).cast("long"))
