"""Each operator as a query over the parquet tables, with the same query in SQL.

``QUERIES[name]`` takes (spark, sf_dir); ``SQL[name]`` is for DuckDB over views of the tables. Names and types of columns are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.functions import dates, html
from quaystone.functions import text as X
from quaystone.operators import kb, metrics, offices, quality, reports, summaries
from quaystone.plans import files_and_streams, over_time  # noqa: F401 (they add their queries)
from quaystone.plans.registry import QUERIES, SQL  # noqa: F401
from quaystone.plans.registry import query as _query
from quaystone.sources import readers, schemas


@_query("""SELECT cast(ts AS DATE) AS day, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS part, count(*)::BIGINT AS total,
 round(100.0 * sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*), 1)::DOUBLE AS share_pct FROM events GROUP BY 1""")
def share_by_period(t):
    events = t("events").select(F.to_date("ts").alias("day"), "event_type")
    return summaries.share_by(events, "day", F.lit(1).cast("long"), F.col("event_type") == "error")


_PRIORITIES = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "low": "5-LOW", "absent": "9-ABSENT"}
_COUNTS = ", ".join(f"count(*) FILTER (o_orderpriority = '{v}') AS {k}" for k, v in _PRIORITIES.items())


@_query(f"""SELECT 'orders' AS source, count(*) AS responses, {_COUNTS},
 round(100.0 * (count(*) FILTER (o_orderpriority = '1-URGENT') + count(*) FILTER (o_orderpriority = '2-HIGH')) / count(*), 1)::DOUBLE AS poor_pct FROM orders""")
def category_counts(t):
    return summaries.category_counts(t("orders"), "o_orderpriority", _PRIORITIES, ("urgent", "high"), labels={"source": "orders"})


@_query(f"""WITH k AS (SELECT 'status' AS split, o_orderstatus AS "group", o_orderpriority FROM orders
 UNION ALL SELECT 'year', cast(year(o_orderdate) AS VARCHAR), o_orderpriority FROM orders)
 SELECT split, "group", count(*) AS responses, {_COUNTS},
 round(100.0 * (count(*) FILTER (o_orderpriority = '1-URGENT') + count(*) FILTER (o_orderpriority = '2-HIGH')) / count(*), 1)::DOUBLE AS poor_pct FROM k GROUP BY 1, 2""")
def split_union_counts(t):
    orders = t("orders").select("o_orderstatus", F.year("o_orderdate").alias("y"), "o_orderpriority")
    return summaries.split_counts(orders, {"status": "o_orderstatus", "year": "y"}, "o_orderpriority", _PRIORITIES, ("urgent", "high"))


@_query("""WITH y AS (SELECT n_name AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 WHERE cast(year(o_orderdate) AS VARCHAR) = (SELECT max(cast(year(o_orderdate) AS VARCHAR)) FROM orders) GROUP BY 1)
 SELECT nation, n, row_number() OVER (ORDER BY n DESC, nation)::INTEGER AS rank, round(100.0 * n / (SELECT sum(n) FROM y), 1)::DOUBLE AS share_pct FROM y ORDER BY n DESC, nation LIMIT 20""")
def top_n_share(t):
    orders = summaries.latest(t("orders").select("o_custkey", F.year("o_orderdate").alias("y")), "y")
    per_customer = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))  # before the join, so that it shuffles less
    nations = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("nation"))
    counted = per_customer.join(nations, F.col("o_custkey") == F.col("c_custkey")).groupBy("nation").agg(F.sum("n").alias("n"))
    return summaries.top_share(counted, "n", "nation")


_EVENT_CAUSES = [("error", "Page incomplete", "editors"), ("click", "Not followed", "nobody"), ("view", "Out of date", "owner"), ("signup", "No page", "owner")]
_EVENT_VALUES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _EVENT_CAUSES)


def _event_reports(t) -> DataFrame:
    e = t("events")
    return e.select(
        F.concat(F.lit("service-"), (F.col("user_id") % 20).cast("string")).alias("service_id"),
        F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_id") % 97 == 0, None).otherwise("missing").alias("outcome"),
        F.col("event_type").alias("cause"),
        F.concat(F.lit("it "), (F.col("event_id") % 9).cast("string")).alias("summary_it"),
        F.concat(F.lit("en "), (F.col("event_id") % 11).cast("string")).alias("summary_en"),
        (F.col("event_id") % 3 == 0).alias("simulated"),
    )


@_query(f"""WITH r AS (SELECT 'service-' || (user_id % 20) AS service_id, CASE WHEN event_type = 'purchase' THEN 'ok' WHEN event_id % 97 = 0 THEN NULL ELSE 'missing' END AS outcome,
 event_type AS cause, 'it ' || (event_id % 9) AS summary_it, 'en ' || (event_id % 11) AS summary_en, event_id % 3 = 0 AS simulated FROM events),
 c(cause, cause_label, recipient) AS (VALUES {_EVENT_VALUES})
 SELECT service_id, cause, cause_label, recipient, count(*) AS count, sum(CASE WHEN simulated THEN 1 ELSE 0 END)::BIGINT AS simulated, count(*) >= 5 AS over_threshold,
 array_to_string(list_sort(list(DISTINCT summary_en))[1:5], '|') AS examples_en, array_to_string(list_sort(list(DISTINCT summary_it))[1:5], '|') AS examples_it
 FROM r LEFT JOIN c USING (cause) WHERE outcome IS DISTINCT FROM 'ok' GROUP BY 1, 2, 3, 4""")
def report_groups(t):
    found = _event_reports(t)
    table = found.sparkSession.createDataFrame(_EVENT_CAUSES, "cause string, cause_label string, recipient string")
    groups = reports.report_groups(found, table)
    return groups.withColumns({c: F.array_join(c, "|") for c in ("examples_en", "examples_it")})


@_query("""SELECT event_type, count(*) AS n, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_simulated FROM events GROUP BY 1""")
def runtime_union(t):
    e = t("events")
    demo, runtime = e.where("event_id % 2 = 0").select("event_id", "event_type", F.lit(True).alias("simulated")), e.where("event_id % 2 <> 0").select("event_id", "event_type")
    both = reports.all_reports(demo, runtime)
    return both.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.coalesce("simulated", F.lit(False)).cast("long")).alias("n_simulated"))


@_query("SELECT strftime(ts, '%G-W%V') AS week, count(*) AS n FROM events GROUP BY 1")
def iso_week_counts(t):
    return t("events").groupBy(dates.iso_week(F.to_date("ts")).alias("week")).agg(F.count("*").alias("n"))


@_query("""WITH s AS (SELECT s_suppkey, 45.4 + (s_suppkey % 97) * 0.001 AS lat, 9.1 + (s_suppkey % 89) * 0.001 AS lon FROM supplier)
 SELECT s_suppkey, round(12742 * asin(sqrt(pow(sin(radians(lat - 45.4847) / 2), 2) + cos(radians(45.4847)) * cos(radians(lat)) * pow(sin(radians(lon - 9.2025) / 2), 2))), 2)::DOUBLE AS distance_km
 FROM s ORDER BY distance_km, s_suppkey LIMIT 10""")
def nearest_k(t):
    s = t("supplier").select("s_suppkey", (45.4 + (F.col("s_suppkey") % 97) * F.lit(0.001)).alias("lat"), (9.1 + (F.col("s_suppkey") % 89) * F.lit(0.001)).alias("lon"))
    offices = s.select("s_suppkey", F.col("s_suppkey").alias("id"), "lat", "lon")
    near = kb.find_offices(offices, lat=45.4847, lon=9.2025, limit=10)
    return near.select(F.col("id").alias("s_suppkey"), "distance_km")


@_query("SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_size = 11 AND (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring'))")
def optional_filters(t):
    parts = t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("municipio"), F.col("p_name").alias("address"), F.struct(F.col("p_brand").alias("name")).alias("nil"))
    found = kb.find_offices(parts, area="RING", municipio=11, limit=2**31 - 1)
    return found.select(F.col("id").alias("p_partkey"), F.col("address").alias("p_name"), F.col("nil.name").alias("p_brand"), F.col("municipio").alias("p_size"))


#: id, condition (question -> allowed answers), status.
_RULES = [("r1", {}, "verified"), ("r2", {"segment": ["BUILDING", "MACHINERY"]}, "verified"), ("r3", {"segment": ["HOUSEHOLD"], "balance": ["high"]}, "verified"), ("r4", {"balance": ["low"]}, "draft"), ("r5", {"segment": ["NONE"], "region": ["x"]}, "verified")]


@_query("""WITH a AS (SELECT c_custkey, c_mktsegment AS segment, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_acctbal > 5000 THEN 'high' ELSE 'low' END AS balance FROM customer)
 SELECT c_custkey AS case_id, concat_ws(',', 'r1', CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN 'r2' END, CASE WHEN balance = 'high' AND segment = 'HOUSEHOLD' THEN 'r3' END) AS applies,
 CASE WHEN balance IS NULL THEN 'balance,region' ELSE 'region' END AS still_to_ask, CASE WHEN balance = 'low' THEN 'r4' ELSE '' END AS not_yet_verified FROM a""")
def checklist_cases(t):
    c = t("customer")
    spark = c.sparkSession
    requirement = "array<struct<id: string, text_it: string, text_en: string, when: map<string, array<string>>, source_id: string, quote: string, verified_at: date, status: string>>"
    services = spark.createDataFrame([("s", [(i, None, None, when, "src", None, None, status) for i, when, status in _RULES])], f"id string, requirements {requirement}")
    sources = spark.createDataFrame([("src", "Source", "", "", "", "ok")], "id string, title string, url string, publisher string, retrieved_at string, status string")
    balance = F.when(F.col("c_custkey") % 4 == 0, None).when(F.col("c_acctbal") > 5000, "high").otherwise("low")
    answers = F.map_filter(F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("balance"), balance), lambda k, v: v.isNotNull())
    cases = c.select(F.col("c_custkey").alias("case_id"), F.lit("s").alias("service_id"), answers.alias("answers"))
    out = kb.checklists(services, cases, sources)
    return out.select("case_id", F.array_join(F.transform("requirements", lambda r: r["id"]), ",").alias("applies"), F.array_join("still_to_ask", ",").alias("still_to_ask"), F.array_join("not_yet_verified", ",").alias("not_yet_verified"))


@_query("""SELECT o_orderkey AS id, count(*) FILTER (l_returnflag = 'R')::INTEGER AS verified_requirements, count(*)::INTEGER AS total_requirements
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def service_counts(t):
    status = F.when(F.col("l_returnflag") == "R", "verified").otherwise("draft")
    nested = t("lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("id"), status.alias("status")).alias("r")).groupBy("l_orderkey").agg(F.collect_list("r").alias("requirements"))
    services = nested.join(t("orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_orderkey").alias("id"), F.lit(None).cast("string").alias("title"), "requirements")
    return kb.list_services(services).drop("title")


_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@_query(f"""SELECT doc_id, trim(regexp_replace(replace(coalesce(text, ''), '’', ''''), '{_WS}', ' ', 'g'), ' .;') AS cleaned,
 lower(trim(regexp_replace(translate(text, '’‘“”', '''''""'), '{_WS}', ' ', 'g'))) AS normalised FROM documents""")
def text_norm(t):
    return t("documents").select("doc_id", X.clean(F.col("text")).alias("cleaned"), X.normalise(F.col("text")).alias("normalised"))


@_query(f"""WITH d AS (SELECT doc_id, lower(trim(regexp_replace(translate(text, '’‘“”', '''''""'), '{_WS}', ' ', 'g'))) AS text FROM documents),
 q AS (SELECT item_id, lower(trim(regexp_replace(translate(text, '’‘“”', '''''""'), '{_WS}', ' ', 'g'))) AS quote FROM benchmark),
 b AS (SELECT item_id, quote FROM q UNION ALL SELECT -1 - item_id, CASE WHEN item_id < 20 THEN array_to_string(string_split(quote, ' ')[1:2], ' ') ELSE array_to_string(string_split(quote, ' ')[1:3], ' ') END FROM q)
 SELECT item_id, doc_id FROM b JOIN d ON contains(d.text, b.quote)""")
def quote_grounding(t):
    items = t("benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    short = F.when(F.col("quote_id") < 20, F.array_join(F.slice(F.split(X.normalise(F.col("quote")), " "), 1, 2), " ")).otherwise(F.array_join(F.slice(F.split(X.normalise(F.col("quote")), " "), 1, 3), " "))
    quotes = items.union(items.select(-1 - F.col("quote_id"), short))
    found = quality.ground_quotes(quotes, t("documents").select(F.col("doc_id").alias("text_id"), "text"))
    return found.select(F.col("quote_id").alias("item_id"), F.col("text_id").alias("doc_id"))


@_query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unknown_source(t):
    return t("documents").select("doc_id", "source").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@_query(f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(regexp_replace(translate(text, '’‘“”', '''''""'), '{_WS}', ' ', 'g'))) ORDER BY doc_id) AS n FROM documents) WHERE n > 1""")
def duplicate_ids(t):
    keyed = t("documents").select("doc_id", F.sha2(X.normalise(F.col("text")), 256).alias("key"))  # the digest is shuffled, not the text
    return quality.duplicates(keyed, ["key"], "doc_id").select("doc_id")


@_query("SELECT o_orderkey, datediff('day', cast(o_orderdate AS DATE), DATE '2001-08-01')::INTEGER AS age_days FROM orders WHERE datediff('day', cast(o_orderdate AS DATE), DATE '2001-08-01') > 90")
def stale_rows(t):
    as_of = F.lit("2001-08-01").cast("date")
    day = F.to_date("o_orderdate")
    return t("orders").where(dates.is_stale(day, as_of)).select("o_orderkey", F.date_diff(as_of, day).alias("age_days"))


@_query("""SELECT user_id, len(list_filter(list(DISTINCT event_type), lambda x: NOT list_contains(['view', 'click', 'purchase'], x)))::INTEGER AS n_outside FROM events GROUP BY 1
 HAVING len(list_filter(list(DISTINCT event_type), lambda x: NOT list_contains(['view', 'click', 'purchase'], x))) > 0""")
def option_subset(t):
    options = F.array(*(F.lit(x) for x in ("view", "click", "purchase")))
    per_user = t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("allowed"))
    return per_user.select("user_id", F.size(F.array_except("allowed", options)).alias("n_outside")).where("n_outside > 0")


_MONTH_SQL = "[" + ", ".join(f"'{m}'" for m in X.MONTHS) + "]"


_SAID_SQL = "strftime({0}, '%-d') || ' ' || " + _MONTH_SQL + "[month({0})] || ' ' || year({0})"


@_query(f"""WITH d AS (SELECT o_orderkey, cast(o_orderdate AS DATE) + 5475 AS a, cast(o_orderdate AS DATE) + 5475 + (o_orderkey % 400)::INTEGER AS b FROM orders)
 SELECT o_orderkey, array_to_string(list_filter([CASE WHEN a < DATE '2016-01-01' THEN {_SAID_SQL.format("a")} END, CASE WHEN b < DATE '2016-01-01' THEN {_SAID_SQL.format("b")} END], lambda x: x IS NOT NULL), '|') AS past FROM d""")
def prose_dates(t):
    """Two dates a sentence, one of them up to 399 days later, and one that no calendar has."""
    months = F.array(*(F.lit(m) for m in X.MONTHS))
    said = lambda d: F.concat(F.date_format(d, "d"), F.lit(" "), months[F.month(d) - 1], F.lit(" "), F.year(d).cast("string"))
    day = F.date_add(F.to_date("o_orderdate"), 5475)
    later = F.date_add(day, (F.col("o_orderkey") % 400).cast("int"))
    sentence = F.concat(F.lit("Chiuso dal "), said(day), F.lit(" al "), said(later), F.lit(" e il 31 febbraio 2014, salvo avvisi."))
    return t("orders").select("o_orderkey", F.array_join(X.past_dates(sentence, F.lit("2016-01-01").cast("date")), "|").alias("past"))


@_query("""SELECT conv_id, count(*) FILTER (turn > last OR role <> 'system')::BIGINT AS kept, max(last)::BIGINT AS last_user FROM
 (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY 1""")
def last_marker(t):
    c = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("type")))).alias("blocks"))
    kept = X.after_last_marker(F.col("blocks"), "user", ("system",))
    users = F.transform(F.filter("blocks", lambda b: b["type"] == "user"), lambda b: b["turn"])
    return c.select("conv_id", F.size(kept).cast("long").alias("kept"), F.array_max(users).cast("long").alias("last_user"))


@_query(r"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE regexp_replace(text, '[\t\n\v\f\r ]+$', '') END AS body,
 CASE WHEN turn % 3 = 0 THEN '' ELSE role || '|Turno ' || turn END AS options FROM conversations""")
def split_options(t):
    """Every third turn ends without a line of options."""
    said = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("\n\noptions: "), "role", F.lit(" |  Turno "), F.col("turn").cast("string"), F.lit(" | \n")))
    body, options = X.split_options(said)
    return t("conversations").select("conv_id", "turn", body.alias("body"), F.array_join(options, "|").alias("options"))


@_query("""SELECT o_orderkey, 'before' AS kind, cast(o_orderdate AS DATE) - 3 AS day, strftime(cast(o_orderdate AS DATE) - 2, '%Y%m%d') AS until FROM orders
 UNION ALL SELECT o_orderkey, 'same-day', cast(o_orderdate AS DATE), strftime(cast(o_orderdate AS DATE) + 1, '%Y%m%d') FROM orders""")
def reminders(t):
    rows = t("orders").select("o_orderkey", F.explode(dates.reminders(F.to_date("o_orderdate"))).alias("r"))
    return rows.select("o_orderkey", "r.kind", "r.day", F.date_format(F.date_add("r.day", 1), "yyyyMMdd").alias("until"))


@_query("SELECT event_id, cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_field(t):
    return t("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@_query(r"""WITH v AS (SELECT page_id, regexp_replace(html, '<!--.*?-->|<!DOCTYPE[^>]*>|<script>.*?</script>|<style>.*?</style>|<a [^>]*>[^<]*</a>|<footer>.*?(</footer>|$)', '', 'gs') AS h FROM pages),
 l AS (SELECT page_id, regexp_replace(replace(replace(regexp_replace(h, '</?(p|div|br|article)( [^>]*)?>|</(li|h1)>', chr(10), 'g'), '<h1>', chr(10) || '# '), '<li>', chr(10) || '- '), '<[a-zA-Z/][^>]*>', '', 'g') AS h FROM v),
 u AS (SELECT page_id, regexp_replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS h FROM l)
 SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(h, '[ \t\x{a0}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) || chr(10) AS text FROM u""")
def html_text(t):
    """The SQL knows the markup of these pages only: links stand in navigation, and so on."""
    return t("pages").select("page_id", html.html_to_text("html").alias("text"))


@_query("SELECT page_id, substr(sha256(html), 1, 16) AS html_sha256 FROM pages")
def html_hash(t):
    return t("pages").select("page_id", html.short_hash(F.col("html")).alias("html_sha256"))


@_query("""SELECT user_id, event_id, coalesce(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM events""")
def running_totals(t):
    return summaries.running_total(t("events").select("user_id", "event_id"), "user_id", "event_id", "event_id")


@_query("""SELECT user_id, event_id, (coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 1000000) - event_id)::BIGINT AS gap FROM events""")
def gaps(t):
    return summaries.gap_to_next(t("events").select("user_id", "event_id"), "user_id", "event_id", F.lit(1_000_000).cast("long"))


@_query("""SELECT c_custkey AS case_id, 'svc-' || (c_custkey % 3) AS service_id,
 CASE c_custkey % 3 WHEN 2 THEN NULL WHEN 1 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'Source a|?' ELSE 'Source a' END ELSE 'Source a|Source b' END AS cited,
 CASE WHEN c_custkey % 3 = 2 THEN 'Unknown service ''svc-2' || chr(39) END AS error FROM customer""")
def cited_sources(t):
    """Sources of the requirements that apply: some cite one that isn't listed, some cases are of an unknown service."""
    c = t("customer")
    spark = c.sparkSession
    requirement = "array<struct<id: string, text_it: string, text_en: string, when: map<string, array<string>>, source_id: string, quote: string, verified_at: date, status: string>>"
    r = lambda i, source, when=None: (i, None, None, when, source, None, None, "verified")
    services = spark.createDataFrame([("svc-0", [r("r1", "a"), r("r2", "b"), r("r3", "a")]), ("svc-1", [r("r1", "a"), r("r2", "gone", {"segment": ["BUILDING"]})])], f"id string, requirements {requirement}")
    sources = spark.createDataFrame([(i, f"Source {i}", "", "", "", "ok") for i in "ab"], "id string, title string, url string, publisher string, retrieved_at string, status string")
    cases = c.select(F.col("c_custkey").alias("case_id"), F.concat(F.lit("svc-"), (F.col("c_custkey") % 3).cast("string")).alias("service_id"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("answers"))
    titles = F.transform("sources", lambda s: F.coalesce(s["title"], F.lit("?")))
    return kb.checklists(services, cases, sources).select("case_id", "service_id", F.array_join(titles, "|").alias("cited"), "error")


@_query("SELECT user_id, max_by(event_type, event_id) AS last_type, max(event_id) AS event_id FROM events GROUP BY 1")
def last_per_key(t):
    return summaries.last_per_key(t("events").select("user_id", "event_id", F.col("event_type").alias("last_type")), "user_id", "event_id")


@_query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def histogram(t):
    return summaries.histogram(t("orders"), "o_orderstatus")


@_query("""SELECT 'service-' || (user_id % 20) AS service_id, count(*) AS n, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS closure_rate FROM events GROUP BY 1""")
def closure_rate(t):
    rates = reports.closure_rate(_event_reports(t), "service_id")
    return rates.withColumn("closure_rate", F.round("closure_rate", 6))


@_query("""SELECT user_id, event_type, cast(date_trunc('month', ts) AS DATE) AS month, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING count(*) >= 5""")
def published_counts(t):
    return metrics.published(t("events").withColumn("day", F.to_date("ts")), ["user_id", "event_type"], "day")


@_query("""WITH r AS (SELECT round(100.0 * count(*) FILTER (event_type = 'error' AND user_id % 2 = 0) / count(*) FILTER (user_id % 2 = 0), 1)::DOUBLE AS first_pct,
 round(100.0 * count(*) FILTER (event_type = 'error' AND user_id % 2 = 1) / count(*) FILTER (user_id % 2 = 1), 1)::DOUBLE AS second_pct FROM events)
 SELECT first_pct, second_pct, round(second_pct - first_pct, 1)::DOUBLE AS gap FROM r""")
def outcome_gap(t):
    e = t("events").withColumn("group", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    return metrics.outcome_gap(e, "group", F.col("event_type") == "error", "even", "odd")


@_query("""SELECT 'service-' || (user_id % 20) AS service_id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1 ORDER BY n DESC, service_id LIMIT 10""")
def most_requested(t):
    return metrics.most_requested(_event_reports(t), "signup")


@_query("""SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN cast(l_shipdate AS DATE) <= cast(o_orderdate AS DATE) + 60 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS on_time_rate
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def on_time_rate(t):
    due = t("orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 60).alias("due"))
    cases = t("lineitem").select("l_orderkey", "l_returnflag", F.to_date("l_shipdate").alias("closed")).join(due, F.col("l_orderkey") == F.col("o_orderkey"))
    return metrics.on_time_rate(cases, "closed", "due", "l_returnflag").withColumn("on_time_rate", F.round("on_time_rate", 6))


@_query("""SELECT c_custkey AS service_id, c_nationkey + 5 AS ente, n_name AS body FROM customer LEFT JOIN nation ON c_nationkey + 5 = n_nationkey""")
def service_bodies(t):
    """Keys shifted by five, so that some have no body."""
    services = t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 5).alias("ente"))
    bodies = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("role_it"))
    return metrics.service_bodies(services, bodies).drop("role_it")


@_query("""SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_sha256, sha256(text) AS digest, substr(text, 1, 80) AS shown FROM documents""")
def escaped_text(t):
    """The whole text escaped, by its digest; ``shown`` is cut for display (O6)."""
    return t("documents").select("doc_id", F.sha2(X.html_escape(F.col("text")), 256).alias("escaped_sha256"), F.sha2("text", 256).alias("digest"), F.substring("text", 1, 80).alias("shown"))


def _norm(x: str) -> str:
    return f"""lower(trim(regexp_replace(translate({x}, '’‘“”', '''''""'), '{_WS}', ' ', 'g')))"""



@_query("""WITH s AS (SELECT CASE WHEN p_partkey % 10 = 0 AND p_partkey > 0 THEN 'src-' || (p_partkey - 1) ELSE 'src-' || p_partkey END AS id, p_partkey AS ordinal,
 CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'page-' || (p_partkey % 400) END AS snapshot,
 CASE WHEN p_partkey % 3 = 0 THEN 'todo' WHEN p_partkey % 7 = 0 THEN NULL ELSE 'ok' END AS status FROM part),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal DESC) AS nth, min(ordinal) OVER (PARTITION BY id) AS first FROM s)
 SELECT 'V1' AS rule, 'ERROR' AS severity, 'sources: ' || id AS place, 'duplicate id' AS message FROM r WHERE ordinal > first
 UNION ALL SELECT 'V2', 'ERROR', 'sources: ' || id, 'snapshot ' || snapshot || ' not found' FROM r WHERE nth = 1 AND coalesce(snapshot, '') <> '' AND snapshot NOT IN (SELECT 'page-' || page_id FROM pages)
 UNION ALL SELECT 'V3', 'WARN', 'sources: ' || id, 'no snapshot saved' FROM r WHERE nth = 1 AND coalesce(snapshot, '') = '' AND status IS DISTINCT FROM 'todo'""")
def source_violations(t):
    k = F.col("p_partkey")
    named = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    sources = t("part").select(
        F.when((k % 10 == 0) & (k > 0), named("src-", k - 1)).otherwise(named("src-", k)).alias("id"),
        k.alias("ordinal"),
        F.when(k % 4 == 0, None).when(k % 4 == 1, "").otherwise(named("page-", k % 400)).alias("snapshot"),
        F.when(k % 3 == 0, "todo").when(k % 7 == 0, None).otherwise("ok").alias("status"),
    )
    return quality.source_checks(sources, t("pages").select(named("page-", F.col("page_id")).alias("path"), F.col("html").alias("text")))


_FACTS_SQL = f"""f AS (SELECT doc_id, 'd' || doc_id || ' requirement ''r1''' AS place, CASE WHEN doc_id % 11 = 0 THEN 'none-' || doc_id ELSE 'doc-' || doc_id END AS source_id,
 CASE WHEN doc_id % 17 = 0 THEN 'todo' WHEN doc_id % 19 = 0 THEN 'draft' ELSE 'verified' END AS status, CASE WHEN doc_id % 7 <> 0 THEN DATE '2026-01-01' + (doc_id % 300)::INTEGER END AS verified_at,
 CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN substr(text, 3, 40) WHEN 3 THEN 'not in any page ' || doc_id ELSE '  ' || substr(text, 5, 30) || ' ' END AS quote FROM documents
 UNION ALL SELECT doc_id, 'd' || doc_id || ' step ''2''', 'doc-' || doc_id, CASE WHEN doc_id % 2 = 0 THEN 'verified' ELSE 'todo' END, DATE '2026-09-01', 'never said' FROM documents)"""


def _fact_services(t) -> DataFrame:
    k, text = F.col("doc_id"), F.col("text")
    quote = F.when(k % 5 == 0, None).when(k % 5 == 1, "").when(k % 5 == 2, F.substring(text, 3, 40)).when(k % 5 == 3, F.concat(F.lit("not in any page "), k.cast("string"))).otherwise(F.concat(F.lit("  "), F.substring(text, 5, 30), F.lit(" ")))
    day = F.when(k % 7 != 0, F.date_add(F.lit("2026-01-01").cast("date"), (k % 300).cast("int")))
    name = lambda head: F.concat(F.lit(head), k.cast("string"))
    requirement = F.struct(F.lit("r1").alias("id"), F.when(k % 17 == 0, None).when(k % 19 == 0, "draft").otherwise("verified").alias("status"), F.when(k % 11 == 0, name("none-")).otherwise(name("doc-")).alias("source_id"), quote.alias("quote"), day.alias("verified_at"))
    step = F.struct(F.lit(2).alias("order"), F.when(k % 2 == 0, "verified").alias("status"), name("doc-").alias("source_id"), F.lit("never said").alias("quote"), F.lit("2026-09-01").cast("date").alias("verified_at"))
    return t("documents").select(name("d").alias("id"), F.array(requirement).alias("requirements"), F.array(step).alias("steps"))


@_query(f"""WITH {_FACTS_SQL}, k AS (SELECT 'doc-' || doc_id AS source_id, TRUE AS known, CASE WHEN doc_id % 13 <> 0 THEN {_norm("text")} END AS saved FROM documents),
 r AS (SELECT * FROM f LEFT JOIN k USING (source_id)), v AS (SELECT * FROM r WHERE known AND status = 'verified'), q AS (SELECT * FROM v WHERE coalesce(quote, '') <> '')
 SELECT 'V4' AS rule, 'ERROR' AS severity, place, 'unknown source_id ''' || source_id || '''' AS message FROM r WHERE known IS NULL
 UNION ALL SELECT 'V5', 'ERROR', place, 'verified but no date' FROM v WHERE verified_at IS NULL
 UNION ALL SELECT 'V6', 'WARN', place, 'verified more than 90 days ago' FROM v WHERE datediff('day', verified_at, DATE '2026-10-03') > 90
 UNION ALL SELECT 'V7', 'ERROR', place, 'verified but no quote' FROM v WHERE coalesce(quote, '') = ''
 UNION ALL SELECT 'V8', 'ERROR', place, 'no saved snapshot of ' || source_id FROM q WHERE saved IS NULL
 UNION ALL SELECT 'V9', 'ERROR', place, 'quote not in the saved source: ' || substr(quote, 1, 80) FROM q WHERE NOT contains(saved, {_norm("quote")})""")
def fact_violations(t):
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    sources = t("documents").select(name.alias("id"), F.col("doc_id").alias("ordinal"), name.alias("snapshot"))
    snapshots = t("documents").where("doc_id % 13 <> 0").select(name.alias("path"), "text")
    return quality.fact_checks(quality.facts(_fact_services(t)), sources, snapshots, F.lit("2026-10-03").cast("date"))


@_query(f"WITH {_FACTS_SQL} SELECT status, count(*) AS n FROM f GROUP BY 1")
def fact_statuses(t):
    return quality.status_counts(_fact_services(t))


@_query("""WITH c AS (SELECT c_custkey AS k, c_mktsegment AS segment, 'c' || c_custkey || '.json' AS file FROM customer), r AS (SELECT * FROM c WHERE k % 37 <> 0),
 w AS (SELECT k, segment, file, 'r1' AS id, 'segment' AS q FROM r UNION ALL SELECT k, segment, file, CASE WHEN k % 5 = 0 THEN 'r1' ELSE 'r2' END, CASE WHEN k % 3 = 0 THEN 'other' ELSE 'free' END FROM r)
 SELECT 'V10' AS rule, 'ERROR' AS severity, 's' || s_suppkey || '.json' AS place, 'invalid JSON' AS message FROM supplier
  WHERE NOT json_valid(CASE s_suppkey % 4 WHEN 0 THEN '{"id": "' || s_name || '"}' WHEN 1 THEN '{"id": "' || s_name WHEN 2 THEN s_name ELSE '{"id": "' || s_name || '", "n": [1, 2}' END)
 UNION ALL SELECT 'V11', 'ERROR', file, 'missing ''id''' FROM c WHERE k % 23 = 0 UNION ALL SELECT 'V11', 'ERROR', file, 'missing ''title''' FROM c WHERE k % 29 = 0
 UNION ALL SELECT 'V11', 'ERROR', file, 'missing ''deciding_questions''' FROM c WHERE k % 31 = 0 UNION ALL SELECT 'V11', 'ERROR', file, 'missing ''requirements''' FROM c WHERE k % 37 = 0
 UNION ALL SELECT 'V12', 'ERROR', file || ' requirement ''r1''', 'duplicate id' FROM r WHERE k % 5 = 0
 UNION ALL SELECT 'V13', 'ERROR', file || ' requirement ''' || id || '''', '''when'' uses unknown question ''' || q || '''' FROM w WHERE k % 31 = 0 OR q = 'other'
 UNION ALL SELECT 'V14', 'ERROR', file || ' requirement ''r1''', '''when'' values ' || segment || ' not in the options of ''segment''' FROM r WHERE k % 31 <> 0 AND segment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')""")
def service_violations(t):
    k = F.col("c_custkey")
    question = lambda i, *options: F.struct(F.lit(i).alias("id"), (F.array(*map(F.lit, options)) if options else F.lit(None).cast("array<string>")).alias("options"))
    requirement = lambda i, q, allowed: F.struct(i.alias("id"), F.create_map(q, F.array(allowed)).alias("when"))
    services = t("customer").select(
        F.concat(F.lit("c"), k.cast("string"), F.lit(".json")).alias("file"),
        F.when(k % 23 != 0, k.cast("string")).alias("id"),
        F.when(k % 29 != 0, F.col("c_name")).alias("title"),
        F.when(k % 31 != 0, F.array(question("segment", "BUILDING", "MACHINERY", "AUTOMOBILE"), question("free"))).alias("deciding_questions"),
        F.when(k % 37 != 0, F.array(requirement(F.lit("r1"), F.lit("segment"), F.col("c_mktsegment")), requirement(F.when(k % 5 == 0, "r1").otherwise("r2"), F.when(k % 3 == 0, "other").otherwise("free"), F.lit("x")))).alias("requirements"),
    )
    s, name = F.col("s_suppkey") % 4, F.col("s_name")
    whole = F.concat(F.lit('{"id": "'), name, F.lit('"}'))
    content = F.when(s == 0, whole).when(s == 1, F.concat(F.lit('{"id": "'), name)).when(s == 2, name).otherwise(F.concat(F.lit('{"id": "'), name, F.lit('", "n": [1, 2}')))
    files = t("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("file"), content.alias("content"))
    _, invalid = readers.parse_json_documents(files, schemas.BODY)
    return quality.service_checks(services, invalid)


def _cleaned(x: str) -> str:
    return f"trim(regexp_replace(replace(coalesce({x}, ''), '’', ''''), '{_WS}', ' ', 'g'), ' .;')"


_OFFICE_SQL = f"""raw AS (SELECT s_suppkey AS k, CASE s_suppkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'altro' ELSE 'Municipio  ' || (s_suppkey % 9) END AS titolo,
 CASE WHEN s_suppkey % 3 = 0 THEN '(sede via l’' || s_name || ')  INGRESSO PROVVISORIO da ' || s_nationkey || '.' WHEN s_suppkey % 3 = 1 THEN '(Sede ' || s_name || ')' ELSE s_name || ' ;' END AS indirizzo,
 CASE WHEN s_suppkey % 4 <> 0 THEN 'Infoline 02' || s_suppkey END AS telefono, CASE s_suppkey % 5 WHEN 0 THEN 'Chiuso fino al 2 marzo 2020' WHEN 1 THEN ' . ' ELSE 'Orario: dalle ' || (s_suppkey % 12) || '.' END AS orari,
 CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Accesso esclusivamente su appuntamento, anche senza necessità di registrazione.' WHEN 2 THEN 'Dal 4 MAGGIO 2021;' ELSE 'Accesso libero' END AS note FROM supplier),
 o AS (SELECT k, printf('ds549-%02d', k) AS id, try_cast(nullif(regexp_extract({_cleaned("titolo")}, 'Municipio\\s+(\\d+)', 1), '') AS INTEGER) AS municipio, {_cleaned("indirizzo")} AS a,
 {_cleaned("telefono")} AS phone, {_cleaned("orari")} AS hours, {_cleaned("note")} AS notes FROM raw),
 c AS (SELECT *, CASE WHEN k % 3 = 2 THEN a ELSE trim(regexp_extract(a, '(?i)^\\(sede\\s+(.+?)\\)', 1)) END AS address, CASE WHEN k % 3 = 0 THEN replace(trim(regexp_replace(a, '(?i)^\\(sede\\s+.+?\\)\\s*', '')), 'INGRESSO PROVVISORIO', 'Ingresso provvisorio') END AS entrance_note FROM o),
 i AS (SELECT *, list_filter([CASE WHEN municipio IS NULL THEN '{offices.ISSUES["title"].replace("'", "''")}' END, CASE WHEN phone = '' THEN '{offices.ISSUES["phone"]}' END, CASE WHEN notes = '' THEN '{offices.ISSUES["notes"]}' END,
 CASE WHEN contains(lower(entrance_note), 'provvisorio') THEN '{offices.ISSUES["entrance"]}' END, CASE WHEN k % 5 = 0 THEN '{offices.ISSUES["date"] % "2 marzo 2020"}' END, CASE WHEN k % 6 = 2 THEN '{offices.ISSUES["date"] % "4 MAGGIO 2021"}' END], lambda x: x IS NOT NULL) AS issues FROM c)"""


def _offices(t) -> DataFrame:
    k = F.col("s_suppkey")
    raw = t("supplier").select(
        k.cast("int").alias("ordinal"),
        F.when(k % 9 == 0, None).when(k % 9 == 1, "altro").otherwise(F.concat(F.lit("Municipio  "), (k % 9).cast("string"))).alias("titolo"),
        F.when(k % 3 == 0, F.concat(F.lit("(sede via l’"), "s_name", F.lit(")  INGRESSO PROVVISORIO da "), F.col("s_nationkey").cast("string"), F.lit("."))).when(k % 3 == 1, F.concat(F.lit("(Sede "), "s_name", F.lit(")"))).otherwise(F.concat("s_name", F.lit(" ;"))).alias("Indirizzo"),
        F.when(k % 4 != 0, F.concat(F.lit("Infoline 02"), k.cast("string"))).alias("telefono"),
        F.when(k % 5 == 0, "Chiuso fino al 2 marzo 2020").when(k % 5 == 1, " . ").otherwise(F.concat(F.lit("Orario: dalle "), (k % 12).cast("string"), F.lit("."))).alias("orari"),
        F.when(k % 6 == 0, None).when(k % 6 == 1, "Accesso esclusivamente su appuntamento, anche senza necessità di registrazione.").when(k % 6 == 2, "Dal 4 MAGGIO 2021;").otherwise("Accesso libero").alias("Note"),
        (k % 88).cast("string").alias("ID_NIL"),
        F.lit(" Duomo. ").alias("NIL"),
        F.lit("9.19").alias("LONG_X_4326"),
        F.lit("45.46").alias("LAT_Y_4326"),
    )
    return offices.clean_offices(raw, F.lit("2026-10-03").cast("date"))


@_query(f"""WITH {_OFFICE_SQL} SELECT id, municipio::VARCHAR AS municipio, address, entrance_note, nullif(replace(phone, 'Infoline ', ''), '') AS phone, nullif(hours, '') AS hours_it, nullif(notes, '') AS notes_it,
 CASE WHEN contains(lower(notes), 'esclusivamente su appuntamento') THEN 'true' END AS appointment_only, CASE WHEN contains(lower(notes), 'senza necessità di registrazione') THEN 'true' END AS booking_without_spid,
 'Duomo' AS nil_name, (k % 88)::INTEGER AS nil_id, array_to_string(issues, '|') AS data_issues FROM i WHERE len(issues) > 0""")
def office_rows(t):
    found = offices.flagged(_offices(t))
    as_text = (F.col(c).cast("string").alias(c) for c in ("municipio", "appointment_only", "booking_without_spid"))
    return found.select("id", *as_text, "address", "entrance_note", "phone", "hours_it", "notes_it", F.col("nil.name").alias("nil_name"), F.col("nil.id").alias("nil_id"), F.array_join("data_issues", "|").alias("data_issues"))


@_query(f"WITH {_OFFICE_SQL} SELECT 'V16' AS rule, 'DATA' AS severity, id AS place, unnest(issues) AS message FROM i")
def office_violations(t):
    return quality.office_checks(_offices(t))


@_query("""SELECT 'V15' AS rule, 'WARN' AS severity, 'link ' || page_id AS place, url || ' -> ' || CASE page_id % 4 WHEN 1 THEN '404' ELSE 'error: refused' END AS message FROM pages WHERE page_id % 4 IN (1, 2)""")
def link_violations(t):
    status = F.when(F.col("page_id") % 4 == 1, "404").when(F.col("page_id") % 4 == 2, "error: refused").when(F.col("page_id") % 4 == 3, "200")
    return quality.link_checks(t("pages").select(F.col("page_id").cast("string").alias("id"), "url", status.alias("link_status")))


@_query("SELECT DISTINCT event_type FROM events ORDER BY 1")
def distinct_values(t):
    return summaries.distinct_sorted(t("events"), "event_type")


_CODES = {"purchase": "ok", "error": "failed", "signup": ""}


@_query("""WITH e AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS simulated FROM events GROUP BY 1, 2)
 SELECT user_id, event_type, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'failed' WHEN 'signup' THEN '' END AS outcome,
 CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'failed' ELSE event_type END AS shown,
 CASE WHEN n >= 5 AND simulated > 0 THEN 'routed (simulated)' WHEN n >= 5 THEN 'routed' ELSE 'collecting' END AS routing FROM e""")
def outcome_labels(t):
    counted = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 3 == 0).alias("simulated"))
    outcome = reports.recode_outcome(F.col("event_type"), _CODES)
    return counted.select("user_id", "event_type", outcome.alias("outcome"), X.first_text(outcome, F.col("event_type")).alias("shown"), reports.routing_label(F.col("simulated"), F.col("n") >= 5).alias("routing"))


@_query("""WITH r AS (SELECT 'service-' || (user_id % 20) AS service_id, event_type = 'purchase' AS ok, cast(ts AS DATE) AS day, DATE '2024-01-10' + (user_id % 20)::INTEGER AS approved_at FROM events)
 SELECT service_id, approved_at, count(*) FILTER (day < approved_at AND NOT ok) AS wrong_before, count(*) FILTER (day < approved_at) AS n_before, count(*) FILTER (day >= approved_at AND NOT ok) AS wrong_since,
 count(*) FILTER (day >= approved_at) AS n_since, datediff('day', min(day) FILTER (NOT ok), approved_at)::INTEGER AS days_to_correct FROM r GROUP BY 1, 2""")
def correction_effect(t):
    found = t("events").select(F.concat(F.lit("service-"), (F.col("user_id") % 20).cast("string")).alias("service_id"), F.when(F.col("event_type") == "purchase", "ok").otherwise("missing").alias("outcome"), F.to_date("ts").alias("reported_on"))
    fixes = t("events").sparkSession.range(20).select(F.concat(F.lit("service-"), F.col("id").cast("string")).alias("service_id"), F.date_add(F.lit("2024-01-10").cast("date"), F.col("id").cast("int")).alias("approved_at"))
    return reports.correction_effect(found, fixes)


@_query("""SELECT 'service-' || (user_id % 20) AS service_id, event_type AS cause, count(*) AS count, (user_id % 20) % 3 = 0 AS approved FROM events WHERE event_type <> 'purchase' GROUP BY ALL""")
def approved_groups(t):
    groups = _event_reports(t).where("outcome is distinct from 'ok'").groupBy("service_id", "cause").agg(F.count("*").alias("count"))
    n = F.substring_index("service_id", "-", -1).cast("int")
    decided = groups.where(n % 3 == 0).select("service_id", "cause", F.lit(True).alias("approved"))
    return metrics.approvals(groups, decided)


@_query("SELECT '5-LOW' AS key, round(100.0 * count(*) FILTER (o_orderpriority = '5-LOW') / count(*), 1)::DOUBLE AS figure FROM orders")
def key_figure(t):
    whole = t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    shares = whole.crossJoin(whole.agg(F.sum("n").alias("all"))).select("o_orderpriority", summaries.percent(F.col("n"), F.col("all")).alias("pct"))  # one row each
    return metrics.key_figure(shares, "o_orderpriority", "5-LOW", "pct")


@_query("SELECT event_type, count(*) AS n, round(avg(user_id % 5 + 1), 6)::DOUBLE AS satisfaction FROM events WHERE event_id % 4 <> 0 GROUP BY 1")
def satisfaction(t):
    answers = t("events").select("event_type", F.when(F.col("event_id") % 4 != 0, F.col("user_id") % 5 + 1).alias("score"))
    return metrics.satisfaction(answers, "score", "event_type").withColumn("satisfaction", F.round("satisfaction", 6))


@_query("""SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN text END, '' ORDER BY turn) AS said FROM conversations GROUP BY 1""")
def joined_blocks(t):
    block = F.struct("turn", F.when(F.col("role") == "user", "text").otherwise("tool_use").alias("type"), "text")
    grouped = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))  # a conversation is a row
    return grouped.select("conv_id", X.or_null(X.text_of_blocks(F.col("blocks"))).alias("said"))


@_query("""SELECT event_id AS step, CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN '2 items' ELSE '1 object' END AS returned FROM events""")
def trace_summary(t):
    output = F.when(F.col("event_id") % 3 == 0, F.lit('{"error": "none"}')).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), "props", F.lit(", {}]"))).otherwise(F.col("props"))
    return metrics.trace_summary(t("events").select(F.col("event_id").alias("step"), F.lit("tool").alias("tool"), output.alias("output"))).drop("tool")
