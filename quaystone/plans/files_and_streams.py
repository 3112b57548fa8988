"""Queries whose rows go through files, versions or a stream and are read back, and small functions of the panel, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from quaystone.functions import text as X
from quaystone.operators import kb, metrics, reports, tools
from quaystone.plans.registry import query
from quaystone.sources import readers, schemas, sinks
from quaystone.sources.shared import new_folder
from quaystone.sources.versions import VersionedTable
from quaystone.streaming import intake
from quaystone.streaming import reports as stream_reports


@query("""SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS c_name, CASE c_custkey % 3 WHEN 0 THEN 'says "' || c_name || '", twice' WHEN 1 THEN 'two' || chr(10) || 'lines' ELSE 'è; ' || c_mktsegment END AS remark FROM customer""")
def csv_files(t):
    """Written as CSV files, a file a task, and read back: quotes, line ends in fields, nulls."""
    c, k = t("customer"), F.col("c_custkey")
    remark = F.when(k % 3 == 0, F.concat(F.lit('says "'), "c_name", F.lit('", twice'))).when(k % 3 == 1, "two\nlines").otherwise(F.concat(F.lit("è; "), "c_mktsegment"))
    rows = c.select("c_custkey", F.when(k % 7 != 0, F.col("c_name")).alias("c_name"), remark.alias("remark"))
    path = new_folder(c.sparkSession, "csv")
    rows.write.options(header=True, quote='"', escape='"').csv(path)
    return readers.read_csv(c.sparkSession, path)


@query("""SELECT 'service-' || (user_id % 20) AS service_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS cause, event_id % 3 = 0 AS simulated, count(*) AS n FROM events GROUP BY ALL""")
def appended_log(t):
    """Reports appended to a log of JSON lines in two writes, and read back with an explicit schema; a log that isn't there is empty."""
    e = t("events")
    spark, path = e.sparkSession, new_folder(e.sparkSession, "log")
    before = readers.read_jsonl(spark, path, schemas.REPORT)
    rows = e.select(F.concat(F.lit("service-"), (F.col("user_id") % 20).cast("string")).alias("service_id"), F.lit(None).cast("string").alias("outcome"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("cause"), (F.col("event_id") % 3 == 0).alias("simulated"), "event_id")
    for half in (0, 1):
        sinks.append_jsonl(rows.where(F.col("event_id") % 2 == half).drop("event_id"), path)
    after = readers.read_jsonl(spark, path, schemas.REPORT)
    return before.union(after).groupBy("service_id", "cause", "simulated").agg(F.count("*").alias("n"))


@query("""SELECT 's' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN 'r' || s_nationkey END AS role_it FROM supplier""")
def json_documents(t):
    """One JSON document a file, and all files of the folder read back."""
    s = t("supplier")
    spark, path = s.sparkSession, new_folder(s.sparkSession, "documents")
    rows = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("r"), F.col("s_nationkey").cast("string"))).alias("role_it"))
    sinks.write_json_documents(rows, path)
    found, _ = readers.read_json_documents(spark, path, schemas.BODY, nested=True)
    return found.select("id", "name", "role_it")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 6 = 0 THEN 'checked' WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'new' END AS status, s_name AS name, 3::BIGINT AS version FROM supplier""")
def keyed_updates(t):
    """Three versions of a table: the rows, then two updates by key, each an atomic commit; the last of a row's changes stays."""
    s = t("supplier")
    table = VersionedTable(s.sparkSession, new_folder(s.sparkSession, "table"))
    rows = s.select(F.col("s_suppkey").alias("id"), F.lit("new").alias("status"), F.col("s_name").alias("name"))
    table.commit(rows, table.latest())
    table.update(rows.where("id % 4 = 0").select("id", F.lit(None).cast("string").alias("status")), "id")
    version = table.update(rows.where("id % 6 = 0").select("id", F.lit("checked").alias("status")), "id")
    return table.read().withColumn("version", F.lit(version).cast("long"))


_NOTES = {0: "sent to the wrong office", 1: "The page is OLD", 2: "there is no page for it", 3: "they asked for a stamp", 4: "I did not read it", 5: ""}
_NOTE_CAUSES = {0: "ufficio-sbagliato", 1: "procedura-non-aggiornata", 2: "procedura-mancante", 3: "richiesta-non-prevista", 4: "non-seguita", 5: "pagina-incompleta", 6: "pagina-incompleta"}
_CAUSE_SQL = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in _NOTE_CAUSES.items()) + " END"


def _notes(t) -> DataFrame:
    said = F.element_at(F.create_map(*(F.lit(x) for kv in _NOTES.items() for x in kv)), (F.col("event_id") % 7).cast("int"))
    return t("events").select("event_id", F.concat(F.lit("service-"), (F.col("user_id") % 20).cast("string")).alias("service_id"), F.when(F.col("event_type") == "purchase", "ok").otherwise("missing").alias("outcome"), said.alias("note"), F.to_date("ts").alias("day"), "ts")


@query(f"""SELECT event_id, 'service-' || (user_id % 20) AS service_id, CASE WHEN event_type = 'purchase' THEN 'ok' ELSE 'missing' END AS outcome, {_CAUSE_SQL} AS cause, 'Segnalazione: ' || cause AS summary_it, 'Report: ' || cause AS summary_en, strftime(ts, '%G-W%V') AS week, false AS simulated FROM events""")
def classified_notes(t):
    """Causes from notes by the fixed rules; every seventh report has no note."""
    return reports.classify(_notes(t), keep=("event_id",))


_LABELS = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in c)) for c in schemas.CAUSES)


@query(f"""WITH l(cause, cause_label, recipient) AS (VALUES {_LABELS}), r AS (SELECT 'service-' || (user_id % 20) AS service_id, {_CAUSE_SQL} AS cause FROM events WHERE event_type <> 'purchase')
 SELECT service_id, cause, cause_label, recipient, count(*) AS count, 'Fix for ' || service_id || ': ' || cause_label AS draft, false AS approved FROM r JOIN l USING (cause) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5""")
def drafted_fixes(t):
    """The default table of causes, groups over the threshold, and a draft for each by a writer."""
    found = reports.classify(_notes(t))
    groups = reports.report_groups(found, reports.causes(found.sparkSession)).where("over_threshold")
    drafts = reports.draft_fixes(groups, lambda g: f"Fix for {g['service_id']}: {g['cause_label']}")
    return drafts.select("service_id", "cause", "cause_label", "recipient", "count", "draft", "approved")


@query("""SELECT 'service-' || (user_id % 20) AS service_id, event_type AS cause, count(*) AS count FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2 ORDER BY count DESC, service_id, cause LIMIT 15""")
def largest_groups(t):
    """The first fifteen groups in the report's order."""
    e = t("events").where("event_type <> 'purchase'")
    counted = e.groupBy(F.concat(F.lit("service-"), (F.col("user_id") % 20).cast("string")).alias("service_id"), F.col("event_type").alias("cause")).agg(F.count("*").alias("count"))
    return reports.ordered(counted).limit(15)


@query("""SELECT c_custkey AS case_id, CASE WHEN c_custkey % 2 = 0 THEN 'r1,r2,r3' WHEN c_mktsegment = 'BUILDING' THEN 'r1,r2' ELSE 'r1' END AS applies, '' AS not_yet_verified FROM customer""")
def checklist_drafts(t):
    """Checklists with drafts: nothing is left out for not being verified yet."""
    c = t("customer")
    spark = c.sparkSession
    r = lambda i, when, status: (i, None, None, when, "src", None, None, status)
    services = spark.createDataFrame([("s", None, None, None, None, None, [r("r1", {}, "todo"), r("r2", {"segment": ["BUILDING"], "any": ["yes"]}, "draft"), r("r3", {"any": ["yes"]}, None)], None, None)], schemas.SERVICE)
    sources = spark.createDataFrame([("src", "Source", "", "", "", "", "", "ok", "")], schemas.SOURCE)
    even = F.col("c_custkey") % 2 == 0
    segment = F.when(even, "BUILDING").otherwise(F.col("c_mktsegment"))
    services = services.withColumn("requirements", F.transform("requirements", lambda x: F.when(x["id"] == "r2", x.withField("when", F.map_filter(x["when"], lambda k, v: k == "segment"))).otherwise(x)))
    cases = c.select(F.col("c_custkey").alias("case_id"), F.lit("s").alias("service_id"), F.create_map(F.lit("segment"), segment, F.lit("any"), F.when(even, "yes").otherwise("no")).alias("answers"))
    out = kb.checklists(services, cases, sources, include_drafts=True)
    return out.select("case_id", F.array_join(F.transform("requirements", lambda r: r["id"]), ",").alias("applies"), F.array_join("not_yet_verified", ",").alias("not_yet_verified"))


@query("SELECT 'src-' || p_partkey AS id, p_name AS title, p_brand AS publisher FROM part WHERE p_partkey = 17")
def source_lookup(t):
    blank = F.lit("")
    sources = t("part").select(F.concat(F.lit("src-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), blank.alias("url"), F.col("p_brand").alias("publisher"), blank.alias("retrieved_at"), F.lit("ok").alias("status"))
    return kb.get_source(sources, "src-17").select("id", "title", "publisher")


@query("""SELECT o_orderkey, format('{:,}', o_orderkey * 1009) AS shown, upper(substr(replace(o_orderpriority, '-', ' '), 1, 1)) || lower(substr(replace(o_orderpriority, '-', ' '), 2)) AS label,
 greatest(1000.0::DOUBLE, least(200000.0::DOUBLE, o_totalprice)) AS held, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def small_functions(t):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t("orders").select("o_orderkey", X.thousands(F.col("o_orderkey") * 1009).alias("shown"), X.sentence_case(F.col("o_orderpriority")).alias("label"), X.clamp(F.col("o_totalprice"), 1000.0, 200000.0).alias("held"), X.date_part_of(stamp).alias("day"))


@query("""WITH r AS (SELECT 'service-' || (user_id % 20) AS service_id, count(*) AS n, avg(CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS before, avg(CASE WHEN event_type = 'purchase' AND event_id % 2 = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS after FROM events GROUP BY 1)
 SELECT service_id, round(greatest(before - after, 0.0::DOUBLE) * n * 12.5, 4)::DOUBLE AS avoided FROM r""")
def avoided_costs(t):
    rate = lambda odd: F.avg(F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 2 == odd), 1.0).otherwise(0.0))
    r = t("events").groupBy(F.concat(F.lit("service-"), (F.col("user_id") % 20).cast("string")).alias("service_id")).agg(F.count("*").alias("n"), rate(0).alias("before"), rate(1).alias("after"))
    return r.select("service_id", F.round(metrics.avoided_cost(F.col("before"), F.col("after"), F.col("n"), F.lit(12.5)), 4).alias("avoided"))


@query("SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_name DESC, s_suppkey)::INTEGER AS ordinal FROM supplier")
def ordinals(t):
    return readers.with_ordinal(t("supplier").select("s_suppkey", "s_name"), F.desc("s_name"), "s_suppkey")


@query(r"""SELECT page_id, sha256('<!-- source: src-' || page_id || chr(10) || '     url: ' || url || chr(10) || '     retrieved: 2026-10-03' || chr(10) || '     html sha256: ' || substr(sha256(html), 1, 16) || ' -->' || chr(10) || chr(10) || html) AS snapshot_sha256 FROM pages""")
def page_snapshots(t):
    """Saved pages with their provenance on top, by their digests."""
    saved = sinks.page_snapshot(F.concat(F.lit("src-"), F.col("page_id").cast("string")), F.col("url"), F.lit("2026-10-03"), F.col("html"), F.col("html"))
    return t("pages").select("page_id", F.sha2(saved, 256).alias("snapshot_sha256"))


@query(r"""SELECT o_orderkey, array_to_string(['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//quaystone//reminders//EN', 'BEGIN:VEVENT', 'UID:o' || o_orderkey, 'DTSTAMP:20261003T000000Z', 'DTSTART;VALUE=DATE:' || strftime(o_orderdate, '%Y%m%d'),
 'DTEND;VALUE=DATE:' || strftime(cast(o_orderdate AS DATE) + 1, '%Y%m%d'), 'SUMMARY:' || o_orderpriority || '\, at noon', 'DESCRIPTION:first\nsecond\; third', 'END:VEVENT', 'END:VCALENDAR', ''], chr(13) || chr(10)) AS calendar FROM orders""")
def calendars(t):
    day = F.to_date("o_orderdate")
    made = sinks.calendar_document(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), day, F.concat("o_orderpriority", F.lit(", at noon")), F.lit("first\nsecond; third"), F.lit("2026-10-03 00:00:00").cast("timestamp"))
    return t("orders").select("o_orderkey", made.alias("calendar"))


@query("""WITH r AS (SELECT 'service-' || (user_id % 20) AS service_id, event_type AS cause, event_id % 3 = 0 AS simulated, ts FROM events WHERE event_type <> 'purchase'),
 w AS (SELECT service_id, cause, date_trunc('week', ts)::DATE + 7 * later::INTEGER AS week_start, count(*) AS n, count(*) FILTER (simulated) AS s FROM r, range(0, 2) x(later) GROUP BY ALL)
 SELECT week_start, service_id, cause, n AS count, s AS simulated, n >= 5 AS over_threshold FROM w WHERE (week_start + 7)::TIMESTAMP <= (SELECT max(ts) - INTERVAL 1 DAY FROM r)""")
def stream_rolling_weeks(t):
    """Two weeks that end with each week, over a stream of files: the windows that the watermark has closed."""
    e = t("events")
    spark, folder = e.sparkSession, new_folder(e.sparkSession, "stream")
    rows = e.select(F.concat(F.lit("service-"), (F.col("user_id") % 20).cast("string")).alias("service_id"), F.when(F.col("event_type") == "purchase", "ok").otherwise("missing").alias("outcome"), F.col("event_type").alias("cause"), (F.col("event_id") % 3 == 0).alias("simulated"), F.col("ts").alias("reported_at"))
    rows.write.json(f"{folder}/in")
    windows = stream_reports.rolling_groups(stream_reports.report_stream(spark, f"{folder}/in"), weeks=2, late="1 days")
    stream_reports.write_groups(windows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(f"""SELECT 'r' || (event_id // 2) AS report_id, min('service-' || ((event_id // 2) % 20)) AS service_id, any_value({_CAUSE_SQL.replace("event_id % 7", "(event_id // 2) % 7")}) AS cause FROM events GROUP BY 1""")
def stream_log(t):
    """Every report sent twice: classified in flight, written once, without its note."""
    e = t("events")
    spark, folder, twin = e.sparkSession, new_folder(e.sparkSession, "intake"), F.floor(F.col("event_id") / 2)
    said = F.element_at(F.create_map(*(F.lit(x) for kv in _NOTES.items() for x in kv)), (twin % 7).cast("int"))
    rows = e.select(F.concat(F.lit("r"), twin.cast("string")).alias("report_id"), F.concat(F.lit("service-"), (twin % 20).cast("string")).alias("service_id"), F.lit("missing").alias("outcome"), said.alias("note"), F.col("ts").alias("reported_at"))
    rows.write.json(f"{folder}/in")
    intake.append_log(intake.classified(intake.note_stream(spark, f"{folder}/in"), late="60 days"), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    log = spark.read.schema("report_id string, service_id string, cause string").json(f"{folder}/log")
    return log.select("report_id", "service_id", "cause")


_FOUND = "v AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'ERROR' ELSE 'WARN' END AS severity, 'V' || (p_partkey % 9) AS rule, 'part ' || p_partkey AS place, p_name AS message FROM part WHERE p_partkey % 3 = 0)"


def _violations(t) -> DataFrame:
    k = F.col("p_partkey")
    return t("part").where(k % 3 == 0).select(F.concat(F.lit("V"), (k % 9).cast("string")).alias("rule"), F.when(k % 5 == 0, "ERROR").otherwise("WARN").alias("severity"), F.concat(F.lit("part "), k.cast("string")).alias("place"), F.col("p_name").alias("message"))


@query(f"WITH {_FOUND} SELECT rpad(severity, 5, ' ') || ' ' || place || ': ' || message AS line FROM v")
def violation_lines(t):
    return sinks.report_lines(_violations(t))


@query(f"WITH {_FOUND} SELECT 1::INTEGER AS code, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARN') AS warnings FROM v")
def exit_codes(t):
    return sinks.exit_code(_violations(t))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey END AS nation FROM supplier")
def json_array(t):
    """A table as one JSON array in part files, read back line by line: each between the brackets is an element."""
    s = t("supplier")
    path = new_folder(s.sparkSession, "array")
    sinks.write_json_array(s.select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")).alias("nation")), path, "s_suppkey")
    lines = s.sparkSession.read.text(path).where("value not in ('[', ']')")
    return lines.select(F.from_json(F.ltrim("value", F.lit(",")), "s_suppkey long, s_name string, nation long").alias("x")).select("x.*")


@query("""SELECT 1::INTEGER AS ordinal, 's' || s_suppkey AS id, '- s' || s_suppkey || ': ' || s_name || ' (' || (s_suppkey % 3) || '/2 requirements verified)' AS line FROM supplier
 UNION ALL SELECT 0, NULL, 'Services covered:' UNION ALL SELECT 2, NULL, 'Registry offices: ' || count(*) || '.' FROM customer""")
def knowledge_index(t):
    s, k = t("supplier"), F.col("s_suppkey")
    one = lambda i: F.struct(F.lit(f"r{i}").alias("id"), F.when(k % 3 > i, "verified").otherwise("todo").alias("status"))
    services = s.select(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.struct(F.col("s_name").alias("it")).alias("title"), F.array(one(0), one(1)).alias("requirements"))
    return kb.index_lines(services, t("customer"))


@query("""WITH c AS (SELECT c_custkey AS call_id, CASE c_custkey % 5 WHEN 0 THEN 'get_source' WHEN 1 THEN 'get_service' WHEN 2 THEN 'get_checklist' WHEN 3 THEN 'find_offices' ELSE 'dance' END AS tool, c_custkey % 7 AS a FROM customer)
 SELECT call_id, tool, CASE tool WHEN 'get_source' THEN CASE WHEN a < 3 THEN '{"id":"k' || a || '","title":"Source ' || a || '","url":"","publisher":"","retrieved_at":"","status":"ok"}' ELSE '{"error":"Unknown source_id"}' END
  WHEN 'get_service' THEN CASE WHEN a < 2 THEN '{"id":"k' || a || '","title":{"it":"T' || a || '","en":null},"ente":null,"deciding_questions":null,"steps":null,"unknowns_it":null}' ELSE '{"error":"Unknown service_id"}' END
  WHEN 'get_checklist' THEN CASE WHEN a < 2 THEN 'still to ask: q' ELSE '{"error":"Unknown service ' || chr(39) || 'k' || a || chr(39) || '"}' END
  WHEN 'find_offices' THEN CASE WHEN a = 1 THEN '[{"id":"o1","address":"via 1","phone":null},{"id":"o2","address":"via 2","phone":"02"}]' ELSE '[]' END ELSE '{"error":"Unknown tool dance"}' END AS result FROM c""")
def tool_calls(t):
    """Calls of the tools, many at once: known and unknown ids, and a tool that there isn't. Of checklists the open question is shown."""
    c, k = t("customer"), F.col("c_custkey")
    spark = c.sparkSession
    tool = F.element_at(F.array(*map(F.lit, ("get_source", "get_service", "get_checklist", "find_offices", "dance"))), (k % 5 + 1).cast("int"))
    key = F.concat(F.lit("k"), (k % 7).cast("string"))
    calls = c.select(k.alias("call_id"), tool.alias("tool"), F.create_map(F.lit("source_id"), key, F.lit("service_id"), key, F.lit("municipio"), (k % 7).cast("string")).alias("arguments"))
    services = spark.createDataFrame([(f"k{i}", (f"T{i}", None), None, None, None, None, [("r", None, None, {"q": ["a"]}, "k0", None, None, "verified")], None, None) for i in range(2)], schemas.SERVICE)
    sources = spark.createDataFrame([(f"k{i}", f"Source {i}", "", "", "", "", "", "ok", "") for i in range(3)], schemas.SOURCE)
    offices = spark.createDataFrame([("o1", 1, "via 1", None), ("o2", 1, "via 2", "02")], "id string, municipio int, address string, phone string")
    answered = tools.answer_calls(calls, services, offices, sources)
    open_ = F.get_json_object("result", "$.still_to_ask[0]")
    return answered.withColumn("result", F.when((F.col("tool") == "get_checklist") & open_.isNotNull(), F.concat(F.lit("still to ask: "), open_)).otherwise(F.col("result")))
