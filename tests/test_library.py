import collections
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quaystone.functions import dates, geo, html
from quaystone.functions import text as X
from quaystone.operators import kb, metrics, offices, quality, reports, summaries
from quaystone.operators.tools import DECLARATIONS, KnowledgeBase, answer_calls
from quaystone.plans import files_and_streams
from quaystone.sources import readers, schemas, sinks
from quaystone.streaming import reports as stream


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "want"), [(None, ""), ("  l’ora  di  punta. ;", "l'ora di punta"), ("a\nb", "a b"), ("", "")])
def test_clean(spark, raw, want):
    assert one(spark, X.clean, raw) == want


def test_normalise(spark):
    assert one(spark, X.normalise, " “L’ORA” È ") == "\"l'ora\" è"


@pytest.mark.parametrize(("raw", "seat", "note"), [("(sede via Larga 12) INGRESSO PROVVISORIO da Via X 3", "via Larga 12", "Ingresso provvisorio da Via X 3"), ("(SEDE viale Y 1)", "viale Y 1", None), ("via Padova 118", "via Padova 118", None)])
def test_seat_and_entrance(spark, raw, seat, note):
    a, b = X.seat_and_entrance(F.col("x"))
    assert tuple(spark.createDataFrame([(raw,)], "x string").select(a.alias("a"), b.alias("b")).first()) == (seat, note)


def test_past_dates(spark):
    as_of = F.lit(dt.date(2026, 10, 3))
    said = "Chiuso dal 1 Agosto 2026 al 3 ottobre 2026, poi 31 febbraio 2020 e 4 OTTOBRE 2025"
    assert one(spark, lambda x: X.past_dates(x, as_of), said) == ["1 Agosto 2026", "4 OTTOBRE 2025"]


def test_small_text_functions(spark):
    assert one(spark, X.sentence_case, "carta-di IDENTITÀ") == "Carta di identità"
    assert one(spark, X.html_escape, "<a & 'b'>") == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert one(spark, lambda x: X.number_after(x, "Municipio"), "Municipio 12") == 12
    assert one(spark, lambda x: X.number_after(x, "Municipio"), "altro") is None
    assert one(spark, lambda x: X.true_if_says(x, "su appuntamento"), "Solo SU APPUNTAMENTO") is True
    assert one(spark, lambda x: X.true_if_says(x, "su appuntamento"), "no") is None


def test_split_options(spark):
    text, options = X.split_options(F.col("x"))
    rows = spark.createDataFrame([("Quale?\nOptions: a | b || \n",), ("senza",)], "x string").select(text.alias("t"), options.alias("o")).collect()
    assert [tuple(r) for r in rows] == [("Quale?", ["a", "b"]), ("senza", [])]


def test_after_last_marker(spark):
    kinds = ["text", "thinking", "fallback", "tool_use", "text"]
    row = spark.createDataFrame([([(k,) for k in kinds],)], "x array<struct<type:string>>")
    assert [b["type"] for b in row.select(X.after_last_marker(F.col("x")).alias("y")).first()["y"]] == ["text", "fallback", "tool_use", "text"]


def test_dates(spark):
    assert one(spark, dates.iso_week, dt.date(2027, 1, 1), "date") == "2026-W53"
    as_of = F.lit(dt.date(2026, 10, 3))
    assert one(spark, lambda x: dates.is_stale(x, as_of), dt.date(2026, 7, 5), "date") is False  # exactly 90 days
    assert one(spark, lambda x: dates.is_stale(x, as_of), dt.date(2026, 7, 4), "date") is True
    assert [r["day"] for r in one(spark, dates.reminders, dt.date(2026, 3, 1), "date")] == [dt.date(2026, 2, 26), dt.date(2026, 3, 1)]


def test_haversine(spark):
    assert abs(one(spark, lambda x: geo.haversine_km(x, F.lit(9.0), x + 1, F.lit(9.0)), 45.0, "double") - 111.19) < 0.02


def test_page_text():
    page = "<html><nav>no</nav><h2>Titolo</h2><p>a&nbsp; b<br>c<script>x<style>y</style></script></p><ul><li>uno<li>due</ul>\n\n\n\n<div>&amp;amp;</div>"
    assert html.page_text(page) == "## Titolo\n\na b\nc\n\n- uno\n- due\n\n&\n"


@pytest.mark.parametrize(("page", "text"), [("<p>Offices</p>Fish & chips at AT&T", "Offices\nFish & chips at AT&T\n"), ("<p>open text &copy", "open text ©\n"), ("a < b", "a < b\n"), ("end &amp", "end &\n"), ("<p>x</p>tail <b", None), ("<p>x</p><!-- never closed", None), ("y <script>z", "y\n")])
def test_unfinished_tails_stay(page, text):
    """What the parser holds back at the end of a page is text too; an element or comment that never closes adds none."""
    assert html.page_text(page) == text if text else html.page_text(page).startswith("x")


def test_page_text_details():
    assert html.page_text("a</nav>b<svg><svg>x</svg>y</svg>c<H3>d</H3>e") == "abc\n### d\ne\n"
    assert html.page_text("") == "\n" and html.page_text("&amp;lt;b&amp;gt; &eacute;") == "<b> é\n"
    assert html.visible_lines("<nav><li>x</li></nav><h5>t</h5>") == ["", "- ", "", "t", ""]


def test_ground_quotes_of_any_length(spark, monkeypatch):
    texts = ["here are two words only", "Here ARE  two", "a party of five and more words here", None, "", "x “y” z w v"]
    quotes = ["two words", "art", "are two words only", "five and more words here", "no such words in any text", "", None, '"y"', "X 'y", "of five and"]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    q = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string")
    plain = lambda x: x.replace("“", '"').replace("”", '"').lower().strip()
    want = {(i, j) for i, a in enumerate(quotes) for j, b in enumerate(texts) if a is not None and b is not None and plain(a) in " ".join(plain(b).split())}
    for size in (quality.AUTOMATON_BYTES, 60):  # one automaton, several
        monkeypatch.setattr(quality, "AUTOMATON_BYTES", size)
        got = [tuple(r) for r in quality.ground_quotes(q, t).collect()]
        assert set(got) == want and len(got) == len(want)
    assert quality.ground_quotes(q.limit(0), t).count() == 0


def test_duplicates_by_aggregation(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), (None, 5), (None, 4), ("b", 1)], "k string, n long")
    assert sorted((str(r["k"]), r["n"]) for r in quality.duplicates(df, ["k"], "n").collect()) == [("None", 5), ("a", 2), ("a", 3)]


def test_summaries_labels_and_blocks(spark):
    df = spark.createDataFrame([("b", None, 7), ("a", "", 2), ("b", "t", 9)], "k string, t string, n long")
    assert [r[0] for r in summaries.distinct_sorted(df, "k").collect()] == ["a", "b"]
    assert [r["f"] for r in df.select(X.first_text(F.col("t"), F.col("k")).alias("f")).collect()] == ["b", "a", "t"]
    assert [r["o"] for r in df.select(reports.recode_outcome(F.col("k"), {"a": "ok"}).alias("o")).collect()] == [None, "ok", None]
    label = reports.routing_label(F.when(F.col("k") == "a", 1).otherwise(0), F.col("n") > 1)
    assert [r["l"] for r in df.select(label.alias("l")).collect()] == ["routed", "routed (simulated)", "routed"]
    blocks = spark.createDataFrame([([("text", "a"), ("tool_use", "x"), ("text", "b")],)], "b array<struct<type string, text string>>")
    assert blocks.select(X.text_of_blocks(F.col("b"))).first()[0] == "ab"
    scores = spark.createDataFrame([("s", 4), ("s", None), ("s", 5), ("t", None)], "service_id string, score int")
    assert [tuple(r) for r in metrics.satisfaction(scores, "score", "service_id").collect()] == [("s", 2, 4.5)]


def test_status_counts(base_tables):
    assert {(r["status"], r["n"]) for r in quality.status_counts(base_tables[0]).collect()} == {("verified", 6), ("draft", 2)}


def test_pages_and_ordinals(spark):
    assert readers.fetch_page("u", lambda u: ("é\xff".encode("latin-1"), "latin-1")) == "éÿ" and readers.fetch_page("u", lambda u: (b"a\xff", "utf-8")) == "a\ufffd"
    row = spark.range(1).select(sinks.page_snapshot(F.lit("s1"), F.lit("http://x"), F.lit("2026-01-01"), F.lit("<p>a</p>"), F.lit("a\n"))).first()[0]
    assert row.startswith("<!-- source: s1\n") and "retrieved: 2026-01-01\n" in row and row.endswith(" -->\n\na\n") and len(row.split("sha256: ")[1].split(" ")[0]) == 16
    numbered = readers.with_ordinal(spark.range(0, 100, 1, 7)).collect()
    assert [r["ordinal"] for r in sorted(numbered, key=lambda r: r["id"])] == list(range(1, 101))
    assert [r["ordinal"] for r in readers.with_ordinal(spark.createDataFrame([(3,), (1,)], "x int"), "x").orderBy("x").collect()] == [1, 2]


def test_csv_sniffed(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿titolo;Numerosità;x\n\"a \"\"b\"\" c\";1;\n".encode())
    rows = readers.read_csv_sniffed(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["titolo", "Numerosità", "x"]
    assert tuple(rows.first()) == ('a "b" c', "1", None)
    (tmp_path / "b.csv").write_bytes("a,b;c\nl’ora,2;3\n".encode("cp1252"))
    got = readers.read_csv_sniffed(spark, str(tmp_path / "b.csv"))
    assert got.columns == ["a", "b;c"] and got.first()[0] == "l’ora"
    assert set(readers.read_csv_folder(spark, str(tmp_path), register=False)) == {"a", "b"}


def test_json_readers(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text(json.dumps({"id": "s1", "title": {"it": "uno"}, "requirements": [{"id": "r", "when": {"q": ["x"]}}]}))
    (tmp_path / "s/b.json").write_text(json.dumps({"id": "s1", "title": {"it": "due"}}))
    (tmp_path / "s/c.json").write_text("{oops")
    good, invalid = readers.read_json_documents(spark, str(tmp_path / "s"), schemas.SERVICE)
    assert [r["title"]["it"] for r in good.collect()] == ["due"] and [r["file"] for r in invalid.collect()] == ["c.json"]
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), schemas.REPORT).count() == 0
    (tmp_path / "r.jsonl").write_text('{"service_id":"s"}\n\n{"service_id":"t"}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "r.jsonl"), schemas.REPORT).count() == 2
    (tmp_path / "t.txt").write_bytes(b"a\xffb")
    assert readers.read_texts(spark, str(tmp_path / "t.txt")).first()["text"] == "a�b"


def test_json_texts(spark):
    texts = spark.createDataFrame([("a", '{"id": "x", "name": "n"}'), ("b", '{"id": "x"'), ("c", None), ("d", "plain"), ("e", "{}"), ("f", "")], "file string, content string")
    good, invalid = readers.parse_json_documents(texts, schemas.BODY)
    assert sorted((r["file"], r["id"]) for r in good.collect()) == [("a", "x"), ("e", None)]
    assert sorted(tuple(r) for r in invalid.collect()) == [(f, "invalid JSON") for f in "bcdf"]


def test_json_documents_are_dealt_over_tasks(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(files_and_streams, "new_folder", lambda spark, name: str(tmp_path / "query"))
    rows = files_and_streams.json_documents(lambda name: spark.read.parquet(f"{sf}/{name}.parquet")).count()
    files = list((tmp_path / "query").rglob("*.json"))
    assert len(files) == rows > 1 and len({f.parent for f in files}) > 1


@pytest.mark.parametrize("scheme", ["file", "viewfs"])
def test_json_documents_written(spark, tmp_path, monkeypatch, scheme):
    monkeypatch.setattr(sinks, "FILES_A_FOLDER", 10)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.docs.link./x", f"file://{tmp_path}")
    at = {"file": str(tmp_path), "viewfs": "viewfs://docs/x"}[scheme]
    said = ['says "x"', "two\nlines", "è; 漢", None, ""]
    rows = [(f"s{i}", said[i % 5], {"q": [said[i % 3]]}, f"r{i}") for i in range(200)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, name string, `when` map<string,array<string>>, folder string")
    sinks.write_json_documents(df.repartition(3), f"{at}/a b")
    sinks.write_json_documents(df.coalesce(1), f"{at}/again")
    sinks.write_json_documents(df.limit(0), f"{at}/none")
    trees = [{str(f.relative_to(tmp_path / d)): json.loads(f.read_text()) for f in (tmp_path / d).rglob("*.json")} for d in ("a b", "again", "none")]
    whole = sorted(json.dumps({k: v for k, v in zip(df.columns, r) if v is not None}) for r in rows)
    assert sorted(map(json.dumps, trees[0].values())) == sorted(map(json.dumps, trees[1].values())) == whole and not trees[2]
    folders = collections.Counter(name.split("/")[0] for name in trees[0])
    assert len(folders) > 10 and max(folders.values()) < 40
    if scheme == "file":  # a task that is run again writes the same documents under the same names
        assert trees[0] == trees[1] and not [f for f in (tmp_path / "a b").rglob(".*") if not f.name.endswith(".crc")]
        assert readers._document_texts(spark, f"{at}/a b").rdd.getNumPartitions() == len(folders) + 1
    good, invalid = readers.read_json_documents(spark, f"{at}/a b", df.schema, nested=True)
    assert sorted(map(str, good.select(*df.columns).collect())) == sorted(map(str, df.collect())) and not invalid.collect()
    assert readers.read_json_documents(spark, f"{at}/none", df.schema, nested=True)[0].count() == 0


def test_json_documents_in_subfolders(spark, tmp_path):
    for name, text in {"a/2.json": '{"id": "x", "name": "first"}', "b/1.json": '{"id": "x", "name": "last"}', "b/2.json": "{oops"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    good, invalid = readers.read_json_documents(spark, str(tmp_path), schemas.BODY, nested=True)
    assert [r["name"] for r in good.collect()] == ["last"] and [r["file"].endswith("/b/2.json") for r in invalid.collect()] == [True]


def test_ckan_and_links(spark):
    answers = {"https://p/api/3/action/package_show?id=ds1": (json.dumps({"result": {"resources": [{"format": "JSON", "url": "j"}, {"format": "csv", "url": "c"}]}}).encode(), "utf-8"), "c": (b"a;b\n", "utf-8")}
    chosen, body = readers.ckan_csv("https://p/", "ds1", answers.__getitem__)
    assert chosen["url"] == "c" and body == b"a;b\n"
    links = spark.createDataFrame([("a", "u1"), ("b", None)], "id string, url string")
    checked = readers.url_status(links, status=lambda u: "404")
    assert {(r["id"], r["link_status"]) for r in checked.collect()} == {("a", "404"), ("b", None)}
    assert [r["rule"] for r in quality.link_checks(checked).collect()] == ["V15"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None, "x"), ("b", "1", "y")], "id string, snapshot string, n string")
    assert json.loads(sinks.to_json_document(df, "id"))[0] == {"id": "a", "snapshot": None, "n": "x"}
    changed = sinks.update_rows(df, spark.createDataFrame([("a", "new")], "id string, snapshot string"), "id").orderBy("id").collect()
    assert [tuple(r) for r in changed] == [("a", "new", "x"), ("b", "1", "y")]
    emptied = sinks.update_rows(df, spark.createDataFrame([("b", None)], "id string, snapshot string"), "id").orderBy("id").collect()
    assert [tuple(r) for r in emptied] == [("a", None, "x"), ("b", None, "y")]
    sinks.write_csv(df, str(tmp_path / "o"))
    assert readers.read_csv(spark, str(tmp_path / "o")).count() == 2
    sinks.append_jsonl(df, str(tmp_path / "l"))
    sinks.append_jsonl(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    day = F.lit(dt.date(2026, 3, 1))
    ics = df.limit(1).select(sinks.calendar_document(F.lit("u"), day, F.lit("Carta, oggi"), F.lit("a\nb"), F.lit(dt.datetime(2026, 1, 2, 3, 4, 5)))).first()[0]
    assert "DTEND;VALUE=DATE:20260302\r\n" in ics and "SUMMARY:Carta\\, oggi\r\n" in ics and "DESCRIPTION:a\\nb\r\n" in ics and "DTSTAMP:20260102T030405Z" in ics
    sinks.write_json_array(df.repartition(3), str(tmp_path / "a"), "id")
    parts = "".join(f.read_text() for f in sorted((tmp_path / "a").glob("part-*")))
    assert json.loads(parts) == [{"id": "a", "snapshot": None, "n": "x"}, {"id": "b", "snapshot": "1", "n": "y"}]
    sinks.write_json_array(df.limit(0), str(tmp_path / "e"), "id")
    assert json.loads("".join(f.read_text() for f in sorted((tmp_path / "e").glob("part-*")))) == []
    assert tuple(sinks.exit_code(df.limit(0).selectExpr("id as severity")).first()) == (0, 0, 0)
    lines, code = sinks.report(spark.createDataFrame([("V1", "ERROR", "p", "m")], "rule string, severity string, place string, message string"))
    assert lines == ["ERROR p: m"] and code == 1


def test_arrivals_share(spark):
    rows = spark.createDataFrame([("2024", "Estero", 19755), ("2024", "Altro", 27198), ("2023", "Altro", 5), ("2022", "Altro", 0)], "year string, place string, n long")
    got = {r["year"]: (r["part"], r["total"], r["share_pct"]) for r in summaries.share_by(rows, "year", F.col("n"), F.col("place") == "Estero").collect()}
    assert got == {"2024": (19755, 46953, 42.1), "2023": (0, 5, 0.0), "2022": (0, 0, None)}


def test_ranked_top_has_no_shared_ranks(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 2), ("c", 6)], "k string, n long")
    assert [(r["k"], r["rank"], r["share_pct"]) for r in summaries.top_share(rows, "n", "k", 2).orderBy("rank").collect()] == [("c", 1, 60.0), ("a", 2, 20.0)]


def test_report_groups(spark):
    rows = [("s", "missing", "pagina-incompleta", f"it{i % 7}", f"en{i % 7}", "2026-W01", None) for i in range(5)] + [("s", None, "non-seguita", "x", "y", "2026-W01", True), ("s", "ok", "non-seguita", "x", "y", "2026-W01", True)]
    table = spark.createDataFrame(rows, schemas.REPORT)
    got = reports.ordered(reports.report_groups(table, reports.causes(spark))).collect()
    assert [(r["cause"], r["count"], r["simulated"], r["over_threshold"]) for r in got] == [("pagina-incompleta", 5, 0, True), ("non-seguita", 1, 1, False)]
    assert got[0]["examples_en"] == ["en0", "en1", "en2", "en3", "en4"]
    assert reports.suppressed(reports.report_groups(table, reports.causes(spark))).count() == 1
    wrong = spark.createDataFrame([("s", "missing", "no-such", "", "", "", False)], schemas.REPORT)
    with pytest.raises(Exception, match="unknown cause"):
        reports.report_groups(wrong, reports.causes(spark)).collect()


def test_classification_keeps_no_note(spark):
    notes = spark.createDataFrame([("s", "missing", "Mi chiamo Anna: wrong office", dt.date(2026, 1, 5))], "service_id string, outcome string, note string, day date")
    row = reports.classify(notes).first()
    assert row["cause"] == "ufficio-sbagliato" and row["week"] == "2026-W02" and "note" not in row.asDict() and "Anna" not in str(row)
    drafts = reports.draft_fixes(reports.report_groups(reports.classify(notes), reports.causes(spark)).select("service_id", "count"), lambda g: f"{g['service_id']}:{g['count']}")
    assert tuple(drafts.first()) == ("s", 1, "s:1", False)


def test_correction_effect(spark):
    rows = spark.createDataFrame([("s", "missing", dt.date(2026, 1, 1)), ("s", "ok", dt.date(2026, 1, 2)), ("s", "ok", dt.date(2026, 1, 10))], "service_id string, outcome string, reported_on date")
    fix = spark.createDataFrame([("s", dt.date(2026, 1, 8))], "service_id string, approved_at date")
    r = reports.correction_effect(rows, fix).first()
    assert (r["wrong_before"], r["n_before"], r["wrong_since"], r["n_since"], r["days_to_correct"]) == (1, 2, 0, 1, 7)


RAW = [
    ("Municipio 1", "(sede via Larga 12) INGRESSO PROVVISORIO da Via P 3", "Infoline 020202", "Orario: dalle 8.", "Accesso esclusivamente su appuntamento, anche senza necessità di registrazione.", "1", "DUOMO", "9.19", "45.46", ""),
    (None, "via B 2", None, "Chiuso fino al 2 marzo 2020", None, "2", "BRERA", "9.2", "45.5", ""),
]


@pytest.fixture(scope="module")
def cleaned(spark):
    return offices.clean_offices(readers.with_ordinal(spark.createDataFrame(RAW, schemas.RAW_OFFICE).coalesce(1)), F.lit(dt.date(2026, 10, 3))).cache()


def test_clean_offices(cleaned):
    a, b = cleaned.orderBy("id").collect()
    assert (a["id"], a["municipio"], a["address"], a["entrance_note"], a["phone"], a["hours_it"]) == ("ds549-01", 1, "via Larga 12", "Ingresso provvisorio da Via P 3", "020202", "Orario: dalle 8")
    assert a["appointment_only"] and a["booking_without_spid"] and a["data_issues"] == [offices.ISSUES["entrance"]]
    assert (b["municipio"], b["phone"], b["notes_it"], b["appointment_only"]) == (None, None, None, None)
    assert b["data_issues"] == [offices.ISSUES["title"], offices.ISSUES["phone"], offices.ISSUES["notes"], offices.ISSUES["date"] % "2 marzo 2020"]
    assert offices.flagged(cleaned).count() == 2


def test_find_offices(cleaned):
    assert [r["id"] for r in kb.find_offices(cleaned, area="LARGA").collect()] == ["ds549-01"]
    assert kb.find_offices(cleaned, municipio=9).count() == 0
    near = kb.find_offices(cleaned, area="", lat=45.5, lon=9.2, limit=1).first()
    assert near["id"] == "ds549-02" and near["distance_km"] == 0.0
    assert "distance_km" not in kb.find_offices(cleaned, lat=45.5).columns


def service(requirements, steps=(), questions=(("q1", ["a", "b"]), ("q2", None)), sid="s1"):
    return {"id": sid, "title": {"it": "Carta", "en": "Card"}, "ente": "comune", "deciding_questions": [{"id": q, "options": o} for q, o in questions], "requirements": requirements, "steps": list(steps), "unknowns_it": []}


def req(rid, when=None, status="verified", source="src", quote="x", day=dt.date(2026, 9, 1)):
    return {"id": rid, "text_it": rid, "text_en": None, "when": when, "source_id": source, "quote": quote, "verified_at": day, "status": status}


@pytest.fixture(scope="module")
def base_tables(spark):
    services = spark.createDataFrame([service([req("always"), req("match", {"q1": ["a"]}), req("other", {"q1": ["b"]}), req("open", {"q2": ["z"]}), req("both", {"q1": ["b"], "q2": ["z"]}), req("draft", {}, "draft")], [{"order": 1, "status": "verified", "source_id": "src", "text_it": "passo", "ente": "c", "quote": None, "verified_at": None}, {"order": 2, "status": "draft", "source_id": "src", "text_it": "p2", "ente": "c", "quote": None, "verified_at": None}])], schemas.SERVICE)
    sources = spark.createDataFrame([("src", "Fonte", "u", "p", "page", "snap.txt", "2026-01-01", "ok", "")], schemas.SOURCE)
    return services, sources


def test_checklist_truth_table(base_tables):
    services, sources = base_tables
    r = kb.get_checklist(services, sources, "s1", {"q1": "a", "nobody": "asks"}).first()
    assert [x["id"] for x in r["requirements"]] == ["always", "match"]
    assert r["still_to_ask"] == ["q2"] and r["not_yet_verified"] == ["draft"] and [s["id"] for s in r["sources"]] == ["src"] and r["error"] is None
    assert [x["id"] for x in kb.get_checklist(services, sources, "s1", {"q1": "a"}, include_drafts=True).first()["requirements"]] == ["always", "match", "draft"]
    assert kb.get_checklist(services, sources, "none", {}).first()["error"]


def test_services_and_tools(spark, base_tables, cleaned):
    services, sources = base_tables
    assert tuple(kb.list_services(services).select("verified_requirements", "total_requirements").first()) == (5, 6)
    assert [s["order"] for s in kb.get_service(services, "s1").first()["steps"]] == [1]
    tools = KnowledgeBase(services, cleaned, sources)
    assert len(DECLARATIONS) == 5
    assert json.loads(tools.run("get_source", {"source_id": "no"})) == {"error": "Unknown source_id"}
    assert json.loads(tools.run("get_checklist", {"service_id": "s1", "answers": {"q1": "b", "q2": "z"}}))["still_to_ask"] == []
    assert len(json.loads(tools.run("find_offices", {"limit": 1}))) == 1
    assert "error" in json.loads(tools.run("get_service", {})) and "error" in json.loads(tools.run("nothing", {}))
    assert "Carta (5/6" in kb.index_text(services, cleaned)
    asked = [("1", "get_source", {"source_id": "no"}), ("2", "get_source", {}), ("3", "get_checklist", {"service_id": "s1", "q1": "b", "q2": "z"}), ("4", "get_checklist", {"service_id": "gone"}), ("5", "get_checklist", {}), ("6", "list_services", {}), ("7", "nothing", {}), ("8", "get_service", {"service_id": "s1"}), ("9", "find_offices", {"municipio": "99"})]
    got = {r["call_id"]: json.loads(r["result"]) for r in answer_calls(spark.createDataFrame(asked, "call_id string, tool string, arguments map<string,string>"), services, cleaned, base_tables[1]).collect()}
    assert len(got) == 9 and all("error" in got[i] for i in "12457") and got["9"] == []
    for i, name, arguments in (("3", "get_checklist", {"service_id": "s1", "answers": {"q1": "b", "q2": "z"}}), ("6", "list_services", {}), ("8", "get_service", {"service_id": "s1"})):
        assert got[i] == json.loads(tools.run(name, arguments))


CASES = {
    "V4": dict(requirements=[req("r", source="no")]),
    "V5": dict(requirements=[req("r", day=None)]),
    "V6": dict(requirements=[req("r", day=dt.date(2026, 7, 4))]),
    "V7": dict(requirements=[req("r", quote="")]),
    "V8": dict(requirements=[req("r", source="bare")]),
    "V9": dict(requirements=[req("r", quote="not there")]),
    "V12": dict(requirements=[req("r"), req("r")]),
    "V13": dict(requirements=[req("r", {"q9": ["a"]})]),
    "V14": dict(requirements=[req("r", {"q1": ["c"]})]),
    None: dict(requirements=[req("r", {"q1": ["a"], "q2": ["free"]}, day=dt.date(2026, 7, 5)), req("t", status="todo", quote=None)]),
}


@pytest.mark.parametrize("rule", list(CASES), ids=str)
def test_each_rule_alone(spark, rule):
    services = spark.createDataFrame([service(CASES[rule]["requirements"])], schemas.SERVICE).withColumn("file", F.lit("s.json"))
    sources = readers.with_ordinal(spark.createDataFrame([("src", "", "", "", "", "snap", "", "ok", ""), ("bare", "", "", "", "", None, "", "todo", "")], schemas.SOURCE))
    snapshots = spark.createDataFrame([("snap", "Testo  X “qui”")], "path string, text string")
    invalid = spark.createDataFrame([], "file string, error string")
    assert [r["rule"] for r in quality.validate(sources, snapshots, services, invalid, F.lit(dt.date(2026, 10, 3))).collect()] == ([rule] if rule else [])


def test_manifest_and_file_rules(spark, cleaned):
    sources = readers.with_ordinal(spark.createDataFrame([("a", "", "", "", "", "gone", "", "ok", ""), ("b", "", "", "", "", None, "", "ok", ""), ("b", "", "", "", "", None, "", "ok", ""), ("c", "", "", "", "", "", "", "todo", "")], schemas.SOURCE))
    snapshots = spark.createDataFrame([], "path string, text string")
    assert sorted(r["rule"] for r in quality.source_checks(sources, snapshots).collect()) == ["V1", "V2", "V3"]
    services = spark.createDataFrame([service([]) | {"title": None}], schemas.SERVICE).withColumn("file", F.lit("s.json"))
    invalid = spark.createDataFrame([("x.json", "invalid JSON")], "file string, error string")
    assert sorted(r["rule"] for r in quality.service_checks(services, invalid).collect()) == ["V10", "V11"]
    assert quality.office_checks(cleaned).count() == 5


def scans(df):
    """Scans of the plan that would run (a reused exchange counts once)."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Scan ")


def test_rules_in_one_pass(spark, tmp_path):
    """Facts, sources and snapshots are each read once for V4 to V9; services once for V11 to V14; sources twice and snapshots once for V1 to V3."""
    tables = {
        "services": spark.createDataFrame([service([req("r"), req("r", {"q1": ["c"]})])], schemas.SERVICE).withColumn("file", F.lit("s.json")),
        "sources": readers.with_ordinal(spark.createDataFrame([("src", "", "", "", "", "snap", "", "ok", "")], schemas.SOURCE)),
        "snapshots": spark.createDataFrame([("snap", "Testo")], "path string, text string"),
        "invalid": spark.createDataFrame([], "file string, error string"),
    }
    t = {}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
        t[name] = spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")
    facts = quality.fact_checks(quality.facts(t["services"]), t["sources"], t["snapshots"], F.lit(dt.date(2026, 10, 3)))
    assert scans(facts) == 3 and "NestedLoop" not in facts._jdf.queryExecution().toString()
    assert scans(quality.service_checks(t["services"], t["invalid"])) == 2
    assert scans(quality.source_checks(t["sources"], t["snapshots"])) == 3


def test_weekly_groups_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [{"service_id": "s", "outcome": "missing", "cause": "c", "reported_at": f"2026-01-0{d}T10:00:00"} for d in (5, 6, 7)] + [{"service_id": "s", "outcome": "ok", "cause": "c", "reported_at": "2026-01-06T00:00:00"}, {"service_id": "s", "outcome": "missing", "cause": "c", "reported_at": "2026-03-02T00:00:00"}]
    (folder / "a.json").write_text("\n".join(map(json.dumps, lines)))
    (folder / "b.json").write_text(json.dumps(lines[-1] | {"reported_at": "2026-03-03T00:00:00"}))
    groups = stream.weekly_groups(stream.report_stream(spark, str(folder), 1), threshold=3)
    stream.write_groups(groups, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(str(r["week_start"]), r["count"], r["over_threshold"]) for r in rows] == [("2026-01-05 00:00:00", 3, True)]


def test_metrics(spark):
    groups = spark.createDataFrame([("s", "c", 7), ("t", "c", 2)], "service_id string, cause string, count long")
    decided = metrics.approvals(groups, spark.createDataFrame([("s", "c", True)], "service_id string, cause string, approved boolean"))
    assert {(r["service_id"], r["approved"]) for r in decided.collect()} == {("s", True), ("t", False)}
    trace = spark.createDataFrame([(1, "find_offices", "[{}, {}]"), (2, "get_source", '{"error": "x"}'), (3, "get_service", '{"id": 1}')], "step int, tool string, output string")
    assert [r["returned"] for r in metrics.trace_summary(trace).orderBy("step").collect()] == ["2 items", "error", "1 object"]
    assert metrics.key_figure(groups, "service_id", "s", "count").first()["figure"] == 7
    cost = spark.range(1).select(metrics.avoided_cost(F.lit(0.3), F.lit(0.2), F.lit(100), F.lit(20.0)).alias("c"), X.thousands(F.lit(19755)).alias("t"), X.clamp(F.lit(2.0), 1.0, 1.3).alias("k"), X.date_part_of(F.lit("2026-10-03T10:00")).alias("d")).first()
    assert (round(cost["c"], 6), cost["t"], cost["k"], cost["d"]) == (200.0, "19,755", 1.3, "2026-10-03")
