"""Rolling weeks, runs, joins on time, differences of versions, each by brute force; streams against the batch."""

import datetime as dt
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quaystone.operators import temporal, windows
from quaystone.sources import schemas
from quaystone.streaming import alerts, intake, reports

DAY = dt.date(2026, 1, 5)  # a Monday


def some_reports(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day = DAY + dt.timedelta(rng.randrange(0, 120))
        service = "hot" if i % 3 == 0 else rng.choice(["s1", "s2", "s3", None])
        rows.append({"service_id": service, "outcome": rng.choice(["ok", "missing", "missing", None]), "cause": rng.choice(["pagina-incompleta", "non-seguita", None]), "summary_it": "", "summary_en": "", "week": "", "simulated": rng.choice([True, False, None]), "reported_at": dt.datetime.combine(day, dt.time(rng.randrange(24), 30))})
    return rows


def brute_rolling(rows, weeks, threshold=5):
    counts, simulated = Counter(), Counter()
    for r in rows:
        if r["outcome"] != "ok" and r["reported_at"] is not None:
            day = r["reported_at"].date()
            week = day - dt.timedelta(day.weekday())
            for k in range(weeks):
                key = (week + dt.timedelta(7 * k), r["service_id"], r["cause"])
                counts[key] += 1
                simulated[key] += bool(r["simulated"])
    return {(*k, n, simulated[k], n >= threshold) for k, n in counts.items()}


@pytest.mark.parametrize("weeks", [1, 3])
def test_rolling_weeks(spark, weeks):
    rows = some_reports() + [{**some_reports(1)[0], "reported_at": None, "outcome": "missing"}]
    df = spark.createDataFrame(rows, schemas.REPORT_EVENT)
    got = [tuple(r) for r in windows.rolling_groups(df, "reported_at", weeks).collect()]
    assert set(got) == brute_rolling(rows, weeks) and len(got) == len(set(got))
    first = {(r["service_id"], r["cause"]): r["week_start"] for r in windows.first_crossings(windows.rolling_groups(df, "reported_at", weeks), "service_id", "cause").collect()}
    want = defaultdict(list)
    for week, service, cause, _, _, over in brute_rolling(rows, weeks):
        if over:
            want[service, cause].append(week)
    assert first == {k: min(v) for k, v in want.items()}
    assert windows.rolling_groups(df.limit(0), "reported_at", weeks).count() == 0


def write_lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({k: v.isoformat() if isinstance(v, dt.datetime) else v for k, v in r.items()}) + "\n" for r in rows))


def test_closed_windows_of_the_stream_are_the_batch(spark, tmp_path):
    rows = sorted(some_reports(), key=lambda r: r["reported_at"])
    end = {**rows[0], "outcome": "missing", "service_id": "end", "reported_at": dt.datetime(2027, 6, 1)}  # moves the watermark on
    for i in range(4):
        write_lines(tmp_path / "in", f"{i}.json", rows[100 * i : 100 * (i + 1)])
    write_lines(tmp_path / "in", "x.json", [end])
    stream = reports.rolling_groups(reports.report_stream(spark, str(tmp_path / "in"), files_at_once=1), weeks=3, late="1 days")
    assert stream.isStreaming
    reports.write_groups(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert set(got) == brute_rolling(rows, 3) and len(got) == len(set(got))
    batch = {tuple(r) for r in windows.rolling_groups(spark.createDataFrame(rows, schemas.REPORT_EVENT), "reported_at", 3).collect()}
    assert set(got) == batch


@pytest.mark.parametrize(("gap", "width"), [(1, 512), (1, 4), (3, 5), (3, 512)])
def test_runs(spark, gap, width):
    rng = random.Random(gap)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(-40, 40)) for _ in range(60)] + [("hot", p) for p in (*range(200), *range(205, 300), 304)] * 2 + [("a", None)]
    got = [tuple(r) for r in windows.runs(spark.createDataFrame(rows, "k string, w int"), ["k"], "w", gap, width).collect()]
    places = defaultdict(Counter)
    for k, w in rows:
        if w is not None:
            places[k][w] += 1
    want = []
    for k, c in places.items():
        run = []
        for w in [*sorted(c), None]:
            if run and (w is None or w - run[-1] > gap):
                want.append((k, run[0], run[-1], sum(c[x] for x in run), len(run)))
                run = []
            run.append(w)
    assert sorted(got, key=str) == sorted(want, key=str)
    with pytest.raises(ValueError):
        windows.runs(spark.createDataFrame(rows, "k string, w int"), ["k"], "w", 4, 4)


def test_hot_key_in_several_tasks(spark):
    """A key with half of all rows: the windows of runs and of carried totals see at most a slice of it."""
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), F.col("id"), F.lit(1).cast("long").alias("one"))
    cut = windows.sliced(df, ["k"], "id", 16)
    assert cut.groupBy("k", "_slice").count().agg(F.max("count")).first()[0] <= 20_000 / 2 / 16 + 1
    total = windows.carried_total(df, ["k"], "id", "one", slices=16).where("k = 'hot'").select("id", "before").collect()
    assert {r["before"] for r in total} == set(range(10_000)) and all(r["before"] == r["id"] // 2 for r in total)
    gap = windows.carried_gap(df, ["k"], "id", F.lit(30_000).cast("long"), slices=16).where("k = 'hot'").groupBy("gap").count().collect()
    assert {(r["gap"], r["count"]) for r in gap} == {(2, 9_999), (30_000 - 19_998, 1)}
    same = df.limit(3).withColumn("id", F.lit(5).cast("long"))
    assert windows.sliced(same, ["k"], "id", 4).select("_slice").distinct().count() == 1


@pytest.mark.parametrize("most", [10**6, 3])
@pytest.mark.parametrize("width", ["day", "month"])
def test_as_of_join(spark, monkeypatch, most, width):
    monkeypatch.setattr(temporal, "HOT_GROUPS", 10**6)
    rng = random.Random(4)
    left = [(i, rng.choice(["hot", "hot", "a", "b", "none", None]), None if i % 40 == 0 else DAY + dt.timedelta(rng.randrange(90))) for i in range(300)]
    right = [(rng.choice(["hot", "a", "b", None, "other"]), None if i % 20 == 0 else DAY + dt.timedelta(rng.randrange(-40, 90)), i) for i in range(120)]
    got = temporal.as_of_join(spark.createDataFrame(left, "id long, k string, day date").repartition(5), spark.createDataFrame(right, "k string, since date, fix long").repartition(3), ["k"], "day", "since", width, most)
    assert got.columns == ["id", "k", "day", "since", "fix"]
    want = []
    for i, k, day in left:
        held = [(since, fix) for key, since, fix in right if day is not None and since is not None and key == k and since <= day]
        want.append((i, k, day, *(max(held) if held else (None, None))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = spark.createDataFrame([], "k string, since date, fix long")
    assert {r["fix"] for r in temporal.as_of_join(spark.createDataFrame(left, "id long, k string, day date"), none, ["k"], "day", "since").collect()} == {None}


def test_effects_of_several_corrections(spark):
    day = lambda n: DAY + dt.timedelta(n)
    found = spark.createDataFrame([("s", "missing", day(0)), ("s", "ok", day(3)), ("s", "missing", day(12)), ("s", None, day(20)), ("t", "ok", day(1))], "service_id string, outcome string, reported_on date")
    fixes = spark.createDataFrame([("s", day(3)), ("s", day(12))], "service_id string, approved_at date")
    got = {(r["service_id"], r["approved_at"]): (r["n"], r["wrong"], r["days"]) for r in temporal.effect_in_force(found, fixes).collect()}
    assert got == {("s", None): (1, 1, None), ("s", day(3)): (1, 0, 0.0), ("s", day(12)): (2, 2, 4.0), ("t", None): (1, 0, None)}


@pytest.mark.parametrize("width", [1, 7])
def test_interval_join(spark, width):
    rng = random.Random(width)
    points = [(i, rng.choice(["a", "hot", "hot", None]), None if i % 50 == 0 else rng.randrange(-300, 5000)) for i in range(400)]
    spans = []
    for j in range(150):
        start = rng.randrange(-500, 5000)
        spans.append((j, rng.choice(["a", "hot", None]), None if j % 17 == 0 else start, None if j % 13 == 0 else start + rng.choice([-3, 0, 1, 5, 100, 3000, 10**9])))
    got = temporal.interval_join(spark.createDataFrame(points, "id long, k string, t long"), spark.createDataFrame(spans, "span long, k string, a long, b long"), ["k"], "t", "a", "b", width)
    want = {(i, j) for i, k, t in points for j, k2, a, b in spans if k is not None and k == k2 and t is not None and (a is None or a <= t) and (b is None or t < b)}
    rows = [(r["id"], r["span"]) for r in got.select("id", "span").collect()]
    assert set(rows) == want and len(rows) == len(want) > 500
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    empty = spark.createDataFrame([], "span long, k string, a long, b long")
    assert temporal.interval_join(spark.createDataFrame(points, "id long, k string, t long"), empty, ["k"], "t", "a", "b").count() == 0


def test_long_spans_are_copied_a_bounded_number_of_times(spark, capsys):
    spans = spark.createDataFrame([(1, "k", 0, 10**9), (2, "k", 5, 6)], "span long, k string, a long, b long")
    points = spark.createDataFrame([(1, "k", 5)], "id long, k string, t long")
    joined = temporal.interval_join(points, spans, ["k"], "t", "a", "b")
    assert joined.count() == 2
    joined.explain("formatted")
    assert "SortMergeJoin" in (said := capsys.readouterr().out) or "HashJoin" in said
    for length in (1, 63, 64, 65, 5000, 10**8):
        level = next((i for i in range(temporal.LEVELS - 1) if length <= temporal.PIECES * temporal.FACTOR ** (i + 1)), temporal.LEVELS - 1)
        assert length / temporal.FACTOR**level <= temporal.PIECES * temporal.FACTOR + 1


def test_differences(spark):
    schema = "id string, quote string, day date, n int"
    old = [("a", "q1", DAY, 1), ("b", "q2", None, 2), ("c", "q3", DAY, 3), ("d", "same", None, 4), ("e", "same", None, 4), (None, "n", DAY, 0), ("gone", "x", None, 9)]
    new = [("a", "q1", DAY, 1), ("b", "q2", DAY, 7), ("C", "q3", DAY, 3), ("d2", "same", None, 4), (None, "m", DAY, 0), ("new", "y", None, 1)]
    got = {(r["change"], r["id"], r["old_key"]["id"] if r["old_key"] else None, tuple(r["fields"] or ())) for r in temporal.differences(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["id"]).collect()}
    assert got == {("changed", "b", None, ("day", "n")), ("moved", "C", "c", ()), ("removed", "d", None, ()), ("removed", "e", None, ()), ("added", "d2", None, ()), ("changed", None, None, ("quote",)), ("removed", "gone", None, ()), ("added", "new", None, ())}
    same = spark.createDataFrame(old, schema)
    assert temporal.differences(same, same, ["id"]).count() == 0


# Streams with state

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def bad(service, day, n=1, outcome="missing"):
    return [{"service_id": service, "outcome": outcome, "cause": "c", "summary_it": "", "summary_en": "", "week": "", "simulated": False, "reported_at": dt.datetime.combine(DAY + dt.timedelta(day), dt.time(12))} for _ in range(n)]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(ROCKS[0])
    spark.conf.set(*ROCKS)
    yield
    spark.conf.set(ROCKS[0], before)


def test_first_crossing_alerts_once(spark, tmp_path, rocks):
    def run():
        stream = alerts.first_crossings(reports.report_stream(spark, str(tmp_path / "in"), files_at_once=1), late="30 days", window_days=10, quiet_days=40)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    write_lines(tmp_path / "in", "0.json", bad("early", 0, 5) + bad("slow", 0, 4) + bad("fine", 0, 9, "ok") + bad("late", 2, 2))
    first = [("early", "c", DAY, 5)]
    assert run() == first
    write_lines(tmp_path / "in", "1.json", bad("early", 3, 9) + bad("slow", 12, 4) + bad("late", 12, 2))
    assert run() == first  # restarted from the checkpoint: no second alert; four and four don't lie within ten days
    write_lines(tmp_path / "in", "2.json", bad("late", 6, 2) + bad("slow", 14, 1))  # arrives after day 12, within the watermark
    second = sorted([*first, ("late", "c", DAY + dt.timedelta(12), 5 - 1), ("slow", "c", DAY + dt.timedelta(14), 5)])
    got = run()
    assert [r[:3] for r in got if r[0] != "late"] == [r[:3] for r in second if r[0] != "late"]
    write_lines(tmp_path / "in", "3.json", bad("late", 8, 1))
    assert [r for r in run() if r[0] == "late"] == [("late", "c", DAY + dt.timedelta(8), 5)]
    write_lines(tmp_path / "in", "4.json", bad("clock", 200, 1))
    write_lines(tmp_path / "in", "5.json", bad("clock", 201, 1))  # quiet groups are forgotten by then
    write_lines(tmp_path / "in", "6.json", bad("early", 201, 5))
    assert [r for r in run() if r[0] == "early"] == [*first, ("early", "c", DAY + dt.timedelta(201), 5)]


def note(i, text="no page about it", day=0, service="s1"):
    return {"report_id": f"r{i}", "service_id": service, "outcome": "missing", "note": text, "reported_at": dt.datetime.combine(DAY + dt.timedelta(day), dt.time(9))}


def test_log_as_a_stream(spark, tmp_path):
    secret = "Maria Rossi was sent to the wrong office"
    write_lines(tmp_path / "in", "0.json", [note(1, secret), note(2), note(1, secret)])
    write_lines(tmp_path / "in", "1.json", [note(1, secret, day=1), note(3, "it was old"), {**note(4), "reported_at": None}, note(5, None)])

    def run():
        intake.append_log(intake.classified(intake.note_stream(spark, str(tmp_path / "in"), files_at_once=1)), str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
        return sorted((r["report_id"], r["cause"]) for r in spark.read.json(str(tmp_path / "log")).collect())

    want = [("r1", "ufficio-sbagliato"), ("r2", "procedura-mancante"), ("r3", "procedura-non-aggiornata"), ("r5", "pagina-incompleta")]
    assert run() == want
    assert run() == want  # nothing new
    files = [f for f in tmp_path.rglob("*") if f.is_file() and "in" not in f.relative_to(tmp_path).parts[:1]]
    assert not any(b"Rossi" in f.read_bytes() for f in files) and len(files) > 5
    assert "note" not in spark.read.json(str(tmp_path / "log")).columns


def test_a_batch_replayed_leaves_the_same_rows(spark, tmp_path):
    write = intake.write_once(str(tmp_path / "log"))
    batch = spark.createDataFrame([("r1", "c"), ("r2", None)], "report_id string, cause string")
    write(batch, 0)
    write(batch.limit(1), 1)
    write(batch, 1)  # the first try of batch 1 had failed half-way
    write(batch, 1)
    assert sorted((r["report_id"], r["batch"]) for r in spark.read.json(str(tmp_path / "log")).collect()) == [("r1", 0), ("r1", 1), ("r2", 0), ("r2", 1)]
