"""Cubes that give no withheld cell away, merging sketches, layers, versioned tables, portals."""

import datetime as dt
import hashlib
import hmac
import http.server
import itertools
import json
import random
import threading
import urllib.parse
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quaystone.operators import publish
from quaystone.sources import portal, versions

DIMS = ["service", "office", "cause"]


def cube_rows(seed, sizes, n, skew=2.0):
    rng = random.Random(seed)
    pick = lambda k, head: f"{head}{min(int(k * rng.random() ** skew), k - 1)}" if rng.random() > 0.02 else None
    return [(*(pick(k, h) for k, h in zip(sizes, "soc", strict=True)), rng.random() < 0.4) for _ in range(n)]


def rebuilt(withheld, dims):
    """Cells among ``withheld`` blocks that the sums determine: whoever knows all published cells, which blocks are withheld, and that all else is empty.

    Unknowns are all cells of withheld blocks, empty ones too; an equation says that the values of a dimension sum to their total.
    """
    unknown = {c: i for i, c in enumerate(withheld)}
    lines = {(d, c[:d] + (None,) + c[d + 1 :]) for c in unknown for d in range(dims)}
    rows = []
    for d, line in lines:
        row = np.zeros(len(unknown))
        for c, i in unknown.items():
            if c[:d] + (None,) + c[d + 1 :] == line:
                row[i] = -1.0 if c[d] == "*" else 1.0
        rows.append(row)
    a = np.array(rows)
    _, s, vt = np.linalg.svd(a)
    null = vt[(s > 1e-9).sum() :]
    return [c for c, i in unknown.items() if np.abs(null[:, i]).max(initial=0) < 1e-9]


@pytest.mark.parametrize(("seed", "sizes", "n"), [(1, (4, 3, 2), 120), (2, (5, 4, 3), 300), (3, (1, 2, 6), 60), (4, (3, 1, 1), 12), (5, (6, 5, 2), 800), (6, (2, 2, 2), 30)])
def test_no_withheld_cell_can_be_rebuilt(spark, seed, sizes, n):
    rows = cube_rows(seed, sizes, n)
    df = spark.createDataFrame(rows, "service string, office string, cause string, ok boolean").repartition(3)
    cells = publish.withheld_cells(publish.outcome_cube(df, DIMS, F.col("ok")), DIMS).collect()
    name = lambda r: tuple("*" if r["level"] >> (2 - i) & 1 else f"={r[d]}" for i, d in enumerate(DIMS))
    counts, oks = Counter(), Counter()
    for *values, ok in rows:
        for summed in itertools.product((False, True), repeat=3):
            c = tuple("*" if s else f"={v}" for s, v in zip(summed, values, strict=True))
            counts[c] += 1
            oks[c] += ok
    assert {name(r): (r["n"], r["n_ok"]) for r in cells} == {c: (k, oks[c]) for c, k in counts.items()} and len(cells) == len(counts)
    small = {c for c, k in counts.items() if k < publish.THRESHOLD}
    withheld = {name(r) for r in cells if r["withheld"]}
    assert small <= withheld
    shown = {name(r): r["closure_rate"] for r in publish.published_cube(df, DIMS, F.col("ok")).collect()}
    assert set(shown) == set(counts) - withheld and all(abs(v - oks[c] / counts[c]) < 1e-6 for c, v in shown.items())
    # Blocks, recomputed: the cells that go with a withheld one, present or not.
    groups = []
    for d in range(3):
        values = Counter({c[d]: k for c, k in counts.items() if all(x == "*" for i, x in enumerate(c) if i != d) and c[d] != "*"})
        order = sorted(values, key=lambda v: (-values[v], v != "=None", v))
        number = {v: (i + 1) // 2 for i, v in enumerate(order)}
        if len(order) % 2 == 0:
            number[order[-1]] -= 1
        groups.append({**number, "*": 0})
    block = lambda c: tuple(g[x] for g, x in zip(groups, c, strict=True))
    blocks = {block(c) for c in small}
    every = [c for c in itertools.product(*groups) if block(c) in blocks]
    assert withheld == {c for c in every if c in counts}
    if every:
        assert rebuilt(every, 3) == []


def test_without_complements_cells_could_be_rebuilt():
    """The attempt to rebuild does find a cell that stands alone in its line."""
    assert rebuilt([("=a", "=x", "=u")], 3) == [("=a", "=x", "=u")]


def test_sketches_merge_and_are_read_alone(spark, tmp_path):
    rng = random.Random(2)
    rows = [(dt.datetime(2026, 1, 1 + i % 9, 3), "hot" if i % 2 else rng.choice("ab"), rng.randrange(3000), float(rng.randrange(10_000)) if i % 50 else None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "at timestamp, k string, who long, days double")
    folder, path = str(tmp_path / "rows"), str(tmp_path / "sketches")
    df.write.parquet(folder)
    stored = spark.read.parquet(folder)
    publish.store_sketches(stored.where("at < '2026-01-06'"), path, "at", ["k"], "who", "days")
    first = spark.read.parquet(path).select("day").distinct().count()
    publish.store_sketches(stored.where("at >= '2026-01-05'"), path, "at", ["k"], "who", "days")  # the fifth again, replaced
    sketches = spark.read.parquet(path)
    assert (first, sketches.select("day").distinct().count()) == (5, 9)
    merged = publish.merged_sketches(sketches, ["k"], (0.1, 0.5, 0.99))
    assert all(path in f for f in merged.inputFiles()) and merged.inputFiles()
    for r in merged.collect():
        mine = [x for x in rows if x[1] == r["k"]]
        exact = len({x[2] for x in mine})
        assert r["n"] == len(mine) and abs(r["n_distinct"] - exact) <= 3 * publish.DISTINCT_ERROR * exact
        values = np.sort([x[3] for x in mine if x[3] is not None])
        for p, v in zip((0.1, 0.5, 0.99), r["percentiles"], strict=True):
            low, high = np.searchsorted(values, v, "left") / len(values), np.searchsorted(values, v, "right") / len(values)
            assert low - 3 * publish.RANK_ERROR <= p <= high + 3 * publish.RANK_ERROR
    nothing = publish.merged_sketches(publish.day_sketches(df.withColumn("days", F.lit(None).cast("double")), "at", ["k"], "who", "days"), ["k"]).collect()
    assert {r["percentiles"] for r in nothing} == {None}


def test_pseudonyms_and_rotation(spark):
    keys = {1: "old key", 2: "k" * 100}
    df = spark.createDataFrame([("Maria",), ("",), ("è",), (None,)], "who string")
    for v, key in keys.items():
        got = {r["who"]: r["p"] for r in df.select("who", publish.pseudonym(F.col("who"), keys, v).alias("p")).collect()}
        assert got == {w: None if w is None else f"{v}:{hmac.new(key.encode(), w.encode(), hashlib.sha256).hexdigest()}" for w in ("Maria", "", "è", None)}
    stored = df.select("who", publish.pseudonym(F.col("who"), keys, 1).alias("p"))
    said = lambda k, w: [r["x"] for r in stored.where("who = 'Maria'").select(publish.pseudonym_in(F.col("p"), F.lit(w), k).alias("x")).collect()]
    assert (said(keys, "Maria"), said(keys, "Mario"), said({2: keys[2]}, "Maria"), said({}, "Maria")) == ([True], [False], [False], [False])


def test_layers_refuse_what_comes_from_notes(spark, tmp_path):
    layers = publish.Layers(spark, str(tmp_path), {"note"})
    day = dt.date(2026, 1, 1)
    rows = [(day + dt.timedelta(i % 3), f"s{i % 2}", f"note {i}", f"person {i}", "c") for i in range(30)]
    layers.write("received", spark.createDataFrame(rows, "day date, service string, note string, who string, cause string"))
    received = layers.read("received")
    plain = received.select("day", "service", "cause", publish.pseudonym(F.col("who"), {1: "k"}, 1).alias("who"))
    layers.write("classified", plain)
    renamed = received.select("day", "service", F.col("note").alias("cause"))
    hidden = [
        renamed,
        renamed.groupBy("day", "service").agg(F.max("cause").alias("top")),
        received.select("day", F.struct(F.upper("note").alias("x")).alias("details")).select("day", F.col("details.x").alias("label")),
        received.withColumn("w", F.explode(F.split("note", " "))).select("day", "w"),
        plain.select("day", "service").union(received.select("day", F.concat("note", "cause"))),
        received.withColumn("n", F.row_number().over(Window.partitionBy("day").orderBy("service"))).select("day", F.when(F.col("n") > 1, F.col("note")).alias("v")),
        plain.join(received.select("day", F.length("note").alias("len")), "day").select("day", "len"),
        received.select("day", "service", "note").mapInPandas(lambda it: it, "day date, label string, rest string"),
        received.groupBy("day").agg(F.collect_set("note").alias("s")),
    ]
    for df in hidden:
        with pytest.raises(publish.FreeText):
            layers.write("grouped", df)
    assert not (tmp_path / "3_grouped").exists()
    counted = layers.read("classified").groupBy("day", "service", "cause").agg(F.count("*").alias("n"))
    layers.write("grouped", counted)
    layers.write("published", layers.read("grouped").groupBy("service").agg(F.sum("n").alias("n")).where("n >= 5"))
    assert sorted(map(tuple, layers.read("published").collect())) == [("s0", 15), ("s1", 15)]
    layers.write("classified", plain.where("day = '2026-01-02' and service = 's0'"))  # that day is replaced, the others stay
    assert sorted(map(tuple, layers.read("classified").groupBy("day").count().collect())) == [(day, 10), (day + dt.timedelta(1), 5), (day + dt.timedelta(2), 10)]
    assert layers.expire("classified", "2026-01-03") == ["2026-01-01", "2026-01-02"]
    assert layers.read("classified").count() == 10 and layers.read("received").count() == 30


def test_versions_lose_no_update(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    assert table.latest() == 0
    with pytest.raises(FileNotFoundError):
        table.read()
    rows = spark.createDataFrame([(i, "new", None) for i in range(4)], "id long, status string, day string")
    assert table.commit(rows, 0) == 1
    mine, yours = (spark.createDataFrame([(i, s)], "id long, status string") for i, s in ((1, "mine"), (2, "yours")))
    base, other = table.latest(), versions.VersionedTable(spark, str(tmp_path / "t"))
    before = table.read()
    assert other.commit(versions.update_rows(other.read(), yours, "id"), base) == 2
    with pytest.raises(versions.Conflict):  # started from the same version
        table.commit(versions.update_rows(before, mine, "id"), base)
    assert {r["id"]: r["status"] for r in table.read().collect()} == {0: "new", 1: "new", 2: "yours", 3: "new"}
    assert table.update(mine, "id") == 3  # done again on what is there
    assert {r["id"]: r["status"] for r in table.read().collect()} == {0: "new", 1: "mine", 2: "yours", 3: "new"}
    assert {r["status"] for r in table.read(1).collect()} == {"new"} and before.count() == 4  # whole versions stay readable
    named = {(tmp_path / "t/data" / n).name for n in (p.name for p in (tmp_path / "t/data").iterdir())}
    assert len(named) == 3 and table.versions() == [1, 2, 3]  # what failed left nothing
    (tmp_path / "t/versions" / f"{4:020d}").write_bytes(b"")  # a writer that has claimed a version and not named it yet
    assert table.latest() == 3
    with pytest.raises(versions.Conflict):
        table.update(mine, "id", attempts=2)


def test_dead_writers_claim_ends(spark, tmp_path, monkeypatch):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(1, "a")], "id long, status string")
    table.commit(rows, 0)
    (tmp_path / "t/versions" / f"{2:020d}").write_bytes(b"")
    monkeypatch.setattr(versions, "STALE_SECONDS", -1)
    assert table.update(rows, "id") == 2


def test_concurrent_writers(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    table.commit(spark.createDataFrame([(i, "new") for i in range(4)], "id long, status string"), 0)
    failed = []

    def write(i):
        try:
            versions.VersionedTable(spark, str(tmp_path / "t")).update(spark.createDataFrame([(i, f"by {i}")], "id long, status string"), "id", attempts=20)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not failed and {r["id"]: r["status"] for r in table.read().collect()} == {i: f"by {i}" for i in range(4)} and table.latest() == 5


RECORDS = [{"_id": i, "name": f"name {i}", "municipio": i % 9, "lat": i / 10 if i % 4 else None, "open": i % 2 == 0} for i in range(95)]


@pytest.fixture(scope="module")
def server():
    """A portal that gives 20 rows a request at most and fails the first time it is asked anything."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            first = self.path not in asked
            asked.append(self.path)
            url = urllib.parse.urlparse(self.path)
            q = dict(urllib.parse.parse_qsl(url.query))
            if url.path.startswith("/page"):
                status, body = (404, b"") if url.path == "/page/404" else (200, f"<p>{url.path} è</p>".encode("latin-1"))
            elif first:
                status, body = 503, b""
            elif url.path.endswith("package_show"):
                status, body = 200, json.dumps({"success": True, "result": {"resources": [{"id": "pdf", "format": "PDF"}, {"id": "res", "format": "csv"}]}}).encode()
            else:
                equal = json.loads(q.get("filters", "{}"))
                found = [r for r in RECORDS if all(r[k] == v for k, v in equal.items())]
                some = found[int(q["offset"]) :][: min(20, int(q["limit"]))] if "offset" in q else []
                fields = [{"id": "_id", "type": "int"}, {"id": "name", "type": "text"}, {"id": "municipio", "type": "int4"}, {"id": "lat", "type": "numeric"}, {"id": "open", "type": "bool"}]
                status, body = 200, json.dumps({"success": True, "result": {"total": len(found), "records": some, "fields": fields}}).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_portal_is_read_by_tasks(spark, server):
    url, asked = server
    portal.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("ckan").options(portal=url, package="uffici", page_rows=30).load()
    assert df.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, df.collect())) == [tuple(r.values()) for r in RECORDS]
    asked.clear()
    three = spark.read.format("ckan").options(portal=url, resource="res", page_rows=30).load().where("municipio = 3 and lat > 2")
    assert {r["_id"] for r in three.collect()} == {r["_id"] for r in RECORDS if r["municipio"] == 3 and (r["lat"] or 0) > 2}
    assert all("filters" in p for p in asked if "offset" in p) and any("offset" in p for p in asked)


def test_pages_are_read_by_tasks(spark, server):
    url, _ = server
    portal.register(spark)
    urls = [f"{url}/page/{i}" for i in range(9)] + [f"{url}/page/404", "http://127.0.0.1:1/none", f"{url}/page/0", ""]
    df = spark.read.format("webpages").options(urls="\n".join(urls), urls_a_task=3).load()
    assert df.rdd.getNumPartitions() == 4
    got = {r["url"]: (r["status"], r["body"]) for r in df.collect()}
    assert len(got) == 11 and got[f"{url}/page/4"] == ("200", "<p>/page/4 è</p>") and got[f"{url}/page/404"] == ("404", None) and got["http://127.0.0.1:1/none"][0].startswith("error: ")
    assert spark.read.format("webpages").option("urls", "").load().count() == 0
