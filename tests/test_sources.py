"""Live pages as a data source, stored validators, whole versions under concurrent writers, refresh guard."""

import http.server
import threading

import pytest
from pyspark.sql import functions as F

from tarnflow.sources import pages, versions
from tarnflow.sources.page_source import register


def canned(asked, *limits):
    """Another engine, by name."""
    for url, _, _ in asked:
        yield (url, url, 200, "canned", None, None, None)


@pytest.fixture(scope="module")
def site():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        bodies = {"/a": "first", "/b": "second", "/robots.txt": "User-agent: *\nDisallow: /b"}

        def do_GET(self):
            seen.append((self.path, self.headers.get("If-None-Match")))
            body = self.bodies.get(self.path)
            tag = f'"{body}"'
            same = body is not None and self.headers.get("If-None-Match") == tag
            self.send_response(304 if same else 404 if body is None else 200)
            if body is not None:
                self.send_header("ETag", tag)
            text = b"" if same else (body or "none").encode()
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen, Handler
    server.shutdown()


def test_data_source(spark, site):
    at, seen, _ = site
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    other = at.replace("127.0.0.1", "localhost")
    read = spark.read.format("tarnflow_pages").option("urls", f"{at}/a\n{at}/b\n{other}/a\n{at}/gone\nnowhere").option("seconds_per_request", 0).option("pause", 0)
    got = {r.url: (r.status, r.html, r.error is None) for r in read.load().collect()}
    assert got == {f"{at}/a": (200, "first", True), f"{at}/b": (200, "second", True), f"{other}/a": (200, "first", True), f"{at}/gone": (404, "none", True), "nowhere": (None, None, False)}
    assert read.load().rdd.getNumPartitions() == 3  # a host each, and what has none
    del seen[:]
    assert [r.html for r in read.load().where(F.col("url").endswith("/b") & (F.col("status") == 200)).collect()] == ["second"]
    assert {p for p, _ in seen} == {"/b"}  # the rest was never asked for
    robots = {r.url: (r.status, r.error) for r in read.option("robots", "true").load().where(F.col("url").startswith(at)).collect()}
    assert robots[f"{at}/b"] == (None, "robots.txt forbids it") and robots[f"{at}/a"] == (200, None)
    assert {r.html for r in read.option("robots", "false").option("engine", "tests.test_sources:canned").load().collect()} == {"canned"}
    assert spark.read.format("tarnflow_pages").load().collect() == []


def test_validators(spark, site, tmp_path):
    at, seen, handler = site
    path = f"file://{tmp_path}/pages"
    urls = spark.createDataFrame([(f"{at}/a",), (f"{at}/b",), (f"{at}/gone",), (f"{at}/a",)], "url string")
    get = lambda asked: pages.fetch(asked, seconds_per_request=0.0, pause=0.0)
    rows = lambda: {r.url[len(at) :]: (r.status, r.html, r.fresh) for r in versions.validated_pages(spark, urls, path, get).collect()}
    assert rows() == {"/a": (200, "first", True), "/b": (200, "second", True), "/gone": (404, "none", True)}
    del seen[:]
    handler.bodies["/b"] = "changed"
    assert rows() == {"/a": (200, "first", False), "/b": (200, "changed", True), "/gone": (404, "none", True)}
    assert sorted(seen, key=str) == sorted([("/a", '"first"'), ("/b", '"second"'), ("/gone", None)], key=str)
    handler.bodies["/b"] = None  # errors replace nothing
    assert rows()["/b"] == (404, "none", True)
    stored = {r.url[len(at) :]: r.html for r in versions.VersionedTable(spark, path).read().collect()}
    assert stored == {"/a": "first", "/b": "changed"}


def test_versions_are_whole(spark, tmp_path):
    table = versions.VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.version() == 0 and table.read() is None
    whole = lambda n: spark.range(200).select("id", F.lit(n).alias("n"))
    table.publish(whole(1), 0)
    with pytest.raises(versions.Conflict):
        table.publish(whole(9), 0)
    assert {r.n for r in table.read().collect()} == {1} and len(table.files.names("data")) == 1
    # a writer that died before its manifest leaves the table as it was
    whole(7).write.parquet(f"{table.files.root}/data/left-over")
    assert {r.n for r in table.read().collect()} == {1}
    mixed, stop = [], threading.Event()

    def reading():
        while not stop.is_set():
            seen = {r.n for r in table.read().select("n").distinct().collect()}
            mixed.extend([seen] if len(seen) != 1 else [])

    def writing():
        for _ in range(4):
            table.update(lambda old: old.withColumn("n", F.col("n") + 1))

    reader = threading.Thread(target=reading)
    reader.start()
    writers = [threading.Thread(target=writing) for _ in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    stop.set()
    reader.join()
    assert not mixed and {r.n for r in table.read().collect()} == {9} and table.version() == 9  # no update was lost
    table.upsert(spark.createDataFrame([(3, 50), (500, 51), (500, 51)], "id long, n int"), "id")
    got = {r.id: r.n for r in table.read().collect()}
    assert len(got) == 201 and got[3] == 50 and got[500] == 51 and got[4] == 9


def test_refresh_guard(spark, tmp_path):
    now = [1000.0]
    guard = versions.RefreshGuard(spark, f"file://{tmp_path}/g", cooldown=30, lease=600, clock=lambda: now[0])
    status, ticket = guard.begin("s")
    assert status == 202 and guard.begin("s") == (429, None) and guard.begin("other")[0] == 202
    now[0] += 40
    assert guard.begin("s") == (429, None)  # it still runs
    guard.end("s", ticket)
    status, second = guard.begin("s")
    assert status == 202 and second != ticket
    guard.end("s", second)
    now[0] += 10
    assert guard.begin("s") == (429, None)  # too soon
    now[0] += 1000
    assert guard.begin("s")[0] == 202
    now[0] += 700
    assert guard.begin("s")[0] == 202  # the last holder has died
    # of many at once one may start
    now[0] += 2000
    got = []
    some = [threading.Thread(target=lambda: got.append(guard.begin("s")[0])) for _ in range(6)]
    for t in some:
        t.start()
    for t in some:
        t.join()
    assert sorted(got) == [202] + [429] * 5


def test_parts_of_runs_that_end_at_once(spark, tmp_path):
    from tarnflow.sources import state

    path = f"file://{tmp_path}/good"
    items = lambda source, n, rows=40: spark.range(rows).select(F.lit(source).alias("source"), "id", F.lit(n).alias("n"))
    state.save_last_good(items("s/1 = é", 0).unionByName(items("t", 0)), path)
    state.save_last_good(spark.createDataFrame([("u", "title")], "source string, title string"), path)
    state.save_last_good(items("t", 0).where("false"), path)  # no source, so nothing changes
    assert state.last_good(spark, path, "u").columns == ["source", "title", "stale"] and state.last_good(spark, path, "none") is None
    mixed, stop = [], threading.Event()

    def reading():
        while not stop.is_set():
            for name in ("s/1 = é", "t"):
                seen = [(r.n, r["count"]) for r in state.last_good(spark, path, name).groupBy("n").count().collect()]
                mixed.extend([seen] if len(seen) != 1 or seen[0][1] != 40 else [])

    reader = threading.Thread(target=reading)
    reader.start()
    writers = [threading.Thread(target=lambda name=name: [state.save_last_good(items(name, n), path) for n in (1, 2)]) for name in ("s/1 = é", "t", "v")]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    stop.set()
    reader.join()
    assert not mixed
    assert {r.source for r in state.sources_with_last_good(spark, path).collect()} == {"s/1 = é", "t", "u", "v"}
    for name in ("s/1 = é", "t", "v"):  # no run's items were lost
        assert [(r.n, r["count"]) for r in state.last_good(spark, path, name).groupBy("n").count().collect()] == [(2, 40)]
    assert state.last_good(spark, path, "u").count() == 1 and len(versions.VersionedParts(spark, path).files.names("_versions")) <= versions.KEPT + 1
