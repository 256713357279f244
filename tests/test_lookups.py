"""Lookups over invented pages, and the fetcher against a server of this process."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from tarnflow.functions.types import parse_type
from tarnflow.operators import nodes
from tarnflow.plans import heal, lookups
from tarnflow.plans.compiling import FieldSpec, SourceSpec, compile_source
from tarnflow.sources import pages
from tarnflow.surfaces import Source, call_tool, handle, openapi

SOURCE = SourceSpec("find", {"title": FieldSpec(parse_type("str"), "headline"), "link": FieldSpec(parse_type("url"), "headline link"), "points": FieldSpec(parse_type("int"), "score of it")}, min_items=0)
SPEC = lookups.LookupSpec(SOURCE, "https://x.test/find/{who}", {"who": "", "page": "1", "lang": ""}, frozenset({"lang"}), {"title_contains": "nobody"}, {"who": "known"}, ttl=60)
OLD, NEW = ("h2", "headline", "score"), ("div", "hdr headline-x", "karma score-x")


def listing(who, n, names=OLD):
    tag, head, score = names
    rows = "".join(f'<article class="hit"><{tag} class="{head}"><a href="../i/{i}">{who} story {chr(97 + i)}</a></{tag}><p><span class="{score}">{5 * i + 2} points</span></p></article>' for i in range(n))
    return f"<html><head><title>Hits</title></head><body><main>{rows}</main></body></html>"


def web(names):
    """A fetch function over invented pages, which needs no network."""

    def fetch(urls):
        rows = [(w, 200, listing(w, n, names), None) for w, n in (("kim", 3), ("a%20b", 3), ("bare", 0), ("known", 8))]
        rows += [("ghost", 200, "<html><head><title>Nobody here</title></head></html>", None), ("wall", 200, "<html>Just a moment</html>", None), ("down", None, None, "no route")]
        held = urls.sparkSession.createDataFrame(rows, "who string, status int, html string, error string")
        return urls.withColumn("who", F.regexp_extract("url", "find/([^?]*)", 1)).join(held, "who").select("url", F.col("url").alias("url_final"), "status", "html", "error")

    return fetch


@pytest.fixture(scope="module")
def compiled(spark):
    page = spark.createDataFrame([(0, "https://x.test/find/known", 200, listing("known", 8))], "page_id long, url string, status int, html string")
    return compile_source(nodes.page_nodes(page).cache(), SOURCE, F.lit("https://x.test/find/known"))


def test_requests_of_every_kind(spark, compiled):
    asked = spark.createDataFrame([(1, "kim", "z"), (2, "kim", "z"), (3, "ghost", None), (4, "wall", ""), (5, None, "z"), (6, "", "z"), (7, "down", None), (8, "a b", "z")], "request_id long, who string, other string")
    got = lookups.lookup(spark, SPEC, compiled.item, compiled.locks, asked, web(OLD))
    by = {r.request_id: (r.status, r["count"], r.page_id) for r in got.requests.collect()}
    assert by == {1: ("ok", 3, 1), 2: ("ok", 3, 1), 3: ("not_found", 0, 3), 4: ("blocked", 0, 4), 5: ("error", 0, None), 6: ("error", 0, None), 7: ("blocked", 0, 7), 8: ("ok", 3, 8)}
    why = {r.request_id: (r.error, r.url) for r in got.requests.collect()}
    assert why[5] == ("missing parameters: who", None) and why[7][0] == "no route" and "just a moment" in why[4][0] and why[8] == (None, "https://x.test/find/a%20b?page=1")
    rows = [tuple(r) for r in got.items.where("page_id = 1").orderBy("item").drop("page_id", "item").collect()]
    assert rows == [(f"kim story {c}", f"https://x.test/i/{i}", 5 * i + 2) for i, c in enumerate("abc")] and not got.healed


def test_nothing_asked_and_not_compiled(spark, compiled):
    none = spark.createDataFrame([], "request_id long, who string")
    got = lookups.lookup(spark, SPEC, compiled.item, compiled.locks, none, web(OLD))
    assert got.requests.count() == got.items.count() == 0
    lost = lookups.lookup(spark, SPEC, None, [], spark.createDataFrame([(1, "kim"), (2, None)], "request_id long, who string"), web(OLD))
    assert {r.request_id: r.status for r in lost.requests.collect()} == {1: "broken", 2: "error"}


def test_repair_on_the_fixture(spark, compiled):
    asked = spark.createDataFrame([(1, "kim"), (2, "bare")], "request_id long, who string")
    # a page without items is no drift where the fixture is as it was
    calm = lookups.lookup(spark, SPEC, compiled.item, compiled.locks, asked, web(OLD))
    assert {r.request_id: (r.status, r["count"]) for r in calm.requests.collect()} == {1: ("ok", 3), 2: ("ok", 0)} and calm.locks == compiled.locks
    # after a redesign selectors are found on the fixture and used for the request
    fixed = lookups.lookup(spark, SPEC, compiled.item, compiled.locks, asked, web(NEW))
    assert fixed.healed and {r["field"]: r["status"] for r in fixed.locks}[fixed.healed[0]] == heal.UNCONFIRMED
    assert {r.request_id: r["count"] for r in fixed.requests.collect()} == {1: 3, 2: 0}
    assert [r.points for r in fixed.items.orderBy("item").collect()] == [2, 7, 12]
    # repair is off
    off = lookups.lookup(spark, SPEC, compiled.item, compiled.locks, asked.where("request_id = 2"), web(NEW), heal_allowed=False)
    assert not off.healed and off.requests.first()["count"] == 0


def test_memo_and_surfaces(spark, compiled):
    now = [0.0]
    memo, asked = lookups.Memo(lambda: now[0]), []

    def run(session, arguments):
        answer, fresh = lookups.lookup_one(session, SPEC, compiled.item, compiled.locks, arguments, memo, fetch=web(OLD))
        asked.append(fresh is not None)
        return answer

    types = {n: f.ft for n, f in SOURCE.fields.items()}
    sources = {"find": Source("find", types, None, lookup_params=frozenset({"who"}), lookup=run)}
    status, body = handle(spark, sources, "/v1/find?who=kim&points__gt=2&sort=-points&fields=points")
    assert status == 200 and body["items"] == [{"points": 12}, {"points": 7}] and body["status"] == "ok" and body["params"] == {"who": "kim"} and body["count"] == 2
    assert call_tool(spark, sources, "lookup_find", {"who": "kim", "limit": "1"})["returned"] == 1 and asked == [True, False]
    now[0] = 61.0
    assert handle(spark, sources, "/v1/find?who=kim")[1]["_meta"] == {"cached": False} and asked[-1]
    assert handle(spark, sources, "/v1/find?who=ghost")[:1] == (200,)
    status, body = handle(spark, sources, "/v1/find?who=wall")
    assert status == 502 and body["items"] == [] and "just a moment" in body["error"]
    assert handle(spark, sources, "/v1/find")[0] == 400
    status, body = handle(spark, sources, "/v1/find/ask?q=kim", lambda p: "QUERY: who=kim; limit=1")
    assert status == 200 and body["returned"] == 1 and body["_meta"]["compiled_rounds"] == 1


def test_description_is_typed():
    source = Source("s", {"points": parse_type("int | null"), "tags": parse_type("list[str]"), "kind": parse_type("enum[a, b]")}, None, lookup_params=frozenset({"who"}))
    made = json.loads(json.dumps(openapi({"s": source})))
    get = made["paths"]["/v1/s"]["get"]
    given = {p["name"]: p for p in get["parameters"]}
    assert given["who"]["required"] and given["points"]["schema"] == {"type": "integer"} and given["limit"]["schema"]["maximum"] == 1000 and given["kind"]["schema"] == {"type": "string", "enum": ["a", "b"]}
    assert "points__lte" in given["points"]["description"] and "tags__contains" in given["tags"]["description"] and "tags__gt" not in given["tags"]["description"]
    items = get["responses"]["200"]["content"]["application/json"]["schema"]["properties"]["items"]["items"]
    assert items["properties"]["tags"]["type"] == "array" and "/v1/s/schema" in made["paths"]
    assert get["responses"]["400"] == {"$ref": "#/components/responses/InvalidQuery"} and "code" in made["components"]["responses"]["InvalidQuery"]["content"]["application/json"]["schema"]["properties"]


class Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        if self.headers.get("If-None-Match") == '"v1"' and self.path == "/page":
            self.send_response(304)
            self.end_headers()
            return
        if self.path == "/old":
            self.send_response(302)
            self.send_header("Location", "/page")
            self.end_headers()
            return
        body = b"caf\xe9" if self.path == "/latin" else b"<p>hello</p>"
        self.send_response(404 if self.path == "/none" else 200)
        self.send_header("Content-Type", "text/html; charset=latin-1" if self.path == "/latin" else "text/html")
        self.send_header("ETag", '"v1"')
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_fetch(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        asked = spark.createDataFrame([(f"{at}/page", None), (f"{at}/old", None), (f"{at}/none", None), (f"{at}/latin", None), (None, None), ("no address", None), (f"{at}/page", '"v1"')], "url string, etag string")
        got = [r.asDict() for r in pages.fetch(asked, seconds_per_request=0.0, pause=0.0).collect()]
    finally:
        server.shutdown()
    seen = {(r["url"] and r["url"].replace(at, ""), r["status"]): r for r in got}
    assert len(got) == 7 and seen["/page", 200]["html"] == "<p>hello</p>" and seen["/page", 200]["etag"] == '"v1"'
    assert seen["/page", 304]["html"] is None and seen["/page", 304]["error"] is None and seen["/old", 200]["url_final"] == f"{at}/page"
    assert seen["/none", 404]["error"] is None and seen["/latin", 200]["html"] == "café" and seen["no address", None]["error"] and seen[None, None]["error"]
