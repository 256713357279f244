import random
import time

import pytest
from pyspark.sql import functions as F

from tarnflow.functions import casts
from tarnflow.functions.types import parse_type
from tarnflow.operators import candidates, drift, nodes, shapes
from tarnflow.operators.extraction import Selector, extract, extract_raw, field_statistics
from tarnflow.plans import heal
from tarnflow.sources import pages, state
from tarnflow.streaming import refresh


def site(n, head="headline", score="score", word="points", tag="h2"):
    rows = "".join(f'<article class="story"><{tag} class="{head}"><a href="/item/{i}">Title of {i} &amp; more</a></{tag}><div class="meta"><span class="{score}">{i * 3} {word}</span><br><p>first<p>second</div></article>' for i in range(n))
    return f"<html><body><!-- no --><script>var x = '</p>';</script><main class='feed'>{rows}</main></body></html>"


FIELDS = {"title": (parse_type("str"), Selector(".headline")), "url": (parse_type("url"), Selector("h2 > a", "href")), "points": (parse_type("int"), Selector(".meta .score")), "parts": (parse_type("list[str]"), Selector("p")), "none": (parse_type("int | null"), Selector(".missing"))}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(1, site(4)), (2, None), (3, "")], "page_id long, html string")
    return nodes.page_nodes(df).cache()


def test_extraction(found):
    rows = extract(found, "article.story", FIELDS, F.lit("https://x.test/news")).orderBy("item").collect()
    assert [r.title for r in rows] == [f"Title of {i} & more" for i in range(4)]
    assert rows[2].url == "https://x.test/item/2" and rows[2].points == 6 and rows[2].parts == ["first", "second"] and rows[2].none is None
    stats = {r.field: r for r in field_statistics(extract_raw(found, "article.story", FIELDS), {n: t for n, (t, _) in FIELDS.items()}, F.lit("https://x.test")).collect()}
    assert (stats["parts"].match_count, stats["points"].cast_fail, stats["none"].null_count) == (8, 0, 4)


@pytest.mark.parametrize("css, n", [("article", 4), ("main article", 4), ("body > article", 0), ("article a", 4), ("article > a", 0), ("p:nth-of-type(2)", 4), ("a[href$='2']", 1), ("span.score, a", 8), ("div:not(.meta)", 0), ("h2:first-child", 4), ("*.meta", 4)])
def test_selectors(found, css, n):
    assert found.where(nodes.matches(F.col("path"), css)).count() == n


def test_bad_selector(found):
    with pytest.raises(nodes.SelectorError):
        nodes.match_positions(F.col("path"), "a{b}")
    assert extract(found, "a{b}", FIELDS).count() == 0


def test_candidates(spark):
    found = nodes.page_nodes(spark.createDataFrame([(1, site(6))], "page_id long, html string"))
    assert candidates.item_candidates(found).orderBy("rank").first().css == "article.story"
    best = candidates.field_candidates(found, "article.story", parse_type("int"), "the score", "score").orderBy("rank").first()
    assert best.css == ".score" and best.attr == "text"


@pytest.mark.parametrize(
    "kind, text, value",
    [("int", "1,204 points", 1204), ("int", "3.5", 3), ("int", "none", None), ("float", "€1,234.5", 1234.5), ("float", "about 2.5 km", 2.5), ("bool", " Yes ", True), ("bool", "maybe", None), ("str", " a  \n b ", "a b"), ("datetime", "05 Jan 2026", "2026-01-05T00:00:00"), ("datetime", "Jan 5, 2026", "2026-01-05T00:00:00"), ("datetime", "2026-01-05 10:30", "2026-01-05T10:30:00"), ("datetime", "2026-01-05T10:30:00Z", "2026-01-05T10:30:00+00:00"), ("datetime", "2026", None), ("datetime", "2026-02-31", None), ("enum[Red, blue]", " RED ", "Red"), ("url", "../a", "https://x.test/a"), ("url", "not a url", None), ("url", "mailto:a@b", None)],
)
def test_casts(spark, kind, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    ft = parse_type(kind)
    assert df.select(casts.cast_column(F.col("t"), ft, F.lit("https://x.test/b/c")).alias("v")).first().v == value
    if value is not None:
        assert casts.cast_literal(text, ft, "https://x.test/b/c") == value


def test_shapes(spark):
    df = spark.createDataFrame([("12 points-x",), ("a_b: 3.",)], "t string")
    assert [r[0] for r in df.select(shapes.value_shape(F.col("t"))).collect()] == [r"^\d+\s+[^\W\d_]+\-[^\W\d_]+$", r"^[^\W\d_]+_[^\W\d_]+:\s+\d+\.$"]
    assert df.select(shapes.ema(F.array(F.lit(10.0), F.lit(20.0), F.lit(30.0)))).first()[0] == pytest.approx(18.1)
    same = shapes.node_similarity(F.lit("a"), F.array(F.lit("x")), F.lit("li<ul"), F.lit("a"), F.array(F.lit("x"), F.lit("y")), F.lit("li<ul"))
    assert df.select(same).first()[0] == pytest.approx(0.8)


def test_drift_and_gates(spark):
    stats = spark.createDataFrame([("s", "gone", 10, 0, 10, 0, 1.0, 1.0), ("s", "bad", 10, 30, 5, 3, 0.5, 0.2), ("s", "fine", 10, 10, 0, 0, 1.0, 1.0)], "source string, field string, items long, match_count long, null_count long, cast_fail long, shape_ratio double, similarity double")
    locks = stats.select("source", "field", F.lit(12).alias("min_items"), F.lit(False).alias("nullable"), F.lit(False).alias("loose"), F.lit(10.0).alias("match_count_ema"), F.lit(0.0).alias("null_rate_ema"))
    got = {r.field: r.causes for r in drift.drifted(stats, locks).collect()}
    assert got["gone"] == ["zero-match"] and got["fine"] == ["items 10 < min_items 12"]
    assert got["bad"] == ["schema-fail 3/10", "cardinality 3.0x baseline", "items 10 < min_items 12", "shape 50% match", "null-rate 50%", "fingerprint 0.20 sim"]
    probe = spark.createDataFrame([(".score", 0, 10, 9, 1, False, 10.0, 0.2, 1.0, ["Old  title"], ["Old title"], "x Old title y"), ("div", 0, 10, 9, 1, False, 10.0, 0.2, 0.5, ["Old"], ["New"], "Old")], "css string, cast_fail int, scopes int, matched_scopes int, min_items int, nullable boolean, match_count_ema double, old_shape_ratio double, new_shape_ratio double, samples array<string>, raws array<string>, page_text string")
    assert [(r.shape, r.anchor, r.robust, r.passed) for r in drift.gate_verdicts(probe).orderBy("css").collect()] == [(True, True, True, True), (False, False, True, False)]


def test_ladder(spark):
    kinds = "source string, field string, field_order int, rung int, rank int, css string, attr string, passed boolean"
    able = spark.createDataFrame([("s", "a", 0, 1, 1, ".old", "text", False), ("s", "a", 0, 2, 1, ".x", "text", True), ("s", "b", 1, 2, 1, ".x", "text", True), ("s", "b", 1, 2, 2, ".y", "text", True), ("s", "c", 2, 2, 1, ".held", "text", True)], kinds)
    lock = lambda f, css, status: ("s", f, 0, css, "text", [], status, 0, 0, None, [], 1.0, 0.0, 1.0, "", [], "")
    locks = spark.createDataFrame([lock("a", ".a", "verified"), lock("b", ".b", heal.UNCONFIRMED), lock("c", ".c", "verified"), lock("d", ".held", heal.UNCONFIRMED)], state.LOCKS)
    chosen = heal.choose(able, locks)
    assert {r.field: r.css for r in chosen.collect()} == {"a": ".x", "b": ".y"}
    after = {r.field: r for r in heal.healed_locks(locks, able.select("source", "field").distinct(), chosen).collect()}
    assert {f: r.status for f, r in after.items()} == {"a": heal.UNCONFIRMED, "b": heal.BROKEN, "c": heal.BROKEN, "d": heal.UNCONFIRMED}
    assert after["a"].fallbacks[0].css == ".a" and after["b"].css == ".y" and after["d"].confirm_runs == 1


def test_repair_after_redesign(spark):
    """A renamed class is found again by the values' shape."""
    new = nodes.page_nodes(spark.createDataFrame([(1, site(8, score="karma", word="karma"))], "page_id long, html string"))
    ranked = candidates.field_candidates(new, "article.story", parse_type("int"), "points", "points", shape=r"^\d+\s+[^\W\d_]+$")
    assert ranked.orderBy("rank").first().css == ".karma"


def test_pages(spark):
    df = spark.createDataFrame([(1, "https://a.test/x", "<title>Hi There</title>" + "x" * 500, 200), (2, "https://a.test/login", "x" * 500, 200), (3, "https://b.test/", "x" * 500, 200), (4, "https://a.test/", "CAPTCHA", 200), (5, "https://a.test/", "x", 200), (6, "https://a.test/", "", 404)], "id int, url string, html string, status int")
    got = df.select("id", pages.block_reason(F.col("status"), F.col("html"), F.col("url"), F.lit("a.test"), F.lit(500.0)).alias("r")).orderBy("id").collect()
    assert [r.r and r.r.split()[0] for r in got] == [None, "redirected", "redirected", "challenge", "content", "http"]
    assert df.where(pages.not_found(F.col("html"), F.col("status"), **pages.not_found_sign("page title contains 'hi there'"))).count() == 1
    rules = spark.createDataFrame([("a.test", "User-agent: *\nDisallow: /login")], "host string, robots string")
    assert {r.id for r in pages.allowed(df, rules).collect()} == {1, 3, 4, 5, 6}
    bound = df.select(pages.bind_url("https://x.test/{p}?a=1", {"p": F.lit("a b/c"), "q": F.col("id"), "z": F.lit(None)})).first()[0]
    assert bound == "https://x.test/a%20b%2Fc?a=1&q=1" and pages.missing_params(["p", "q"], {"q": "1"}, {}) == ["p"]


def test_state(spark, tmp_path):
    df = spark.createDataFrame([("s", 1), ("s", 2), ("t", 3)], "source string, n int")
    state.save_last_good(df, str(tmp_path / "good"))
    state.save_last_good(df.where("source = 's' AND n = 1"), str(tmp_path / "good"))
    assert [state.last_good(spark, str(tmp_path / "good"), s).count() for s in "st"] == [1, 1]
    state.append_history(spark.createDataFrame([("a", "heal"), ("b", "heal")], "field string, event string"), str(tmp_path / "log"))
    assert state.read_history(spark, str(tmp_path / "log"), "ts string, field string, event string", "a").count() == 1
    state.write_jsonl(df, str(tmp_path / "lines"), flat=False)
    assert sorted(r["count"] for r in spark.read.json(str(tmp_path / "lines")).collect()) == [1, 2]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10.0, 1), (1, 20.0, 2), (2, 5.0, 3), (1, 30.0, 4)], "k long, v double, o long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = refresh.page_stream(spark, str(tmp_path / "in"), "k long, v double, o long")
    seen = []
    refresh.refresh(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "c1")).awaitTermination()
    assert sum(seen) == 4
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ema = refresh.running_ema(refresh.page_stream(spark, str(tmp_path / "in"), "k long, v double, o long"), "k", "v", "o")
    out = ema.writeStream.format("memory").queryName("ema_out").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert {r.k: round(r.ema, 6) for r in spark.table("ema_out").orderBy("n").collect()} == {1: 18.1, 2: 5.0}


def test_free_selectors_form_no_pairs_of_fields(spark):
    """Every field of one selector but a lone lock's own is taken, at a size where pairs (ten thousand million) would take minutes; odd rows as by brute force."""
    rng = random.Random(3)
    kinds = "source string, field long, css string, attr string"
    one = lambda: (rng.choice(["a", "b", None]), rng.choice([1, 2, 3, 4, None]), rng.choice(["p", "q", "r", None]), rng.choice(["text", "href"]))
    some, locks = [one() for _ in range(120)], [one() for _ in range(14)]
    taken = lambda c: any(None not in (*c, *o) and o[0] == c[0] and o[2:] == c[2:] and o[1] != c[1] for o in locks)
    want = sorted((c for c in some if not taken(c)), key=str)
    assert 0 < len(want) < len(some)
    got = drift.free_selectors(spark.createDataFrame(some, kinds), spark.createDataFrame(locks, kinds)).collect()
    assert sorted(map(tuple, got), key=str) == want
    hot = spark.range(100_000).select(F.lit("a").alias("source"), F.col("id").alias("field"), F.lit("p").alias("css"), F.lit("text").alias("attr"))
    start = time.monotonic()
    assert drift.free_selectors(hot, hot).count() == 0
    assert [r.field for r in drift.free_selectors(hot, hot.where("field = 7")).collect()] == [7]
    assert time.monotonic() - start < 30
