"""Many sources in one run, equal to runs of each one by itself."""

import pytest
from pyspark.sql import functions as F

from tarnflow.functions.types import parse_type
from tarnflow.operators import nodes
from tarnflow.operators.elements import extract_rules
from tarnflow.operators.extraction import Selector
from tarnflow.plans import heal, many, runs
from tarnflow.plans.compiling import FieldSpec, SourceSpec, lock_rows
from tarnflow.sources import state

KINDS = {"title": "str", "link": "url", "points": "int", "price": "float | null", "live": "bool", "day": "datetime | null", "kind": "enum[Big, small]", "tags": "list[str]"}


def spec_of(k):
    return SourceSpec(f"s{k}", {n: FieldSpec(parse_type(t)) for n, t in KINDS.items()}, min_items=1)


def selectors_of(k):
    return {"title": Selector(f"h2.t{k}"), "link": Selector(f"h2.t{k} a", "href"), "points": Selector(f".p{k}"), "price": Selector("i + b"), "live": Selector("div > u"), "day": Selector("time", "datetime"), "kind": Selector("em:last-of-type"), "tags": Selector("li:nth-child(odd)")}


def html_of(k, n, salt=0, cls=None):
    c = k if cls is None else cls
    rows = "".join(f"<article class='x'><h2 class='t{c}'><a href='/i/{i}'>Item {i + salt} of {k}</a></h2><span class='p{c}'>{i * 3} points</span><i></i><b>{'' if i % 3 == 0 else f'${i}.50'}</b><div><u>{'yes' if i % 2 else 'no'}</u></div><time datetime='2026-01-0{1 + i % 9}'></time><em>x</em><em class='k'>{'BIG' if i % 2 else 'Small'}</em><ul><li class='o'>a{i}<li>b<li>c</ul></article>" for i in range(n))
    return f"<html><body><main>{rows}</main></body></html>"


def pages_of(spark, rows):
    return spark.createDataFrame([(f"s{k}", i, f"https://s{k}.test/p{i}", status, html) for k, i, status, html in rows], "source string, page_id long, url string, status int, html string")


@pytest.fixture(scope="module")
def compiled(spark):
    """Locks of six sources, with the fingerprints of their pages."""
    out = []
    for k in range(6):
        found = nodes.page_nodes(spark.createDataFrame([(0, html_of(k, 6))], "page_id long, html string"))
        plain = {n: (s if n not in ("price", "kind", "tags") else Selector({"price": "b", "kind": "em.k", "tags": "li.o"}[n])) for n, s in selectors_of(k).items()}
        for r in lock_rows(found, "article.x", spec_of(k), {n: (s, []) for n, s in plain.items()}):
            out.append(r | {"css": selectors_of(k)[r["field"]].css})
    return out


def test_equal_to_single_runs(spark, compiled, tmp_path):
    simple = [r | {"css": {"price": "b", "kind": "em.k", "tags": "li.o"}.get(r["field"], r["css"])} for r in compiled]
    simple = [r | ({"status": heal.UNCONFIRMED, "confirm_runs": 1} if r["source"] == "s1" and r["field"] == "points" else {}) for r in simple]
    rows = [(0, 0, 200, html_of(0, 6)), (0, 1, 200, html_of(0, 6, 9)), (1, 0, 200, html_of(1, 5)), (2, 0, 200, "Just a moment..."), (2, 1, 503, html_of(2, 5)), (3, 0, 200, html_of(3, 6, cls="new")), (5, 0, 200, html_of(5, 6)), (5, 1, 200, "captcha")]
    pages = pages_of(spark, rows)
    specs = [spec_of(k) for k in range(5)] + [spec_of(5)]
    locks = spark.createDataFrame([r for r in simple if r["source"] != "s4"], state.LOCKS)
    states = spark.createDataFrame([(f"s{k}", "article.x", 2500.0 if k else None) for k in range(6)], many.STATE)
    done = many.run_all(spark, specs, locks, states, pages, heal_allowed=False)
    got = {r.source: r for r in done.sources.collect()}
    after = {(r.source, r.field): r for r in done.locks.collect()}
    for k, spec in enumerate(specs):
        own = [r for r in simple if r["source"] == spec.name and k != 4]
        some = pages.where(F.col("source") == spec.name).drop("source")
        want = runs.run_source(spark, spec, "article.x", own, some, content_len=2500.0 if k else None, heal_allowed=False, base=F.lit(f"https://s{k}.test/p0"))
        assert (got[spec.name].status, got[spec.name].exit_code, got[spec.name].error) == (want.status, want.exit_code, want.error), spec.name
        assert got[spec.name].content_len == pytest.approx(want.content_len)
        assert {r.field: r.causes for r in done.causes.where(F.col("source") == spec.name).collect()} == want.causes
        for r in want.locks:
            new = after[spec.name, r["field"]]
            assert (new.css, new.status, new.confirm_runs) == (r["css"], r["status"], r["confirm_runs"])
            assert new.match_count_ema == pytest.approx(r["match_count_ema"]) and new.null_rate_ema == pytest.approx(r["null_rate_ema"])
        if want.items is not None:
            mine = many.typed_items(done, spec).orderBy("page_id", "item").select(*KINDS).collect()
            assert [tuple(r) for r in mine] == [tuple(r) for r in want.items.orderBy("page_id", "item").select(*KINDS).collect()] and len(mine) >= 5
    assert got["s0"].status == got["s5"].status == got["s1"].status == "ok" and got["s2"].status == "blocked" and got["s3"].exit_code == 3 and got["s4"].exit_code == 1 and done.worst() == 3


def test_repairs_only_what_drifted(spark, compiled, tmp_path):
    good = f"file://{tmp_path}/good"
    simple = [r | {"css": {"price": "b", "kind": "em.k", "tags": "li.o"}.get(r["field"], r["css"])} for r in compiled if r["source"] in ("s0", "s3")]
    simple = [r | {"fallbacks": [{"css": ".pnew", "attr": "text"}]} if r["field"] == "points" else r for r in simple]
    old = html_of(3, 6).replace("class='p3'", "class='pnew'")
    pages = pages_of(spark, [(0, 0, 200, html_of(0, 6)), (3, 0, 200, old)])
    states = spark.createDataFrame([("s0", "article.x", None), ("s3", "article.x", None)], many.STATE)
    done = many.run_all(spark, [spec_of(0), spec_of(3)], spark.createDataFrame(simple, state.LOCKS), states, pages, good, base=F.lit("https://x.test/"))
    assert {r.source: (r.status, r.exit_code) for r in done.sources.collect()} == {"s0": ("ok", 0), "s3": ("healed", 0)} and set(done.repaired) == {"s3"}
    assert [r.points for r in many.typed_items(done, spec_of(3)).orderBy("item").collect()] == [0, 3, 6, 9, 12, 15]
    fixed = {r.field: r for r in done.locks.where("source = 's3'").collect()}
    assert fixed["points"].css == ".pnew" and fixed["points"].status == heal.UNCONFIRMED and done.worst() == 0


def test_a_thousand_sources_are_one_run(spark, compiled):
    """Selectors are rows: a thousand sources, each with its own, are read by one extraction."""
    lock = {r["field"]: r for r in compiled if r["source"] == "s0"}
    locks = [lock[n] | {"source": f"s{k}", "css": s.css} for k in range(1000) for n, s in selectors_of(k).items() if n in ("title", "points")]
    specs = [SourceSpec(f"s{k}", {n: FieldSpec(parse_type(KINDS[n])) for n in ("title", "points")}) for k in range(1000)]
    pages = pages_of(spark, [(k, 0, 200, html_of(k, 6)) for k in range(1000)])
    states = spark.createDataFrame([(f"s{k}", "article.x", None) for k in range(1000)], many.STATE)
    done = many.run_all(spark, specs, spark.createDataFrame(locks, state.LOCKS), states, pages)
    assert done.sources.groupBy("status", "exit_code").count().collect() == [("ok", 0, 1000)] and not done.repaired
    assert done.items.where("field = 'points'").agg(F.sum(F.col("value").cast("long"))).first()[0] == 1000 * sum(range(0, 18, 3))


def test_rules_of_odd_pages(spark):
    rules = spark.createDataFrame([("a", "p", "x", "b", "text", ["strip", "regex:(\\d+)"], False), ("a", "p", "y", "b >", "text", None, False), ("a", "p", "z", "b", "k", [], True), ("b", "p[", "x", "b", "text", [], False), ("c", None, "x", "p", "text", [], False)], "source string, item string, field string, css string, attr string, post array<string>, is_list boolean")
    pages = pages_of(spark, []).union(spark.createDataFrame([("a", 1, "u", 200, "<p>q <b k='1'> n 12 m</b><b k=''>7</b><b k=2></b><p>r"), ("a", 2, "u", 200, None), ("b", 1, "u", 200, "<p>"), ("c", 1, "u", 200, "<p>one<p>two"), ("d", 1, "u", 200, "<p>")], pages_of(spark, []).schema))
    got = sorted((r.source, r.page_id, r.item, r.field, r.n_nodes, r.raws) for r in extract_rules(pages, rules).collect())
    assert got == [("a", 1, 0, "x", 3, ["12"]), ("a", 1, 0, "y", 0, []), ("a", 1, 0, "z", 3, ["1", "2"]), ("a", 1, 4, "x", 0, []), ("a", 1, 4, "y", 0, []), ("a", 1, 4, "z", 0, []), ("c", 1, 0, "x", 2, ["one"])]
