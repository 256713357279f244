"""Compile, run, redesign, repair: over pages of invented items."""

import pytest
from pyspark.sql import functions as F

from tarnflow.functions.types import parse_type
from tarnflow.operators import nodes, probes
from tarnflow.operators.extraction import Selector
from tarnflow.plans import heal, runs
from tarnflow.plans.compiling import FieldSpec, SourceSpec, compile_source
from tarnflow.sources import state

OLD = {"head": "headline", "score": "score", "talk": "comments", "tag": "h2", "word": "points"}
NEW = {"head": "hdr", "score": "karma", "talk": "replies", "tag": "div", "word": "pts"}
SPEC = SourceSpec("stories", {"title": FieldSpec(parse_type("str"), "headline"), "url": FieldSpec(parse_type("url"), "headline link"), "points": FieldSpec(parse_type("int"), "score of it"), "talk": FieldSpec(parse_type("int"), "comments on it")}, min_items=3)
BASE = "https://x.test/"


def site(d, n=12, salt=""):
    rows = "".join(f'<article class="story"><{d["tag"]} class="{d["head"]}"><a href="/item/{i}">Story {chr(97 + i)}{salt} of the day</a></{d["tag"]}><div class="meta"><span class="{d["score"]}">{7 * i + 3} {d["word"]}</span><a class="{d["talk"]}" href="/item/{i}#c">{i + 1} {d["talk"]}</a></div></article>' for i in range(n))
    return f"<html><body><main class='feed'>{rows}</main></body></html>"


def page(spark, *htmls, status=200):
    return spark.createDataFrame([(i, "https://x.test/", status, h) for i, h in enumerate(htmls)], "page_id long, url string, status int, html string")


@pytest.fixture(scope="module")
def compiled(spark):
    return compile_source(nodes.page_nodes(page(spark, site(OLD), site(OLD, salt="z"))).cache(), SPEC, F.lit(BASE))


def rows_of(run):
    return [tuple(r[f] for f in SPEC.fields) for r in run.items.orderBy("page_id", "item").collect()]


WANT = [(f"Story {chr(97 + i)} of the day", f"https://x.test/item/{i}", 7 * i + 3, i + 1) for i in range(12)]


def test_compile(compiled):
    assert compiled.item == "article.story" and not compiled.failed and set(compiled.via.values()) == {"heuristic"}
    by = {r["field"]: r for r in compiled.locks}
    assert by["points"]["css"].endswith("score") and by["points"]["tag"] == "span" and by["points"]["class_tokens"] == ["score"] and by["points"]["ancestor_sig"] == "div.meta<article.story<main.feed"
    assert by["points"]["value_shape"] == r"^\d+\s+[^\W\d_]+$" and by["points"]["match_count_ema"] == 12 and by["points"]["samples"] == ["3 points", "10 points", "17 points"]


def test_probe(spark):
    found = nodes.page_nodes(page(spark, site(OLD)))
    got = {r.field: r for r in probes.probe(found, "article.story", {"a": (parse_type("int"), Selector(".score")), "b": (parse_type("int"), Selector(".none")), "c": (parse_type("int | null"), Selector(".none")), "d": (parse_type("int"), Selector("h2 a"))}, F.lit(BASE)).collect()}
    assert [(got[k].scopes, got[k].matched_scopes, got[k].cast_ok, got[k].cast_fail) for k in "abcd"] == [(12, 12, 12, 0), (12, 0, 0, 12), (12, 0, 12, 0), (12, 12, 0, 12)]
    assert probes.probe(found.where("false"), "x", {"a": (parse_type("int"), Selector("b"))}).count() == 0


def test_run_redesign_and_repair(spark, compiled, tmp_path):
    good, locks_at = f"file://{tmp_path}/good", f"file://{tmp_path}/locks"
    first = runs.run_source(spark, SPEC, compiled.item, compiled.locks, page(spark, site(OLD)), good, base=F.lit(BASE))
    assert (first.status, first.exit_code, rows_of(first)) == ("ok", 0, WANT)
    state.save_locks(first.locks, locks_at, spark, compiled.item, first.content_len)
    locks, item, length = state.load_locks(spark, locks_at, SPEC.name)
    assert item == compiled.item and length == len(site(OLD)) and [r["field"] for r in locks] == list(SPEC.fields) and state.load_locks(spark, locks_at, "none")[0] == []

    # without repair the last good items are served
    held = runs.run_source(spark, SPEC, item, locks, page(spark, site(NEW)), good, heal_allowed=False, base=F.lit(BASE))
    assert (held.status, held.exit_code) == ("stale", 3) and held.items.where("stale").count() == 12 and {e["event"] for e in held.events} == {"drift"}
    # with repair all fields are found again
    fixed = runs.run_source(spark, SPEC, item, locks, page(spark, site(NEW)), good, content_len=length, base=F.lit(BASE))
    assert (fixed.status, fixed.exit_code, rows_of(fixed)) == ("healed", 0, WANT)
    status = {r["field"]: r["status"] for r in fixed.locks}
    assert {n for n, s in status.items() if s == heal.UNCONFIRMED} == set(fixed.healed) >= {"points", "talk"}
    # two quiet runs confirm
    locks = fixed.locks
    for _ in range(2):
        quiet = runs.run_source(spark, SPEC, item, locks, page(spark, site(NEW)), good, base=F.lit(BASE))
        assert quiet.status == "ok" and not quiet.causes
        locks = quiet.locks
    assert {r["status"] for r in locks} == {heal.VERIFIED} and {e["field"] for e in quiet.events} == set(fixed.healed)
    # drift while a repair waits for confirmation breaks the field
    again = runs.run_source(spark, SPEC, item, fixed.locks, page(spark, site(OLD)), good, base=F.lit(BASE))
    assert again.status == "stale" and again.exit_code == 3 and "thrash-revert" in {e["event"] for e in again.events}


def test_blocked_forced_and_not_compiled(spark, compiled, tmp_path):
    good = f"file://{tmp_path}/good"
    assert runs.run_source(spark, SPEC, None, [], page(spark, ""), good).exit_code == 1
    blocked = runs.run_source(spark, SPEC, compiled.item, compiled.locks, page(spark, "Just a moment", status=200), good, base=F.lit(BASE))
    assert (blocked.status, blocked.exit_code, blocked.items) == ("blocked", 2, None) and blocked.events[0]["event"] == "blocked"
    forced = runs.run_source(spark, SPEC, compiled.item, compiled.locks, page(spark, site(OLD), "captcha"), good, forced=True, base=F.lit(BASE))
    assert set(forced.causes) == set(SPEC.fields) and forced.causes["title"] == ["forced"] and [(r[0], r[2]) for r in rows_of(forced)] == [(w[0], w[2]) for w in WANT]
    done, worst = runs.run_sources([lambda: forced, lambda: blocked])
    assert len(done) == 2 and worst == 2


def test_model_proposes_what_candidates_lack(spark):
    spec = SourceSpec("s", {"price": FieldSpec(parse_type("int"), "price")}, item=None)
    html = "<html><body>" + "".join(f"<div class='c'><b data-p='{i}'></b><i>x</i></div>" for i in range(5)) + "</body></html>"
    replies = iter(["no idea", "SELECTOR: b\nATTR: text", "SELECTOR: b\nATTR: data-p"])
    found = nodes.page_nodes(page(spark, html)).cache()
    out = compile_source(found, spec, F.lit(BASE), complete=lambda prompt: next(replies))
    assert out.failed == ["price"] or out.via == {"price": "proposal"}
    from tarnflow.plans.compiling import proposed

    replies = iter(["SELECTOR: b\nATTR: text", "SELECTOR: b\nATTR: data-p"])
    assert proposed(lambda prompt: next(replies), found, "div.c", "price", spec.fields["price"], html) == Selector("b", "data-p")


def test_pages_give_what_the_node_table_gives(spark):
    from tarnflow.operators import extraction

    some = page(spark, site(OLD), None, "", site(NEW), "<p>no item</p>")
    fields = {"title": (parse_type("str"), Selector(".headline > a")), "up": (parse_type("int"), Selector("span", post=(r"regex:(\d+)",))), "links": (parse_type("list[str]"), Selector("a[href]", "href")), "none": (parse_type("str"), Selector("h9"))}
    for item in ("article.story", None, "h9"):
        by_nodes = extraction.extract_raw(nodes.page_nodes(some), item, fields)
        from_pages = extraction.extract_pages(some, item, fields).select(by_nodes.columns)
        if item is None:  # the node table has no row for a page without elements
            from_pages = from_pages.where("page_id NOT IN (1, 2)")
        assert sorted(map(str, from_pages.collect())) == sorted(map(str, by_nodes.collect()))


def test_single_runs_read_full_css_and_deep_pages(spark):
    spec = SourceSpec("list", {"odd": FieldSpec(parse_type("list[str]"), selector=Selector("li:nth-child(2n+1)")), "after": FieldSpec(parse_type("str"), selector=Selector("h2 + p ~ b:last-child"))}, item="main")
    html = "<main><h2>t</h2><p>x</p><i>y</i><b>z</b></main>" .replace("<i>", "<ul>" + "".join(f"<li>{i}</li>" for i in range(5)) + "</ul><i>")
    deep = "<div>" * 1500 + html + "</div>" * 1500
    locks = [{"source": "list", "field": n, "field_order": k, "css": f.selector.css, "attr": "text", "fallbacks": [], "status": heal.VERIFIED, "confirm_runs": 0, "heal_count": 0, "value_shape": "", "samples": [], "match_count_ema": None, "null_rate_ema": None, "len_mean": None, "tag": "li" if k == 0 else "b", "class_tokens": [], "ancestor_sig": ""} for k, (n, f) in enumerate(spec.fields.items())]
    done = runs.run_source(spark, spec, "main", locks, page(spark, html, deep), heal_allowed=False, base=F.lit(BASE))
    assert [(r.odd, r.after) for r in done.items.orderBy("page_id").collect()] == [(["0", "2", "4"], "z")] * 2, (done.status, done.error, done.causes)
