"""Pages as intervals and selectors on them, against a matcher that looks at one element at a time."""

import random
import time

import pytest

from tarnflow.operators import elements
from tarnflow.operators.elements import Page, page_elements, parse_selector, select
from tarnflow.operators.nodes import SelectorError


def tree(draw, depth=0):
    tag, cls = draw.choice(["div", "ul", "b", "i", "section"]), draw.choice(["", " class='a'", " class='b a'", " class='c' data-k='v-1 w'", " id='x'"])
    inner = "".join(draw.choice(["t", "", " u "]) + tree(draw, depth + 1) for _ in range(draw.randint(0, 3 if depth < 5 else 0)))
    return f"<{tag}{cls}>{inner}</{tag}>"


def siblings(page, i):
    return [j for j in range(len(page.tags)) if page.up[j] == page.up[i]]


def one(page, i, test):
    """One test of one element, by its definition."""
    kind, *args = test
    same = siblings(page, i)
    typed = [j for j in same if page.tags[j] == page.tags[i]]
    places = {"nth": same.index(i) + 1, "nth_last": len(same) - same.index(i), "nth_type": typed.index(i) + 1, "nth_type_last": len(typed) - typed.index(i)}
    if kind in places:
        a, b = args
        return any(a * k + b == places[kind] for k in range(0, 60)) if a else places[kind] == b
    return {
        "tag": lambda: page.tags[i] == args[0],
        "class": lambda: args[0] in page.classes(i),
        "id": lambda: page.attrs[i].get("id") == args[0],
        "attr": lambda: args[0] in page.attrs[i] and (args[1] is None or (args[1] == "~=" and args[2] in page.attrs[i][args[0]].split()) or (args[1] == "^=" and page.attrs[i][args[0]].startswith(args[2]))),
        "none": lambda: not any(all(one(page, i, t) for t in c) for c in args[0]),
        "any": lambda: any(all(one(page, i, t) for t in c) for c in args[0]),
        "root": lambda: page.up[i] < 0,
        "empty": lambda: not any(p == i for p in page.up) and not page.text(i),
    }[kind]()


def matches(page, i, chain, scope):
    """Whether an element ends a chain, all of it within the scope, by trying all elements for the part before."""
    inside = lambda j: scope is None or scope <= j <= page.end[scope]
    how, compound = chain[-1]
    if not inside(i) or not all(one(page, i, t) for t in compound):
        return False
    if len(chain) == 1:
        return True
    same = siblings(page, i)
    above, at = [], page.up[i]
    while at >= 0:
        above.append(at)
        at = page.up[at]
    before = {" ": above, ">": above[:1], "+": same[: same.index(i)][-1:], "~": same[: same.index(i)]}[how]
    return any(matches(page, j, chain[:-1], scope) for j in before)


SELECTORS = ["div", "*", ".a", ".a.b", "#x", "div .a", "div > .a", "div > ul > b", "b + i", ".a ~ b", "div ~ ul .a", "section b, i.a", ":first-child", "b:last-child", ":only-child", "div:nth-child(2n+1)", ":nth-child(odd) > *", ":nth-last-child(-n+2)", "i:nth-of-type(2)", "b:nth-last-of-type(1)", ":only-of-type", ":not(.a)", "div:not(.a, #x)", ":is(b, i).a", "[data-k]", "[data-k~='w']", "[data-k^=v]", ":empty", ":root > *", "ul:first-of-type + *", ".a > :not(b) + b ~ i"]


@pytest.mark.parametrize("seed", range(6))
def test_selectors_on_random_trees(seed):
    draw = random.Random(seed)
    page = Page("".join(tree(draw) for _ in range(3)))
    assert len(page.tags) > 10
    for css in SELECTORS:
        for scope in (None, draw.randrange(len(page.tags)), 0):
            want = [i for i in range(len(page.tags)) if any(matches(page, i, chain, scope) for chain in parse_selector(css))]
            assert select(page, css, scope).tolist() == want, (css, scope)


def test_escapes_quotes_and_errors():
    page = Page("<p class='md:flex'></p><a href='x]y' TITLE='Ab'>one two</a><br><p>z")
    assert select(page, r".md\:flex").tolist() == [0] and select(page, "a[href='x]y']").tolist() == [1]
    assert select(page, "[title=ab]").tolist() == [] and select(page, "[title=ab i]").tolist() == [1] and select(page, "a:contains('e t')").tolist() == [1]
    for bad in ("", ">", "a >", "a,,b", "a[", ":no-such", ":nth-child(x)", "a..b", "a)", "div:not(a b)", "."):
        with pytest.raises(SelectorError):
            select(page, bad)


def test_deep_and_wide_pages_cost_as_much_as_they_are_long():
    deep = "<div>" * 1500 + "x" + "</div>" * 1500
    began = time.perf_counter()
    page = Page(deep)
    assert select(page, "div > div div:last-child").size == 1498 and page.text(0) == "x"
    assert time.perf_counter() - began < 1
    spans = {}
    for n in (20_000, 80_000):
        text = "<i>" * n + "".join(f"<b>{k}" for k in range(n)) + "</u>" * n
        began = time.perf_counter()
        page = Page(text)
        assert select(page, "i + i, b ~ b").size == 0 and len(page.tags) == 2 * n
        spans[n] = time.perf_counter() - began
    assert spans[80_000] < 12 * spans[20_000]


def test_table(spark):
    rows = [(1, "<ul><li>a<li class='k'>b<b>c</b></ul><p>d<div>e"), (2, None), (3, "")]
    got = page_elements(spark.createDataFrame(rows, "page_id long, html string")).orderBy("page_id", "ix").collect()
    assert [(r.page_id, r.ix, r.end, r.parent, r.depth, r.tag, r.nth, r.nth_last, r.text) for r in got] == [(1, 0, 3, -1, 0, "ul", 1, 3, ""), (1, 1, 1, 0, 1, "li", 1, 2, "a"), (1, 2, 3, 0, 1, "li", 2, 1, "b"), (1, 3, 3, 2, 2, "b", 1, 1, "c"), (1, 4, 4, -1, 0, "p", 2, 2, "d"), (1, 5, 5, -1, 0, "div", 3, 1, "e")]
    assert got[2].classes == ["k"] and got[2].attrs == {"class": "k"}


def test_pages_come_to_python_in_small_batches(spark):
    """10,000 pages a batch, Spark's own setting, let a worker's memory grow with the table; a smaller setting of the caller's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rules = spark.createDataFrame([("s", None, "n", "li", "text", None, True)], elements.RULES)
    pages = spark.range(1200).selectExpr("'s' AS source", "id AS page_id", "'' AS url", "concat('<li>', id, '</li>') AS html")
    before = spark.conf.get(key)
    try:
        for given, want in (("10000", elements.BATCH_ROWS), ("0", elements.BATCH_ROWS), ("7", 7)):
            spark.conf.set(key, given)
            found = elements.extract_rules(pages, rules)
            assert int(spark.conf.get(key)) == want <= 500
        assert sorted(int(r.raws[0]) for r in found.collect()) == list(range(1200))
    finally:
        spark.conf.set(key, before)
