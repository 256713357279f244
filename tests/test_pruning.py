"""Pages cut down for a prompt."""

from tarnflow.operators.elements import Page
from tarnflow.operators.pruning import BETWEEN, TRUNCATED, hit_regions, page_regions, pruned, region_html

HTML = "<!-- c --><div class='a b' onclick='x()' href='/u?a=1&amp;b=2'>one &lt; two<script>var x = '<p>';</script><br>tail<ul><li>x<li>y</ul>" + "z" * 100 + "</div><svg><path/></svg><p title='" + "t" * 200 + "'>" + "w" * 100 + "<b>q</b>" + "v" * 50 + "</p>"


def test_pruned():
    text = pruned(Page(HTML))
    assert text == '<div class="a b" href="/u?a=1&amp;b=2">one &lt; two<br>tail<ul><li>x</li><li>y</li></ul>' + "z" * 40 + '…</div><p title="' + "t" * 120 + '">' + "w" * 80 + "…<b>q</b>" + "v" * 40 + "…</p>"
    assert pruned(Page(text)) == text.replace("…", "…") and Page(text).tags == [t for t in Page(HTML).tags if t not in ("script", "svg", "path")]
    assert pruned(Page(HTML), cap=20) == text[:20] + TRUNCATED and pruned(Page("")) == "" and pruned(Page("text only")) == ""
    deep = "<div>" * 3000 + "x"
    assert len(pruned(Page(deep), cap=100)) == 100 + len(TRUNCATED)


def test_regions(spark):
    page = "<main>" + "".join(f"<article><h2>Name {i}</h2><div><span>{i} points</span></div></article>" for i in range(12)) + "</main>"
    tree = Page(page)
    articles = [i for i, t in enumerate(tree.tags) if t == "article"]
    assert hit_regions(tree, [], r"^\d+ points$") == articles[:8] and hit_regions(tree, ["5 poi", ""], "") == [articles[5]] and hit_regions(tree, ["Name 3"], "(") == [0]
    one = "<article><h2>Name 5</h2><div><span>5 points</span></div></article>"
    assert region_html(page, ["5 points"], "") == one and region_html(page, ["gone"], "") == pruned(tree)
    df = spark.createDataFrame([(1, page, ["5 points", "6 points"], None), (2, None, None, None), (3, page, None, "[")], "page_id long, html string, samples array<string>, shape string")
    got = {r.page_id: r.region for r in page_regions(df).collect()}
    assert got == {1: one + BETWEEN + one.replace("5", "6"), 2: "", 3: pruned(tree)}


def test_a_model_sees_the_surroundings(spark):
    """The last rung's prompt holds the part of the page with the field's old values."""
    from pyspark.sql import functions as F

    from tarnflow.functions.types import parse_type
    from tarnflow.operators import nodes
    from tarnflow.operators.extraction import Selector
    from tarnflow.plans import runs
    from tarnflow.plans.compiling import FieldSpec, SourceSpec, lock_rows

    spec = SourceSpec("s", {"n": FieldSpec(parse_type("int"))})
    old = "<main>" + "".join(f"<p><i class='n'>{i * 7} items</i><b>none</b></p>" for i in range(5)) + "</main>"
    pages = lambda h: spark.createDataFrame([(0, "https://s.test/", 200, h)], "page_id long, url string, status int, html string")
    locks = lock_rows(nodes.page_nodes(pages(old)), "p", spec, {"n": (Selector("i.n"), [])})
    prompts = []
    other = "<main>" + "".join("<p><em class='n2'>some items</em><b>none</b></p>" for _ in range(5)) + "</main>"
    done = runs.run_source(spark, spec, "p", locks, pages(other), complete=lambda p: prompts.append(p) or "no idea", base=F.lit("https://s.test/"))
    assert done.exit_code == 3 and prompts and '<em class="n2">some items</em>' in prompts[0]
