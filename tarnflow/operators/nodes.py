"""Pages as a table of element nodes, and CSS selectors as Column expressions on it.

Parsing HTML is the one step in Python: an Arrow batch of pages becomes one row
for each element, with its path from the root.  Selectors are then predicates on
the path; no page is parsed twice and no selector needs a join.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without content, and which open elements a start tag ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}

STEP = "struct<ix:int,tag:string,id:string,classes:array<string>,attrs:map<string,string>,nth:int,nth_type:int>"
NODES = f"page_id long, ix int, depth int, n_children int, text string, path array<{STEP}>"


class _Tree(HTMLParser):
    """Elements in document order with their text pieces; forgives unclosed and stray tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.steps: list[dict] = []
        self.paths: list[list[int]] = []
        self.texts: list[list[str]] = []
        self.open: list[int] = []
        self.children: list[list[str]] = []
        self.top: list[str] = []
        self.counts: dict[int, Counter] = defaultdict(Counter)  # of each parent: children by tag

    def _close(self, tags: set[str], within: set[str]) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            tag = self.steps[self.open[at]]["tag"]
            if tag in tags:
                del self.open[at:]
                return
            if tag in within:
                return

    def handle_starttag(self, tag, attrs):
        self._close(ENDS.get(tag, set()), {"ul", "ol", "table", "dl", "select"})
        if tag in BLOCKS:
            self._close({"p"}, BLOCKS - {"p"})
        above = self.children[self.open[-1]] if self.open else self.top
        above.append(tag)
        counts = self.counts[self.open[-1] if self.open else -1]
        counts[tag] += 1
        given = {k: v or "" for k, v in reversed(attrs)}
        self.steps.append({"ix": len(self.steps), "tag": tag, "id": given.get("id"), "classes": given.get("class", "").split(), "attrs": list(given.items()), "nth": len(above), "nth_type": counts[tag]})
        self.paths.append([*self.open, len(self.steps) - 1])
        self.texts.append([])
        self.children.append([])
        if tag not in VOID:
            self.open.append(len(self.steps) - 1)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close({tag}, set())

    def handle_data(self, data):
        if piece := data.strip():
            for at in self.open:
                self.texts[at].append(piece)


def page_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row for each element of each page, in document order (``ix``); null pages have none."""
    from pyspark.sql.types import StructType

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = _Tree()
                tree.feed(html or "")
                tree.close()
                rows = [{"page_id": page, "ix": i, "depth": len(p) - 1, "n_children": len(tree.children[i]), "text": " ".join(tree.texts[i]), "path": [tree.steps[a] for a in p]} for i, p in enumerate(tree.paths)]
                for a in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_pylist(rows[a : a + 2000], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(NODES))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(parsed, NODES)


# ------------------------------------------------------------------- selectors

_PART = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[~^$*|]?=)['\"]?(?P<val>[^'\"\]]*)['\"]?)?\]|:nth-child\((?P<nth>\d+)\)|:nth-of-type\((?P<type>\d+)\)|(?P<first>:first-child)|:not\((?P<inner>[^)]+)\)")


class SelectorError(ValueError):
    """A selector that is not understood."""


def _compound(text: str):
    """A function of a path step: whether it matches ``tag.class#id[attr=value]:nth-child(n)``."""
    tests, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise SelectorError(text)
        at, g = m.end(), m.groupdict()
        if g["tag"] and g["tag"] != "*":
            tests.append(lambda s, v=g["tag"].lower(): s["tag"] == v)
        elif g["cls"]:
            tests.append(lambda s, v=g["cls"]: F.array_contains(s["classes"], v))
        elif g["id"]:
            tests.append(lambda s, v=g["id"]: F.coalesce(s["id"] == v, F.lit(False)))
        elif g["attr"]:
            how = {None: lambda a, v: a.isNotNull(), "=": lambda a, v: a == v, "^=": lambda a, v: a.startswith(v), "$=": lambda a, v: a.endswith(v), "*=": lambda a, v: a.contains(v), "~=": lambda a, v: F.array_contains(F.split(a, r"\s+"), v), "|=": lambda a, v: (a == v) | a.startswith(v + "-")}[g["op"]]
            tests.append(lambda s, a=g["attr"], v=g["val"], how=how: F.coalesce(how(s["attrs"][a], v), F.lit(False)))
        elif g["nth"] or g["first"]:
            tests.append(lambda s, v=int(g["nth"] or 1): s["nth"] == v)
        elif g["type"]:
            tests.append(lambda s, v=int(g["type"]): s["nth_type"] == v)
        elif g["inner"]:
            tests.append(lambda s, inner=_compound(g["inner"]): ~inner(s))
    if not text:
        raise SelectorError(text)

    def match(step: Column) -> Column:
        out = F.lit(True)
        for test in tests:
            out = out & test(step)
        return out

    return match


def _chain(css: str) -> list[tuple[str, object]]:
    """[(combinator to the one before, compound)] of a selector without commas."""
    out = []
    for gap, part in re.findall(r"(\s*>\s*|\s+|^)((?:\[[^\]]*\]|\([^)]*\)|[^\s>])+)", css.strip()):
        out.append((">" if ">" in gap else " ", _compound(part)))
    if not out:
        raise SelectorError(css)
    return out


def match_positions(path: Column, css: str) -> Column:
    """Positions (from 1) in a path at which an element matches, judged within the path."""
    found = [_positions(path, _chain(one)) for one in css.split(",")]
    return found[0] if len(found) == 1 else F.array_distinct(F.concat(*found))


def _positions(path: Column, chain: list) -> Column:
    nothing = F.array(*[F.lit(False)] * len(chain))
    start = F.struct(nothing.alias("ever"), nothing.alias("last"), F.array().cast("array<int>").alias("hits"), F.lit(1).alias("at"))

    def step(state: Column, element: Column) -> Column:
        # of each beginning of the chain: whether it ends at this element, and at any so far
        now = [part(element) & (F.lit(True) if k == 0 else state["last" if how == ">" else "ever"][k - 1]) for k, (how, part) in enumerate(chain)]
        ever = [state["ever"][k] | x for k, x in enumerate(now)]
        return F.struct(F.array(*ever).alias("ever"), F.array(*now).alias("last"), F.when(now[-1], F.concat(state["hits"], F.array(state["at"]))).otherwise(state["hits"]).alias("hits"), (state["at"] + 1).alias("at"))

    return F.aggregate(path, start, step)["hits"]


def matches(path: Column, css: str) -> Column:
    """Whether the element at the path's end matches."""
    out = F.lit(False)
    for one in css.split(","):
        out = out | _ends(path, _chain(one))
    return out


def _ends(path: Column, chain: list) -> Column:
    """Short chains are tests of the last step and of those above; longer ones walk the path."""
    (how, own), size = chain[-1], F.size(path)
    if len(chain) > 2:
        return F.array_contains(_positions(path, chain), size)
    here = F.coalesce(own(F.try_element_at(path, F.lit(-1))), F.lit(False))
    if len(chain) == 1:
        return here
    first = chain[0][1]
    if how == ">":
        return here & F.coalesce(first(F.try_element_at(path, F.lit(-2))), F.lit(False))
    return here & F.exists(F.slice(path, 1, F.greatest(size - 1, F.lit(0))), first)
