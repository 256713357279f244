"""A parsed page as intervals, and CSS selectors as data that run on it.

Elements are numbered in document order; an element's descendants are the numbers
up to its ``end``.  So a descendant step is a range test, child and sibling steps
are look-ups of a number, and nothing is copied down the tree: a page of any depth
costs as much as its length.  A selector is text in a row; a task reads each
distinct one once and runs it on sorted arrays of numbers.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.nodes import BLOCKS, ENDS, VOID, SelectorError

ELEMENTS = "page_id long, ix int, end int, parent int, depth int, tag string, id string, classes array<string>, attrs map<string,string>, nth int, nth_last int, nth_type int, nth_type_last int, n_children int, text string"


class Page(HTMLParser):
    """The elements of one page; forgives unclosed and stray tags.  ``pieces`` are the stripped texts in document order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.up: list[int] = []
        self.ends: list[int] = []
        self.places: list[tuple[int, int]] = []  # of an element's texts among the pieces
        self.pieces: list[str] = []
        self.owners: list[int] = []
        self._open: list[int] = []
        self._counts: Counter[str] = Counter()  # open elements by tag
        self.feed(html)
        self.close()
        self._ended(0)
        self.parent, self.end = np.array(self.up, np.int64), np.array(self.ends, np.int64)
        self._siblings()

    def _ended(self, at: int) -> None:
        """All open elements from ``at`` on end here."""
        for i in self._open[at:]:
            self.ends[i] = len(self.tags) - 1
            self.places[i] = (self.places[i][0], len(self.pieces))
            self._counts[self.tags[i]] -= 1
        del self._open[at:]

    def _close(self, tags: set[str], within: set[str]) -> None:
        if any(self._counts[t] for t in tags):
            for at in range(len(self._open) - 1, -1, -1):
                tag = self.tags[self._open[at]]
                if tag in tags:
                    return self._ended(at)
                if tag in within:
                    return None
        return None

    def handle_starttag(self, tag, attrs):
        self._close(ENDS.get(tag, set()), {"ul", "ol", "table", "dl", "select"})
        if tag in BLOCKS:
            self._close({"p"}, BLOCKS - {"p"})
        i = len(self.tags)
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in reversed(attrs)})
        self.up.append(self._open[-1] if self._open else -1)
        self.ends.append(i)
        self.places.append((len(self.pieces), len(self.pieces)))
        if tag not in VOID:
            self._open.append(i)
            self._counts[tag] += 1

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close({tag}, set())

    def handle_data(self, data):
        if piece := data.strip():
            self.pieces.append(piece)
            self.owners.append(self._open[-1] if self._open else -1)

    def _siblings(self) -> None:
        n = len(self.tags)
        self.nth, self.nth_last, self.nth_type, self.nth_type_last = (np.ones(n, np.int64) for _ in range(4))
        self.previous, self.n_children = np.full(n, -1), np.zeros(n, np.int64)
        last: dict[int, int] = {}
        kinds: dict[tuple[int, str], int] = defaultdict(int)
        for i, (p, tag) in enumerate(zip(self.up, self.tags)):
            if p >= 0:
                self.n_children[p] += 1
            if (before := last.get(p)) is not None:
                self.previous[i], self.nth[i] = before, self.nth[before] + 1
            last[p] = i
            kinds[p, tag] += 1
            self.nth_type[i] = kinds[p, tag]
        for i, (p, tag) in enumerate(zip(self.up, self.tags)):
            self.nth_last[i] = self.nth[last[p]] - self.nth[i] + 1
            self.nth_type_last[i] = kinds[p, tag] - self.nth_type[i] + 1

    def text(self, i: int) -> str:
        a, b = self.places[i]
        return " ".join(self.pieces[a:b])

    def classes(self, i: int) -> list[str]:
        return self.attrs[i].get("class", "").split()

    def value(self, i: int, attr: str) -> str | None:
        """Text or attribute; empty is null."""
        return (self.text(i) if attr == "text" else self.attrs[i].get(attr, "").strip()) or None

    def signature(self, i: int, ancestors: int = 3) -> tuple[str, list[str], str]:
        """Tag, sorted classes, and the nearest ancestors as ``td.subtext<tr<table``."""
        above, at = [], self.up[i]
        while at >= 0 and len(above) < ancestors:
            above.append(".".join([self.tags[at], *sorted(self.classes(at))[:1]]))
            at = self.up[at]
        return self.tags[i], sorted(self.classes(i)), "<".join(above)

    def where(self, compound: tuple) -> np.ndarray:
        """Numbers of all elements that a compound selector matches, in order."""
        found: Iterator[int] = range(len(self.tags))
        for kind, *args in compound:
            test = _TESTS[kind]
            found = [i for i in found if test(self, i, *args)]
        return np.fromiter(found, np.int64)


# ------------------------------------------------------------------- selectors

_IDENT = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_SIMPLE = re.compile(
    rf"(?P<tag>\*|{_IDENT})|\.(?P<cls>{_IDENT})|\#(?P<id>{_IDENT})"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|!]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\s\]]+)\s*(?P<flag>[iI])?\s*)?\]"
    r"|:(?P<pseudo>[\w-]+)(?:\((?P<arg>(?:[^()\"']|\"[^\"]*\"|'[^']*'|\([^()]*\))*)\))?"
)
_GAP = re.compile(r"\s*([>+~,])\s*|\s+")
_NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*", re.I)


def _steps(a: int, b: int, x: int) -> bool:
    """Whether x is a * k + b for some k from 0."""
    return x == b if a == 0 else (x - b) % a == 0 and (x - b) // a >= 0


def _attribute(page: Page, i: int, name: str, op: str | None, value: str, fold: bool) -> bool:
    have = page.attrs[i].get(name)
    if op == "!=":
        return have != value
    if have is None or op is None:
        return have is not None
    if fold:
        have, value = have.lower(), value.lower()
    if op == "=":
        return have == value
    if op == "|=":
        return have == value or have.startswith(value + "-")
    if op == "~=":
        return value in have.split()
    return bool(value) and {"^=": have.startswith, "$=": have.endswith, "*=": have.__contains__}[op](value)


_TESTS: dict[str, Callable[..., bool]] = {
    "tag": lambda p, i, v: p.tags[i] == v,
    "class": lambda p, i, v: v in p.attrs[i].get("class", "").split(),
    "id": lambda p, i, v: p.attrs[i].get("id") == v,
    "attr": _attribute,
    "nth": lambda p, i, a, b: _steps(a, b, int(p.nth[i])),
    "nth_last": lambda p, i, a, b: _steps(a, b, int(p.nth_last[i])),
    "nth_type": lambda p, i, a, b: _steps(a, b, int(p.nth_type[i])),
    "nth_type_last": lambda p, i, a, b: _steps(a, b, int(p.nth_type_last[i])),
    "root": lambda p, i: p.up[i] < 0,
    "empty": lambda p, i: not p.n_children[i] and p.places[i][0] == p.places[i][1],
    "contains": lambda p, i, v: v in p.text(i),
    "any": lambda p, i, several: any(all(_TESTS[k](p, i, *args) for k, *args in c) for c in several),
    "none": lambda p, i, several: not any(all(_TESTS[k](p, i, *args) for k, *args in c) for c in several),
}
_PLACES = {"nth-child": "nth", "nth-last-child": "nth_last", "nth-of-type": "nth_type", "nth-last-of-type": "nth_type_last"}
_FIRSTS = {"first-child": ("nth",), "last-child": ("nth_last",), "first-of-type": ("nth_type",), "last-of-type": ("nth_type_last",), "only-child": ("nth", "nth_last"), "only-of-type": ("nth_type", "nth_type_last")}


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def _pseudo(name: str, arg: str | None) -> list[tuple]:
    if name in _FIRSTS and arg is None:
        return [(kind, 0, 1) for kind in _FIRSTS[name]]
    if name in _PLACES and arg is not None and (m := _NTH.fullmatch(arg)):
        word, a, sign, b, alone = m.groups()
        if alone is not None:
            return [(_PLACES[name], 0, int(alone))]
        if word:
            return [(_PLACES[name], 2, word.lower() == "odd")]
        step = int(a + "1" if a in ("", "+", "-") else a)
        return [(_PLACES[name], step, int((sign or "+") + (b or "0")))]
    if name in ("not", "is", "where") and arg:
        several = parse_selector(arg)
        if all(len(chain) == 1 for chain in several):
            return [("none" if name == "not" else "any", tuple(chain[0][1] for chain in several))]
    if name in ("root", "empty") and arg is None:
        return [(name,)]
    if name == "contains" and arg:
        return [("contains", arg.strip().strip("\"'"))]
    raise SelectorError(f":{name}")


@lru_cache(maxsize=10_000)
def parse_selector(css: str) -> tuple[tuple[tuple[str, tuple], ...], ...]:
    """A selector as alternatives, each a chain of (combinator to the one before, compound); compounds are tuples of tests."""
    chains, chain, how, at, text = [], [], " ", 0, css.strip()
    while True:
        tests, start = [], at
        while at < len(text) and (m := _SIMPLE.match(text, at)):
            g = m.groupdict()
            if g["tag"] and at > start:
                break
            at = m.end()
            if g["tag"] and g["tag"] != "*":
                tests.append(("tag", _plain(g["tag"]).lower()))
            elif g["cls"]:
                tests.append(("class", _plain(g["cls"])))
            elif g["id"]:
                tests.append(("id", _plain(g["id"])))
            elif g["attr"]:
                value = g["val"] or ""
                tests.append(("attr", g["attr"].lower(), g["op"], value[1:-1] if value[:1] in "\"'" and value else value, bool(g["flag"])))
            elif g["pseudo"]:
                tests += _pseudo(g["pseudo"].lower(), g["arg"])
        if at == start:
            raise SelectorError(css)
        chain.append((how, tuple(tests)))
        if at == len(text):
            return (*chains, tuple(chain))
        if not (m := _GAP.match(text, at)) or m.end() == len(text):
            raise SelectorError(css)
        at, how = m.end(), m[1] or " "
        if how == ",":
            chains.append(tuple(chain))
            chain, how = [], " "


def select(page: Page, css: str, scope: int | None = None, known: dict | None = None) -> np.ndarray:
    """Numbers of the elements that match, in order; all parts lie within ``scope`` (itself counts).  Raises SelectorError.

    ``known`` keeps what compounds matched on this page.
    """
    known = {} if known is None else known
    first, last = (0, len(page.tags) - 1) if scope is None else (scope, int(page.end[scope]))

    def of(compound: tuple) -> np.ndarray:
        if compound not in known:
            known[compound] = page.where(compound)
        found = known[compound]
        return found[np.searchsorted(found, first) : np.searchsorted(found, last, side="right")]

    out = []
    for (_, start), *rest in parse_selector(css):
        now = of(start)
        for how, compound in rest:
            new = of(compound)
            if not len(now) or not len(new):
                now = new[:0]
            elif how == " ":
                reach = np.maximum.accumulate(page.end[now])
                before = np.searchsorted(now, new)
                now = new[(before > 0) & (reach[before - 1] >= new)]
            elif how == ">":
                now = new[np.isin(page.parent[new], now)]
            elif how == "+":
                now = new[np.isin(page.previous[new], now)]
            else:
                parents, at = np.unique(page.parent[now], return_index=True)
                place = np.minimum(np.searchsorted(parents, page.parent[new]), len(parents) - 1)
                now = new[(parents[place] == page.parent[new]) & (now[at][place] < new)]
        out.append(now)
    return out[0] if len(out) == 1 else np.unique(np.concatenate(out))


def page_elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row for each element of each page (ELEMENTS), its own texts in ``text``; null pages have none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ELEMENTS))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(html or "")
                own: dict[int, list[str]] = defaultdict(list)
                for piece, i in zip(page.pieces, page.owners):
                    own[i].append(piece)
                depth = [0] * len(page.tags)
                for i, p in enumerate(page.up):
                    depth[i] = depth[p] + 1 if p >= 0 else 0
                for a in range(0, len(page.tags), 5000):
                    some = range(a, min(a + 5000, len(page.tags)))
                    rows = [{"page_id": name, "ix": i, "end": int(page.end[i]), "parent": page.up[i], "depth": depth[i], "tag": page.tags[i], "id": page.attrs[i].get("id"), "classes": page.classes(i), "attrs": list(page.attrs[i].items()), "nth": int(page.nth[i]), "nth_last": int(page.nth_last[i]), "nth_type": int(page.nth_type[i]), "nth_type_last": int(page.nth_type_last[i]), "n_children": int(page.n_children[i]), "text": " ".join(own[i])} for i in some]
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return bounded_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(parsed, ELEMENTS)


# ------------------------------------------------------- extraction by rules

#: Pages and bytes of an Arrow batch, and rows handed on at once.
BATCH_ROWS, BATCH_BYTES, OUT_ROWS = 500, 4 << 20, 5000

RULES = "source string, item string, field string, css string, attr string, post array<string>, is_list boolean"
FOUND = "source string, page_id long, url string, item int, field string, n_nodes int, raws array<string>, tag string, classes array<string>, ancestors string"


def _posted(value: str | None, steps: list[str]) -> str | None:
    for step in steps:
        if value is not None and step == "strip":
            value = value.strip()
        elif value is not None and step.startswith("regex:"):
            m = re.search(step.removeprefix("regex:"), value)
            value = m and (m[1] if m.re.groups else m[0])
    return value


def extract_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row (FOUND) for each field of each item of each page, by the rules (RULES) of the page's source.

    Any number of sources is read in one job: rules are rows, joined by source,
    and a page is parsed once.  Without an item selector a page is one item.  A
    scalar field has its first node's value (null where that is empty), a list all
    values that are not empty.  An item selector that is not understood gives no
    items, a field's gives no values.  ``tag``, ``classes`` and ``ancestors`` are of
    the field's first node.  Pages: source, page_id, url, html.
    """
    each = rules.groupBy("source").agg(F.first("item").alias("rule_item"), F.array_sort(F.collect_list(F.struct("field", "css", "attr", F.coalesce("post", F.expr("array()").cast("array<string>")).alias("post"), "is_list"))).alias("rules"))
    return _found(pages.select("source", "page_id", "url", "html").join(each, "source"))


def extract_with(pages: DataFrame, item: str | None, rules: list[tuple[str, str, str, list[str], bool]]) -> DataFrame:
    """:func:`extract_rules` of one source: the rules (field, css, attr, post, is_list) go with each page, so nothing is shuffled.  Pages: page_id, html."""
    texts = lambda some: F.array(*map(F.lit, some)).cast("array<string>")
    given = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(css).alias("css"), F.lit(attr).alias("attr"), texts(post).alias("post"), F.lit(many).alias("is_list")) for n, css, attr, post, many in rules])
    return _found(pages.select(F.lit("").alias("source"), "page_id", F.lit("").alias("url"), "html", F.lit(item).cast("string").alias("rule_item"), given.alias("rules")))


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session is told to hand pages to Python in batches of bounded rows and bytes (smaller settings stay)."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None) or "0"
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def _found(joined: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(FOUND))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for row in range(len(batch)):
                source, name, url, html, item, fields = (c[row].as_py() for c in batch.columns)
                page, known = Page(html or ""), {}
                try:
                    scopes = [None] if item is None else select(page, item, None, known).tolist()
                except SelectorError:
                    scopes = []
                for scope in scopes:
                    for f in fields:
                        try:
                            hits = select(page, f["css"], scope, known).tolist()
                        except SelectorError:
                            hits = []
                        values = [_posted(page.value(i, f["attr"]), f["post"]) for i in (hits if f["is_list"] else hits[:1])]
                        tag, classes, ancestors = page.signature(hits[0]) if hits else (None, None, None)
                        out.append({"source": source, "page_id": name, "url": url, "item": scope or 0, "field": f["field"], "n_nodes": len(hits), "raws": [v for v in values if v] if f["is_list"] else values, "tag": tag, "classes": classes, "ancestors": ancestors})
                        if len(out) >= OUT_ROWS:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return bounded_batches(joined).select("source", F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"), "rule_item", "rules").mapInArrow(found, FOUND)
