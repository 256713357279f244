"""Pages cut down for a prompt: noise and long texts go, and where old values are known only their surroundings stay."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.elements import Page
from tarnflow.operators.nodes import VOID

# Elements that say nothing about a page's items, attributes that do, and the lengths of what is kept.
DROPPED = ("script", "style", "noscript", "svg", "iframe", "template", "link", "meta")
KEPT_ATTRS = ("class", "id", "href", "src", "name", "type", "title", "datetime", "data-id", "role", "aria-label")
ATTR_CHARS, TEXT_CHARS, TAIL_CHARS, HIT_CHARS = 120, 80, 40, 200
CAP, REGION_CAP, REGIONS, LEVELS = 14_000, 12_000, 8, 2
TRUNCATED, BETWEEN = "\n<!-- truncated -->", "\n<!-- region -->\n"


def _cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most] + "…"


def pruned(page: Page, root: int | None = None, cap: int = CAP) -> str:
    """The page, or one element of it, written again without noise; at most ``cap`` characters and a mark."""
    first, last = (0, len(page.tags) - 1) if root is None else (root, int(page.end[root]))
    out: list[str] = []
    open_: list[int] = []
    began: set[int] = set()  # open elements that have had a child: their texts are tails
    piece = page.places[first][0] if page.tags else 0
    size = skip_to = 0

    def texts(until: int) -> None:
        nonlocal piece
        while piece < until:
            if open_ and page.owners[piece] == open_[-1]:
                out.append(entities.escape(_cut(page.pieces[piece], TAIL_CHARS if open_[-1] in began else TEXT_CHARS), quote=False))
            piece += 1

    def closed() -> None:
        i = open_.pop()
        texts_end = page.places[i][1]
        open_.append(i)
        texts(texts_end)
        open_.pop()
        began.discard(i)
        if page.tags[i] not in VOID:
            out.append(f"</{page.tags[i]}>")

    i = first
    while i <= last and size <= cap:
        while open_ and page.end[open_[-1]] < i:
            closed()
        texts(page.places[i][0])
        if open_:
            began.add(open_[-1])
        if page.tags[i] in DROPPED:
            piece, skip_to = page.places[i][1], int(page.end[i]) + 1
            i = skip_to
            continue
        attrs = "".join(f' {k}="{entities.escape(page.attrs[i][k][:ATTR_CHARS])}"' for k in KEPT_ATTRS if k in page.attrs[i])
        out.append(f"<{page.tags[i]}{attrs}>")
        size += len(out[-1])
        open_.append(i)
        i += 1
    while open_:
        closed()
    text = "".join(out)
    return text if len(text) <= cap else text[:cap] + TRUNCATED


def hit_regions(page: Page, samples: list[str], shape: str) -> list[int]:
    """Elements LEVELS above those whose first text holds an old sample or begins with the shape, in order, the first REGIONS."""
    try:
        like = re.compile(shape) if shape else None
    except re.error:
        like = None
    known = [s for s in samples if s]
    first_child: dict[int, int] = {}
    for i, p in enumerate(page.up):
        first_child.setdefault(p, page.places[i][0])
    out: list[int] = []
    for i in range(len(page.tags)):
        a, b = page.places[i][0], min(first_child.get(i, page.places[i][1]), page.places[i][1])
        text = " ".join(page.pieces[a:b])
        if text and len(text) <= HIT_CHARS and page.tags[i] not in DROPPED and (any(s in text for s in known) or (like and like.match(text))):
            for _ in range(LEVELS):
                i = page.up[i] if page.up[i] >= 0 else i
            if i not in out:
                out.append(i)
            if len(out) == REGIONS:
                break
    return out


def region_html(html: str | None, samples: list[str], shape: str, cap: int = REGION_CAP) -> str:
    """The regions around old values, each with its share of ``cap``; the whole page where none is found."""
    page = Page(html or "")
    hits = hit_regions(page, samples, shape)
    return BETWEEN.join(pruned(page, i, cap // len(hits)) for i in hits)[:cap] if hits else pruned(page, None, cap)


def page_regions(pages: DataFrame, cap: int = REGION_CAP) -> DataFrame:
    """page_id and region of each page, by its own ``samples`` and ``shape`` (nulls: none).  Pages: page_id, html, samples, shape."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, *rest = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([region_html(h, s or [], x or "", cap) for h, s, x in zip(*rest)], pa.string())], ["page_id", "region"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"), "samples", "shape").mapInArrow(found, "page_id long, region string")
