"""Items of pages: scopes, raw values of fields, casts and statistics, in one pass over the nodes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.casts import cast_column, cast_failed
from tarnflow.functions.types import FieldType
from tarnflow.operators.elements import extract_with
from tarnflow.operators.nodes import SelectorError, matches, match_positions


@dataclass(frozen=True)
class Selector:
    """Where a field's raw value stands: a CSS selector within the item, an attribute or ``text``, and post-steps."""

    css: str
    attr: str = "text"
    post: tuple[str, ...] = field(default=())


def post_steps(raw: Column, steps: tuple[str, ...]) -> Column:
    """``strip`` and ``regex:PATTERN`` (its first group, else the whole match, else null), one after the other."""
    for step in steps:
        if step == "strip":
            raw = F.trim(raw)
        elif step.startswith("regex:"):
            pattern = step.removeprefix("regex:")
            group = 1 if "(" in pattern.replace("\\(", "").replace("(?", "") else 0
            raw = F.when(F.regexp_like(raw, F.lit(pattern)), F.regexp_extract(raw, pattern, group))
    return raw


def node_value(path: Column, text: Column, selector: Selector) -> Column:
    """Text or attribute of a node; empty is null."""
    raw = text if selector.attr == "text" else F.trim(F.element_at(path, -1)["attrs"][selector.attr])
    return post_steps(F.nullif(raw, F.lit("")), selector.post)


def scoped(nodes: DataFrame, item: str | None) -> DataFrame:
    """Each node once for every item it lies in (itself counts), with ``item`` (the scope's ix) and ``inner``, the path from there.

    Without an item selector a page is one item; a selector that is not understood gives none.
    """
    if item is None:
        return nodes.withColumn("item", F.lit(0)).withColumn("inner", F.col("path"))
    try:
        places = match_positions(F.col("path"), item)
    except SelectorError:
        return nodes.withColumn("item", F.lit(0)).withColumn("inner", F.col("path")).where(F.lit(False))
    at = nodes.withColumn("_at", F.explode(places))
    return at.withColumn("item", F.col("path")[F.col("_at") - 1]["ix"]).withColumn("inner", F.slice("path", F.col("_at"), F.size("path"))).drop("_at")


def _hit(selector: Selector) -> Column:
    try:
        return matches(F.col("inner"), selector.css)
    except SelectorError:
        return F.lit(False)


def extract_raw(nodes: DataFrame, item: str | None, fields: dict[str, tuple[FieldType, Selector]]) -> DataFrame:
    """page_id, item and of each field ``f`` its raw value(s) and ``f__nodes``, the number of nodes.

    A scalar takes the first node; a list all non-empty ones.  Items without any
    value are rows too.
    """
    rows = scoped(nodes, item)
    aggs = []
    for name, (ft, selector) in fields.items():
        hit, value = _hit(selector), node_value(F.col("inner"), F.col("text"), selector)
        if ft.is_list:
            got = F.transform(F.array_sort(F.collect_list(F.when(hit & value.isNotNull(), F.struct("ix", value.alias("v"))))), lambda x: x["v"])
        else:
            got = F.min_by(F.struct(value.alias("v")), F.when(hit, F.col("ix")))["v"]
        aggs += [got.alias(name), F.count(F.when(hit, 1)).alias(f"{name}__nodes")]
    return rows.groupBy("page_id", "item").agg(*aggs)


def extract_pages(pages: DataFrame, item: str | None, fields: dict[str, tuple[FieldType, Selector]]) -> DataFrame:
    """As :func:`extract_raw`, from pages (page_id, html) that are parsed once: with full CSS, and linear in a page's length however deep it is.

    ``f__sig`` is besides the signature (tag, classes, ancestors) of a field's first node.
    """
    rules = [(n, s.css, s.attr, list(s.post), ft.is_list) for n, (ft, s) in fields.items()]
    found, aggs = extract_with(pages, item, rules), []
    for name, (ft, _) in fields.items():
        own = F.first(F.when(F.col("field") == name, F.struct("raws", "n_nodes", F.when(F.col("tag").isNotNull(), F.struct("tag", "classes", "ancestors")).alias("sig"))), True)
        value = own["raws"] if ft.is_list else F.try_element_at(own["raws"], F.lit(1))
        aggs += [value.alias(name), own["n_nodes"].cast("long").alias(f"{name}__nodes"), own["sig"].alias(f"{name}__sig")]
    return found.groupBy("page_id", "item").agg(*aggs)


def cast_items(raw: DataFrame, fields: dict[str, FieldType], base: Column | None = None) -> DataFrame:
    """page_id, item and the fields cast to their types; what does not fit is null."""
    return raw.select("page_id", "item", *[cast_column(F.col(n), ft, base).alias(n) for n, ft in fields.items()])


def extract(nodes: DataFrame, item: str | None, fields: dict[str, tuple[FieldType, Selector]], base: Column | None = None) -> DataFrame:
    return cast_items(extract_raw(nodes, item, fields), {n: ft for n, (ft, _) in fields.items()}, base)


def field_statistics(raw: DataFrame, fields: dict[str, FieldType], base: Column | None = None) -> DataFrame:
    """field, items, match_count (nodes), null_count, cast_fail, len_mean: one row for each field."""
    aggs = []
    for name, ft in fields.items():
        col = F.col(name)
        empty = F.size(col) == 0 if ft.is_list else col.isNull()
        failed = cast_failed(col, cast_column(col, ft, base), ft)  # a blank value where one is required counts
        length = F.length(F.array_join(col, "")) if ft.is_list else F.length(col)
        aggs.append(F.struct(F.lit(name).alias("field"), F.count(F.lit(1)).alias("items"), F.sum(f"{name}__nodes").alias("match_count"), F.count(F.when(empty, 1)).alias("null_count"), F.count(F.when(failed, 1)).alias("cast_fail"), F.avg(length).alias("len_mean")))
    return raw.agg(F.array(*aggs).alias("s")).select(F.explode("s").alias("s")).select("s.*")
