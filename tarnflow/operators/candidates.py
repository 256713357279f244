"""Candidate selectors for items and fields, counted and ranked over the node table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.casts import cast_column, cast_failed
from tarnflow.functions.types import FieldType
from tarnflow.operators.extraction import scoped
from tarnflow.operators.shapes import robustness

# Words that say nothing about a field; scopes, lengths and numbers that bound the search.
STOP = ("the", "a", "an", "of", "each", "every", "to", "it", "that", "this", "points", "number", "count", "text", "link", "value")
SCOPES, MAX_ITEMS, MAX_FIELDS, MAX_TEXT, SHORT_TEXT = 8, 8, 12, 200, 60


def keywords(description: str, name: str) -> list[str]:
    words = set(re.findall(r"[a-z]+", f"{description} {name}".lower())) - set(STOP)
    return sorted(words | {name.lower()})


def item_candidates(nodes: DataFrame, min_items: int = 3) -> DataFrame:
    """page_id, css, n, mean_depth, robust, rank: repeated tag.class containers of each page, the best MAX_ITEMS."""
    own = F.element_at("path", -1)
    each = nodes.where("n_children > 0").select("page_id", "depth", own["tag"].alias("tag"), F.explode(own["classes"]).alias("cls"))
    found = each.groupBy("page_id", F.concat_ws(".", "tag", "cls").alias("css")).agg(F.count(F.lit(1)).alias("n"), F.avg("depth").alias("mean_depth")).withColumn("robust", robustness(F.col("css")))
    best = Window.partitionBy("page_id").orderBy(F.col("n").desc(), "mean_depth", F.col("robust").desc(), "css")
    return found.where((F.col("n") >= max(min_items, 3)) & (F.col("robust") >= 0.3)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= MAX_ITEMS)


def _spellings(path: Column) -> Column:
    """Selectors that reach a node: by class, id, parent's class, bare tag and parent > tag."""
    own, parent = F.element_at(path, -1), F.try_element_at(path, F.lit(-2))
    by_class = F.flatten(F.transform(own["classes"], lambda c: F.array(F.concat(F.lit("."), c), F.concat(own["tag"], F.lit("."), c))))
    none = F.array().cast("array<string>")
    by_id = F.when(own["id"] != "", F.array(F.concat(F.lit("#"), own["id"]))).otherwise(none)
    above = F.coalesce(F.slice(parent["classes"], 1, 2), none)
    qualified = F.transform(above, lambda p: F.concat(F.lit("."), p, F.lit(" "), F.when(F.size(own["classes"]) > 0, F.concat(F.lit("."), F.try_element_at(own["classes"], F.lit(1)))).otherwise(own["tag"])))
    bare = F.when((F.size(own["classes"]) == 0) & parent.isNotNull(), F.array(own["tag"], F.concat(parent["tag"], F.lit(" > "), own["tag"]))).otherwise(none)
    return F.array_distinct(F.concat(by_class, F.coalesce(by_id, none), qualified, bare))


def field_candidates(nodes: DataFrame, item: str | None, ft: FieldType, description: str, name: str, base: Column | None = None, shape: str | None = None, samples: list[str] = (), old_classes: list[str] = ()) -> DataFrame:
    """page_id, css, attr, coverage, score, rank: ranked selectors of a field over each page's first SCOPES items."""
    rows = scoped(nodes, item)
    order = Window.partitionBy("page_id").orderBy("item")
    rows = rows.withColumn("_nth", F.dense_rank().over(order)).where(F.col("_nth") <= SCOPES)
    leaf, text = F.col("n_children") == 0, F.substring("text", 1, MAX_TEXT)
    small = (F.col("n_children") <= 2) & ((F.length(text) <= SHORT_TEXT) | F.lit(ft.base == "str"))
    values = [F.when((text != "") & (leaf | small), F.struct(F.lit("text").alias("attr"), text.alias("raw")))]
    if ft.base == "url":
        href = F.element_at("inner", -1)["attrs"]["href"]
        values.insert(0, F.when(href != "", F.struct(F.lit("href").alias("attr"), href.alias("raw"))))
    rows = rows.select("page_id", "item", "ix", leaf.alias("leaf"), F.explode(F.filter(F.array(*values), lambda x: x.isNotNull())).alias("v"), _spellings(F.col("path")).alias("spellings"))
    rows = rows.select("page_id", "item", "ix", "leaf", "v.attr", "v.raw", "spellings")
    fits = F.lit(True) if ft.is_list else ~cast_failed(F.col("raw"), cast_column(F.col("raw"), ft, base), ft)
    each = rows.withColumn("_fits", fits).where("_fits").withColumn("css", F.explode("spellings"))
    first = each.groupBy("page_id", "css", "attr", "item").agg(F.min_by(F.struct("raw", "leaf"), "ix").alias("x"), F.min("ix").alias("ix"))
    n = rows.groupBy("page_id").agg(F.countDistinct("item").alias("n"))
    known = list(samples)
    stats = first.groupBy("page_id", "css", "attr").agg(
        F.count(F.lit(1)).alias("cover"),
        F.avg(F.when(F.col("x.leaf") | (F.col("attr") != "text"), 1.0).otherwise(0.0)).alias("leaf"),
        F.min("ix").alias("ix"),
        F.avg(F.regexp_like("x.raw", F.lit(f"(?U){shape}")).cast("double") if shape else F.lit(None).cast("double")).alias("shaped"),
        F.max(F.col("x.raw").isin(known) if known else F.lit(False)).alias("anchored"),
    )
    words = F.array_distinct(F.regexp_extract_all(F.lower("css"), F.lit("[a-z]+"), 0))
    shared = lambda other: F.size(F.array_intersect(words, F.array(*map(F.lit, other)))) if other else F.lit(0)
    coverage = F.col("cover") / F.col("n")
    score = 2 * coverage + robustness(F.col("css")) - 0.02 * F.length("css") + 0.6 * F.col("leaf") + 0.8 * shared(keywords(description, name)) + 1.5 * F.coalesce("shaped", F.lit(0.0)) + F.when(F.col("anchored"), 2.0).otherwise(0.0) + 0.5 * shared(list(old_classes))
    scored = stats.join(n, "page_id").withColumn("coverage", coverage).where(F.col("coverage") >= (0.3 if ft.nullable else 0.6)).withColumn("score", score)
    best = Window.partitionBy("page_id", "css").orderBy(F.col("score").desc(), "ix", "attr")
    ranked = Window.partitionBy("page_id").orderBy(F.col("score").desc(), "ix", "css")
    return scored.withColumn("_b", F.row_number().over(best)).where("_b = 1").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= MAX_FIELDS).select("page_id", "css", "attr", "coverage", "score", "rank")
