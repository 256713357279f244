"""Selectors tried on a node table, all in one pass, and fingerprints of what they match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.casts import cast_column, cast_failed
from tarnflow.functions.types import FieldType
from tarnflow.operators import shapes
from tarnflow.operators.extraction import Selector, _hit, extract_pages, extract_raw, node_value, scoped

#: Nodes of an item, nodes in all, values for the shape and stored samples with their length.
PER_ITEM, NODES_SEEN, SHAPE_VALUES, SAMPLES, SAMPLE_CHARS = 2, 50, 20, 3, 80
#: Classes and ancestors of a fingerprint.
CLASSES, ANCESTORS = 5, 3
FINGERPRINT = "tag string, class_tokens array<string>, ancestor_sig string, value_shape string, match_count_ema double, null_rate_ema double, len_mean double, samples array<string>"
Fields = dict[str, tuple[FieldType, Selector]]


def node_signature(path: Column) -> Column:
    """(tag, classes, ancestors) of a node: its sorted classes, and the nearest ancestors as ``td.subtext<tr<table``."""
    own, depth = F.element_at(path, -1), F.size(path)
    above = F.reverse(F.slice(path, F.greatest(depth - ANCESTORS, F.lit(1)), F.least(depth - 1, F.lit(ANCESTORS))))
    named = F.transform(above, lambda p: F.concat_ws(".", p["tag"], F.array_min(p["classes"])))
    return F.struct(own["tag"].alias("tag"), F.array_sort(own["classes"]).alias("classes"), F.array_join(named, "<").alias("ancestors"))


def matched_nodes(nodes: DataFrame, item: str | None, fields: Fields) -> DataFrame:
    """page_id, item, field, ix, nth, raw and sig of the first PER_ITEM nodes of each item that each selector hits."""
    rows = scoped(nodes, item)
    hits = [F.when(_hit(s), F.struct(F.lit(name).alias("field"), node_value(F.col("inner"), F.col("text"), s).alias("raw"))) for name, (_, s) in fields.items()]
    found = rows.select("page_id", "item", "ix", node_signature(F.col("path")).alias("sig"), F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("x"))
    order = Window.partitionBy("page_id", "item", "x.field").orderBy("ix")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= PER_ITEM).select("page_id", "item", "x.field", "ix", "nth", "x.raw", "sig")


def _first_of(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each key; planned as a limit by group, so little of a hot key is shuffled."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("seq") <= most)


def fingerprints(nodes: DataFrame, item: str | None, fields: Fields) -> DataFrame:
    """One row for each field: ``field`` and FINGERPRINT.

    Signatures are of the first NODES_SEEN nodes, the most frequent of each (of
    equals the one seen first).  A shape is kept only if it fits 70 % of the
    values it was learned from.  Counts are means of a page.  A field that
    matches nothing has empty signatures.
    """
    place = ["page_id", "item", "ix"]
    seen = _first_of(matched_nodes(nodes, item, fields), "field", place, NODES_SEEN)
    tags = shapes.most_frequent(seen.withColumn("v", F.col("sig.tag")), ["field"], "v", "seq", "tag")
    sigs = shapes.most_frequent(seen.withColumn("v", F.col("sig.ancestors")), ["field"], "v", "seq", "ancestor_sig")
    each = seen.select("field", "seq", F.posexplode("sig.classes").alias("nth", "class")).groupBy("field", "class").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "nth")).alias("first"))
    classes = each.groupBy("field").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "class"))).alias("c")).select("field", F.transform(F.slice("c", 1, CLASSES), lambda x: x["class"]).alias("class_tokens"))

    values = item_values(nodes, item, fields)
    some = _first_of(values.where("raw <> ''"), "field", ["page_id", "item"], SHAPE_VALUES).withColumn("v", shapes.value_shape(F.trim("raw")))
    shape = shapes.most_frequent(some, ["field"], "v", "seq", "shape")
    fits = some.join(shape, "field").groupBy("field").agg(F.first("shape").alias("shape"), F.avg((F.col("v") == F.col("shape")).cast("double")).alias("same"), shapes.shape_ratio(F.trim(F.substring("raw", 1, shapes.SHAPE_CHARS)), F.col("shape")).alias("ratio"))
    samples = some.where(F.col("seq") <= SAMPLES).groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.substring("raw", 1, SAMPLE_CHARS).alias("v")))), lambda x: x["v"]).alias("samples"))
    pages = F.greatest(F.countDistinct("page_id"), F.lit(1))
    numbers = values.groupBy("field").agg((F.count("raw") / pages).alias("match_count_ema"), F.avg(F.col("raw").isNull().cast("double")).alias("null_rate_ema"), F.avg(F.when(F.col("raw") != "", F.length("raw"))).alias("len_mean"))
    out = nodes.sparkSession.createDataFrame([(n,) for n in fields], "field string")
    for part in (tags, sigs, classes, fits, samples, numbers):  # one row for each field
        out = out.join(F.broadcast(part), "field", "left")
    none = F.array().cast("array<string>")
    return out.select("field", F.coalesce("tag", F.lit("")).alias("tag"), F.coalesce("class_tokens", none).alias("class_tokens"), F.coalesce("ancestor_sig", F.lit("")).alias("ancestor_sig"), F.when(F.col("ratio") >= 0.7, F.col("shape")).otherwise("").alias("value_shape"), F.coalesce("match_count_ema", F.lit(0.0)).alias("match_count_ema"), F.coalesce("null_rate_ema", F.lit(0.0)).alias("null_rate_ema"), "len_mean", F.coalesce("samples", none).alias("samples"))


def item_values(nodes: DataFrame, item: str | None, fields: Fields) -> DataFrame:
    """page_id, item, field and raw, the first value of a field in each item (null where it has none)."""
    raw = extract_raw(nodes, item, fields)
    first = [F.struct(F.lit(n).alias("field"), (F.try_element_at(F.col(n), F.lit(1)) if ft.is_list else F.col(n)).alias("raw")) for n, (ft, _) in fields.items()]
    return raw.select("page_id", "item", F.explode(F.array(*first)).alias("x")).select("page_id", "item", "x.*")


def probe(nodes: DataFrame, item: str | None, tries: Fields, base: Column | None = None) -> DataFrame:
    """What each selector does, one row for each key of ``tries``.

    field, scopes, matched_scopes, cast_ok, cast_fail (a blank value where one is
    required counts), raws (the first NODES_SEEN values).  All selectors are
    tried in one pass over the nodes, and any number of pages counts together.
    ``nodes`` may also be pages (page_id, html); then selectors are full CSS.
    """
    raw = extract_pages(nodes, item, tries) if "html" in nodes.columns else extract_raw(nodes, item, tries)
    each = []
    for n, (ft, _) in tries.items():
        col = F.col(n)
        value = F.try_element_at(col, F.lit(1)) if ft.is_list else col
        failed = cast_failed(col, cast_column(col, ft, base), ft)
        each.append(F.struct(F.lit(n).alias("field"), value.alias("raw"), failed.alias("failed")))
    rows = raw.select("page_id", "item", F.explode(F.array(*each)).alias("x")).select("page_id", "item", "x.*")
    counts = rows.groupBy("field").agg(F.count(F.lit(1)).alias("scopes"), F.count("raw").alias("matched_scopes"), F.count(F.when(~F.col("failed"), 1)).alias("cast_ok"), F.count(F.when(F.col("failed"), 1)).alias("cast_fail"))
    some = _first_of(rows.where("raw IS NOT NULL"), "field", ["page_id", "item"], NODES_SEEN)
    raws = some.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "raw"))), lambda x: x["raw"]).alias("raws"))
    return counts.join(F.broadcast(raws), "field", "left").withColumn("raws", F.coalesce("raws", F.array().cast("array<string>")))


def passes(nullable: Column) -> Column:
    """The rule for a compiled selector, over the columns of :func:`probe`."""
    share = F.col("matched_scopes") / F.greatest("scopes", F.lit(1))
    return (F.col("matched_scopes") > 0) & (F.col("cast_fail") == 0) & (share >= F.when(nullable, 0.4).otherwise(0.75))
