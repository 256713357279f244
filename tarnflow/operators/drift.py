"""Drift signals, acceptance gates and the rules that follow from them, as Column expressions over statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.shapes import robustness


@dataclass(frozen=True)
class Thresholds:
    cardinality_low: float = 0.5
    cardinality_high: float = 2.0
    shape_ratio: float = 0.70
    null_rate_factor: float = 3.0
    schema_fail_ratio: float = 0.20
    similarity: float = 0.5


def _percent(x: Column) -> Column:
    return F.concat(F.format_number(F.bround(x * 100, 0), 0), F.lit("%"))


def drift_causes(t: Thresholds = Thresholds()) -> Column:
    """Array of causes, from the columns items, match_count, null_count, cast_fail, shape_ratio, similarity, min_items, nullable, loose, match_count_ema and null_rate_ema."""
    c = F.col
    n = F.greatest(c("items"), F.lit(1))
    gone = (c("match_count") == 0) & (F.coalesce(c("match_count_ema"), F.lit(0)) > 0.5) & (~c("nullable") | (F.coalesce(c("null_rate_ema"), F.lit(0)) < 0.5))
    ratio = c("match_count") / c("match_count_ema")
    low, high = F.when(c("loose"), t.cardinality_low / 2).otherwise(t.cardinality_low), F.when(c("loose"), t.cardinality_high * 2).otherwise(t.cardinality_high)
    null_rate = c("null_count") / n
    rules = [
        (c("cast_fail") / n > t.schema_fail_ratio, F.concat(F.lit("schema-fail "), c("cast_fail").cast("string"), F.lit("/"), n.cast("string"))),
        ((c("match_count_ema") >= 1) & ((ratio < low) | (ratio > high)), F.concat(F.lit("cardinality "), F.format_string("%.1f", ratio), F.lit("x baseline"))),
        (c("items") < c("min_items"), F.concat(F.lit("items "), c("items").cast("string"), F.lit(" < min_items "), c("min_items").cast("string"))),
        (~c("loose") & (c("shape_ratio") < t.shape_ratio), F.concat(F.lit("shape "), _percent(c("shape_ratio")), F.lit(" match"))),
        (c("null_rate_ema").isNotNull() & (null_rate > 0.2) & (null_rate > t.null_rate_factor * F.greatest(c("null_rate_ema"), F.lit(0.02))), F.concat(F.lit("null-rate "), _percent(null_rate))),
        (~c("loose") & (c("similarity") < t.similarity), F.concat(F.lit("fingerprint "), F.format_number(c("similarity"), 2), F.lit(" sim"))),
    ]
    rest = F.filter(F.array(*[F.when(test, text) for test, text in rules]), lambda x: x.isNotNull())
    return F.when(gone, F.array(F.lit("zero-match"))).otherwise(rest)


def drifted(stats: DataFrame, locks: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Fields with a cause: statistics joined with the stored state of (source, field)."""
    return stats.join(locks, ["source", "field"]).withColumn("causes", drift_causes(t)).where(F.size("causes") > 0)


def gate_verdicts(probes: DataFrame) -> DataFrame:
    """Adds the gates schema, cardinality, shape, anchor (null: does not apply), robust and ``passed``.

    Columns: css, cast_fail, scopes, matched_scopes, min_items, nullable,
    match_count_ema, old_shape_ratio and new_shape_ratio (null without values or
    stored shape), samples, raws, page_text.
    """
    c = F.col
    ratio = c("matched_scopes") / c("match_count_ema")
    near = (ratio >= 0.5) & (ratio <= 2.0) & (c("matched_scopes") >= F.least(c("min_items"), F.greatest(c("scopes"), F.lit(1))))
    plain = lambda x: F.substring(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), 1, 80)
    there = F.filter(F.transform("samples", plain), lambda s: (s != "") & F.regexp_replace(c("page_text"), r"(?U)\s+", " ").contains(s))
    out = probes.withColumns(
        {
            "schema": c("cast_fail") == 0,
            "cardinality": F.when(c("match_count_ema") >= 1, near).otherwise((c("matched_scopes") > 0) | c("nullable")),
            "shape": F.coalesce((c("old_shape_ratio") >= 0.7) | (c("new_shape_ratio") >= 0.9), F.lit(True)),
            "anchor": F.when(F.size(there) > 0, F.arrays_overlap(there, F.transform("raws", plain))),
            "robust": robustness(c("css")) >= 0.3,
        }
    )
    return out.withColumn("passed", c("schema") & c("cardinality") & c("shape") & F.coalesce(c("anchor"), F.lit(True)) & c("robust"))


def free_selectors(candidates: DataFrame, locks: DataFrame) -> DataFrame:
    """Candidates whose (css, attr) no other field of the source uses.

    Locks come down to the least and the greatest field of each selector: a third
    one differs from at least one of them, so no pairs of fields are formed.
    """
    users = locks.groupBy("source", "css", "attr").agg(F.min("field").alias("_first"), F.max("field").alias("_last"))
    other = (F.col("_first") != F.col("field")) | (F.col("_last") != F.col("field"))
    return candidates.join(users, ["source", "css", "attr"], "left").where(~F.coalesce(other, F.lit(False))).select(*candidates.columns)
