"""The repair ladder and the state of fields, over tables of candidates and locks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.shapes import ALPHA

VERIFIED, UNCONFIRMED, BROKEN = "verified", "healed-unconfirmed", "broken"
CONFIRM_RUNS, KEPT_FALLBACKS = 2, 3
#: Candidates of a field on each rung: stored fallbacks, ranked ones, proposals.
RUNG_LIMITS = {1: 3, 2: 6, 3: 3}


def choose(candidates: DataFrame, locks: DataFrame) -> DataFrame:
    """(source, field, css, attr, rung): for each drifted field the first passing candidate of the lowest rung.

    ``candidates``: source, field, field_order, rung, rank, css, attr, passed.
    Fields of a source are served in their declared order; a selector that
    another field of the source holds, or was given before, is not given again.
    A source's candidates are few (the rungs have limits), so they fit one row.
    """
    within = F.create_map(*[F.lit(x) for kv in RUNG_LIMITS.items() for x in kv])[F.col("rung")]
    able = candidates.where(F.col("passed") & (F.col("rank") <= within))
    rows = able.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("field_order", "rung", "rank", "field", "css", "attr"))).alias("all"))
    held = locks.groupBy("source").agg(F.collect_list(F.struct("field", "css", "attr")).alias("held"))
    kind = "array<struct<field_order:int,rung:int,rank:int,field:string,css:string,attr:string>>"
    same = lambda a, b: (a["css"] == b["css"]) & (a["attr"] == b["attr"])

    def step(given: Column, one: Column) -> Column:
        taken = F.exists(given, lambda g: (g["field"] == one["field"]) | same(g, one)) | F.exists("held", lambda h: same(h, one) & (h["field"] != one["field"]))
        return F.when(taken, given).otherwise(F.concat(given, F.array(one)))

    rows = rows.join(held, "source", "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<field:string,css:string,attr:string>>")))
    cast = F.col("all").cast(kind)
    return rows.select("source", F.explode(F.aggregate(cast, F.array().cast(kind), step)).alias("x")).select("source", "x.field", "x.css", "x.attr", "x.rung")


def healed_locks(locks: DataFrame, drifted: DataFrame, chosen: DataFrame) -> DataFrame:
    """Locks after a run.

    A drifted field with a choice takes it: its old selector is the first
    fallback, two others stay, and it waits for confirmation; if it did so
    already it is broken (the new selector stays).  Without a choice it is
    broken.  A field that did not drift is confirmed run by run; broken ones
    stay broken.
    """
    new = chosen.select("source", "field", F.col("css").alias("_css"), F.col("attr").alias("_attr"))
    bad = drifted.select("source", "field", F.lit(True).alias("_bad"))
    out = locks.join(bad, ["source", "field"], "left").join(new, ["source", "field"], "left")
    healed, is_bad = F.col("_css").isNotNull(), F.coalesce("_bad", F.lit(False))
    waits, old = F.col("status") == UNCONFIRMED, F.struct("css", "attr")
    runs = F.when(healed, 0).when(~is_bad & waits, F.col("confirm_runs") + 1).otherwise(F.col("confirm_runs"))
    status = F.when(healed & waits, BROKEN).when(healed, UNCONFIRMED).when(is_bad, BROKEN).when(waits & (runs >= CONFIRM_RUNS), VERIFIED).otherwise(F.col("status"))
    others = F.filter("fallbacks", lambda f: (f["css"] != F.col("_css")) | (f["attr"] != F.col("_attr")))
    values = {
        "fallbacks": F.when(healed, F.slice(F.concat(F.array(old), others), 1, KEPT_FALLBACKS)).otherwise(F.col("fallbacks")),
        "css": F.coalesce("_css", "css"),
        "attr": F.coalesce("_attr", "attr"),
        "status": status,
        "confirm_runs": runs.cast("int"),
        "heal_count": (F.col("heal_count") + healed.cast("int")).cast("int"),
    }
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in locks.columns])


def updated_statistics(locks: DataFrame, stats: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Moving averages of match count, null rate and length after a run; the first value starts each."""
    now = stats.select("source", "field", F.col("match_count").cast("double").alias("_m"), (F.col("null_count") / F.greatest("items", F.lit(1))).alias("_n"), F.col("len_mean").alias("_l"))
    step = lambda old, new: F.coalesce(alpha * F.col(new) + (1 - alpha) * F.col(old), new, old)
    values = {"match_count_ema": step("match_count_ema", "_m"), "null_rate_ema": step("null_rate_ema", "_n"), "len_mean": step("len_mean", "_l")}
    return locks.join(now, ["source", "field"], "left").select(*[values.get(c, F.col(c)).alias(c) for c in locks.columns])


def verify_absent(page_text: Column, samples: Column, shape: Column, match_count_ema: Column) -> Column:
    """Whether a claim that a field is gone holds: no old sample on the page and few pieces of its shape."""
    there = F.exists(samples, lambda s: (s != "") & page_text.contains(s))
    hits = F.size(F.filter(F.split(page_text, "  "), lambda x: F.regexp_like(F.substring(F.trim(x), 1, 120), F.concat(F.lit("(?U)"), shape))))
    return ~there & F.coalesce(hits <= F.greatest(F.lit(2.0), 0.3 * F.coalesce(match_count_ema, F.lit(0.0))), F.lit(True))


def run_status(any_broken_required: Column, any_healed: Column, blocked: Column) -> Column:
    return F.when(blocked, "blocked").when(any_broken_required, "stale").when(any_healed, "healed").otherwise("ok")
