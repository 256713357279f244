"""One run of any number of sources in one set of jobs.

Selectors, declared types and stored state are rows, joined by source and field;
what each source's pages give is long: a row for each field of each item.  Pages
are judged, extracted, cast and compared with the stored statistics for all sources
at once.  Sources whose fields drifted are few in any run; they alone are repaired
one by one, by :func:`tarnflow.plans.runs.run_source`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions.casts import collapsed, resolve_url, to_bool, to_datetime, to_float, to_int
from tarnflow.operators import drift, shapes
from tarnflow.operators.elements import extract_rules
from tarnflow.plans import heal, runs
from tarnflow.plans.compiling import SourceSpec
from tarnflow.sources import pages as page_source
from tarnflow.sources.state import sources_with_last_good

FIELDS = "source string, field string, field_order int, base string, nullable boolean, is_list boolean, members array<string>, manual boolean, post array<string>, min_items int, loose boolean, origin_host string"
STATE = "source string, item string, content_len double"


def field_rows(spark: SparkSession, specs: Iterable[SourceSpec], origin_hosts: dict[str, str] | None = None) -> DataFrame:
    """The declared fields of sources as rows (FIELDS)."""
    hosts = origin_hosts or {}
    rows = [(s.name, n, k, f.ft.base, f.ft.nullable, f.ft.is_list, list(f.ft.members), f.selector is not None, list(f.selector.post) if f.selector else [], s.min_items, s.loose, hosts.get(s.name)) for s in specs for k, (n, f) in enumerate(s.fields.items())]
    return spark.createDataFrame(rows, FIELDS)


def cast_value(raw: Column, base: Column, members: Column, url: Column) -> Column:
    """The value of raw text as text, by a type that is data; null where it is blank or does not fit."""
    member = F.try_element_at(F.filter(members, lambda m: F.lower(m) == F.lower(collapsed(raw))), F.lit(1))
    return (
        F.when(base == "int", to_int(raw).cast("string"))
        .when(base == "float", to_float(raw).cast("string"))
        .when(base == "bool", to_bool(raw).cast("string"))
        .when(base == "datetime", to_datetime(raw))
        .when(base == "enum", member)
        .when(base == "url", resolve_url(F.when(base == "url", raw), url))
        .otherwise(F.nullif(collapsed(raw), F.lit("")))
    )


@dataclass
class Runs:
    """``sources``: source, status, exit_code, error, n_pages, content_len; ``items``: source, page_id, item, field, value, values (of lists); ``causes``: source, field, causes; ``locks``: as :data:`state.LOCKS`; ``repaired``: runs of sources that drifted."""

    sources: DataFrame
    items: DataFrame
    causes: DataFrame
    locks: DataFrame
    repaired: dict[str, runs.Run] = field(default_factory=dict)

    def worst(self, stale_ok: bool = False) -> int:
        """The highest exit code; with ``stale_ok`` sources that serve their last good items do not count."""
        some = self.sources.where("status <> 'stale'") if stale_ok else self.sources
        return some.agg(F.max("exit_code")).first()[0] or 0


def typed_items(done: Runs, spec: SourceSpec) -> DataFrame:
    """The items of one source with a column of its type for each field."""
    if spec.name in done.repaired and done.repaired[spec.name].items is not None:
        return done.repaired[spec.name].items.drop("source")
    kinds = {"int": "long", "float": "double", "bool": "boolean"}
    cols = [(F.first(F.when(F.col("field") == n, F.col("values")), True) if f.ft.is_list else F.first(F.when(F.col("field") == n, F.col("value")), True).cast(kinds.get(f.ft.base, "string"))).alias(n) for n, f in spec.fields.items()]
    return done.items.where(F.col("source") == spec.name).groupBy("page_id", "item").agg(*cols)


def judged(pages: DataFrame, fields: DataFrame, states: DataFrame) -> DataFrame:
    """The pages of the declared sources with ``reason``, why a page is no genuine answer (null: it is)."""
    hosts = fields.groupBy("source").agg(F.first("origin_host", True).alias("origin_host"))
    known = pages.join(hosts, "source").join(states, "source", "left")
    host = F.coalesce("origin_host", F.try_parse_url("url", F.lit("AUTHORITY")))
    return known.select("source", F.col("page_id").cast("long").alias("page_id"), "url", "html", page_source.block_reason(F.col("status"), F.col("html"), F.col("url"), host, F.col("content_len")).alias("reason"))


def statistics(rows: DataFrame) -> DataFrame:
    """source, field, items, match_count, null_count, cast_fail, len_mean, shape_ratio and similarity, over rows of found values with their locks."""
    raw = F.try_element_at("raws", F.lit(1))
    empty = F.when(F.col("is_list"), F.size("raws") == 0).otherwise(raw.isNull())
    length = F.when(F.col("is_list"), F.length(F.array_join("raws", ""))).otherwise(F.length(raw))
    first = F.min_by(F.struct("tag", "classes", "ancestors"), F.when(F.col("tag").isNotNull(), F.struct("page_id", "item")))
    stats = rows.groupBy("source", "field").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("n_nodes").alias("match_count"),
        F.count(F.when(empty, 1)).alias("null_count"),
        F.count(F.when(F.col("failed"), 1)).alias("cast_fail"),
        F.avg(length).alias("len_mean"),
        shapes.shape_ratio(F.trim(F.substring(raw, 1, shapes.SHAPE_CHARS)), F.nullif(F.col("value_shape"), F.lit(""))).alias("shape_ratio"),
        first.alias("sig"),
    )
    return stats


def run_all(spark: SparkSession, specs: list[SourceSpec] | DataFrame, locks: DataFrame, states: DataFrame, pages: DataFrame, good_path: str | None = None, heal_allowed: bool = True, complete: Callable[[str], str] | None = None, base: Column | None = None, origin_hosts: dict[str, str] | None = None, limits: drift.Thresholds = drift.Thresholds()) -> Runs:
    """Run all ``specs`` over ``pages`` (source, page_id, url, status, html).

    Sources are declared by specs, or by a table of fields (FIELDS) where there are
    too many for the driver; of a table nothing is repaired.
    ``locks``: compiled selectors (state.LOCKS); ``states``: item selector and mean
    page length of each source (STATE).  Addresses are resolved against the page's
    own unless ``base`` is given.  A source without locks or with no genuine page
    does not stop the others.  Outcomes are those of
    :func:`tarnflow.plans.runs.run_source` for each source.
    """
    fields = field_rows(spark, specs, origin_hosts) if isinstance(specs, list) else specs
    heal_allowed = heal_allowed and isinstance(specs, list)
    seen = runs.stored(judged(pages, fields, states.select("source", "content_len")))
    lengths = seen.groupBy("source").agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("n_pages"), F.sum(F.when(F.col("reason").isNull(), F.length("html"))).alias("chars"), F.count(F.lit(1)).alias("all_pages"))
    reasons = seen.where("reason IS NOT NULL").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.min_by("reason", F.struct((-F.col("n")).alias("n"), "reason")).alias("reason"))

    declared = fields.join(locks.drop("field_order"), ["source", "field"])
    rules = declared.join(states.select("source", "item"), "source", "left").select("source", "item", "field", "css", "attr", "post", "is_list")
    found = extract_rules(seen.where("reason IS NULL"), rules)
    raw = F.try_element_at("raws", F.lit(1))
    blank = F.coalesce(collapsed(raw), F.lit("")) == ""
    cast = found.join(declared.select("source", "field", "base", "nullable", "is_list", "members", "value_shape"), ["source", "field"])
    cast = cast.withColumn("value", F.when(~F.col("is_list"), cast_value(raw, F.col("base"), F.col("members"), F.col("url") if base is None else base)))
    cast = cast.withColumn("values", F.when(F.col("is_list"), F.filter(F.transform("raws", collapsed), lambda x: x != "")))
    cast = runs.stored(cast.withColumn("failed", ~F.col("is_list") & F.when(blank, ~F.col("nullable")).otherwise(F.col("value").isNull())))

    known = declared.drop("len_mean").join(lengths, "source").where("n_pages > 0").join(statistics(cast), ["source", "field"], "left")
    similar = shapes.node_similarity(F.col("sig.tag"), F.col("sig.classes"), F.col("sig.ancestors"), F.col("tag"), F.col("class_tokens"), F.col("ancestor_sig"))
    zero = F.lit(0).cast("long")
    stats = runs.stored(known.select(
        "source", "field", "nullable", "loose", "status", "match_count_ema", "null_rate_ema", "len_mean",
        F.coalesce("items", zero).alias("items"), (F.coalesce("match_count", zero) / F.col("n_pages")).alias("match_count"),
        F.coalesce("null_count", zero).alias("null_count"), F.coalesce("cast_fail", zero).alias("cast_fail"), F.coalesce("shape_ratio", F.lit(1.0)).alias("shape_ratio"), similar.alias("similarity"),
        (F.col("min_items") * F.col("n_pages")).alias("min_items"),
    ).withColumn("causes", drift.drift_causes(limits)))
    causes = stats.where(F.size("causes") > 0).select("source", "field", "causes")
    changed = causes.select("source").distinct()
    drifted = sorted(r.source for r in changed.collect()) if heal_allowed else []

    quiet = spark.createDataFrame([], "source string, field string")
    calm = locks.join(changed, "source", "left_anti").join(lengths.where("n_pages > 0").select("source"), "source", "left_semi").select(*locks.columns)
    after = heal.healed_locks(calm, quiet, quiet.withColumns({"css": F.lit(""), "attr": F.lit("")}))
    learned = heal.updated_statistics(after.where(F.col("status") != heal.BROKEN), stats)
    held = locks.join(lengths.where("n_pages > 0").select("source").join(changed, "source", "left_anti"), "source", "left_anti").select(*locks.columns)
    new_locks = learned.unionByName(after.where(F.col("status") == heal.BROKEN)).unionByName(held.where(~F.col("source").isin(drifted)))

    repaired: dict[str, runs.Run] = {}
    by_name = {s.name: s for s in specs} if heal_allowed else {}
    for name in drifted:
        own = [r.asDict(recursive=True) for r in locks.where(F.col("source") == name).orderBy("field_order").collect()]
        state = states.where(F.col("source") == name).first()
        some = pages.where(F.col("source") == name).drop("source")
        repaired[name] = runs.run_source(spark, by_name[name], state and state["item"], own, some, good_path, (origin_hosts or {}).get(name, ""), state and state["content_len"], complete=complete, base=base)
    if repaired:
        new_locks = new_locks.unionByName(spark.createDataFrame([r for run in repaired.values() for r in run.locks], locks.schema))

    broken = after.join(fields.select("source", "field", "nullable"), ["source", "field"]).where((F.col("status") == heal.BROKEN) & ~F.col("nullable")).groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("field")), ", ").alias("broken"))
    compiled = locks.select("source").distinct().withColumn("compiled", F.lit(True))
    whole = fields.select("source").distinct().join(compiled, "source", "left").join(lengths, "source", "left").join(reasons, "source", "left").join(broken, "source", "left").join(states.select("source", "content_len"), "source", "left").join(changed.withColumn("drifted", F.lit(True)), "source", "left")
    none = F.coalesce("n_pages", zero) == 0
    ema = F.when(none | F.col("drifted"), F.col("content_len")).otherwise(F.coalesce(shapes.ALPHA * F.col("chars") / F.col("n_pages") + (1 - shapes.ALPHA) * F.col("content_len"), F.col("chars") / F.col("n_pages")))
    outcome = (
        F.when(F.col("compiled").isNull(), F.struct(F.lit("broken").alias("status"), F.lit(1).alias("exit_code"), F.concat("source", F.lit(" is not compiled")).alias("error")))
        .when(none, F.struct(F.lit("blocked").alias("status"), F.lit(runs.EXIT["blocked"]).alias("exit_code"), F.coalesce("reason", F.lit("no page")).alias("error")))
        .when(F.col("drifted"), F.struct(F.lit("broken").alias("status"), F.lit(runs.EXIT["drift"]).alias("exit_code"), F.lit("drift was found and repair is off").alias("error")))
        .when(F.col("broken").isNotNull(), F.struct(F.lit("broken").alias("status"), F.lit(runs.EXIT["broken"]).alias("exit_code"), F.concat(F.lit("broken: "), F.col("broken")).alias("error")))
        .otherwise(F.struct(F.lit("ok").alias("status"), F.lit(0).alias("exit_code"), F.lit("").alias("error")))
    )
    sources = whole.where(~F.col("source").isin(drifted)).select("source", outcome.alias("o"), F.coalesce("n_pages", zero).alias("n_pages"), ema.alias("content_len")).select("source", "o.status", "o.exit_code", "o.error", "n_pages", "content_len")
    good = sources.where("status = 'ok'").select("source")
    alive = F.max(F.col("value").isNotNull() | F.col("values").isNotNull())  # rows without any value are left out
    kept = cast.groupBy("source", "page_id", "item").agg(alive.alias("alive")).where("alive").drop("alive")
    items = cast.join(good, "source", "left_semi").join(kept, ["source", "page_id", "item"], "left_semi").select("source", "page_id", "item", "field", "value", "values")
    if good_path:
        served = sources_with_last_good(spark, good_path).withColumn("served", F.lit(True))
        sources = sources.join(served, "source", "left").withColumn("status", F.when(F.col("served") & F.col("status").isin("blocked", "broken") & (F.col("exit_code") != 1), "stale").otherwise(F.col("status"))).drop("served")
    if repaired:
        rows = [(n, r.status, r.exit_code, r.error, None, r.content_len) for n, r in repaired.items()]
        sources = sources.unionByName(spark.createDataFrame(rows, "source string, status string, exit_code int, error string, n_pages long, content_len double"))
    return Runs(sources, items, causes, new_locks, repaired)
