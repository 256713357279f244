"""One run of a source: pages are judged, extracted, checked for drift, repaired, and its items and state come out.

A source is a table of pages of one layout, one page or billions; everything on
pages is a Spark job, and only a few rows for each field reach the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators import drift, extraction, nodes, probes, pruning, shapes
from tarnflow.operators.extraction import Selector
from tarnflow.plans import heal
from tarnflow.plans.compiling import SourceSpec, proposed, ranked_candidates
from tarnflow.plans.planner import drop_all_null
from tarnflow.sources import pages as page_source
from tarnflow.sources import state

#: Exit codes of a run's outcome.
EXIT = {"ok": 0, "healed": 0, "blocked": 2, "drift": 3, "broken": 3, "absent": 4}


@dataclass
class Run:
    """``status``: ok, healed, stale (last good items are served), blocked or broken."""

    source: str
    status: str
    items: DataFrame | None = None
    locks: list[dict] = field(default_factory=list)
    events: list[dict] = field(default_factory=list)
    causes: dict[str, list[str]] = field(default_factory=dict)
    healed: list[str] = field(default_factory=list)
    error: str = ""
    exit_code: int = 0
    content_len: float | None = None


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder that driver and executors share, so that live requests and parsing are done once even where executors are lost.

    The folder is ``spark.checkpoint.dir``; only where it is unset and Spark runs on
    one machine (tests) a temporary one is made.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tarnflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tarnflow/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def selectors(spec: SourceSpec, locks: list[dict]) -> probes.Fields:
    return {r["field"]: (spec.fields[r["field"]].ft, Selector(r["css"], r["attr"])) for r in locks}


def source_statistics(raw: DataFrame, spec: SourceSpec, locks: list[dict], n_pages: int, base: Column | None = None) -> DataFrame:
    """Per field what :func:`drift.drift_causes` takes, with counts as means of a page."""
    fields = selectors(spec, locks)
    stats = extraction.field_statistics(raw, {n: ft for n, (ft, _) in fields.items()}, base)
    per_page = {c: (F.col(c) / n_pages) for c in ("match_count",)}
    kinds = "field string, value_shape string, tag string, class_tokens array<string>, ancestor_sig string"
    old = raw.sparkSession.createDataFrame([tuple(r[c.split()[0]] for c in kinds.split(", ")) for r in locks], kinds)
    firsts = [F.struct(F.lit(n).alias("field"), (F.try_element_at(F.col(n), F.lit(1)) if ft.is_list else F.col(n)).alias("raw")) for n, (ft, _) in fields.items()]
    shaped = raw.select(F.explode(F.array(*firsts)).alias("x")).select("x.*").join(F.broadcast(old.select("field", "value_shape")), "field")
    ratio = shaped.groupBy("field").agg(shapes.shape_ratio(F.trim(F.substring("raw", 1, shapes.SHAPE_CHARS)), F.nullif(F.col("value_shape"), F.lit(""))).alias("shape_ratio"))
    signed = raw.select("page_id", "item", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"{n}__sig").alias("sig")) for n in fields])).alias("x")).select("page_id", "item", "x.*")
    now = signed.where("sig IS NOT NULL").groupBy("field").agg(F.min_by("sig", F.struct("page_id", "item")).alias("sig"))
    alike = now.join(old, "field").select("field", shapes.node_similarity(F.col("sig.tag"), F.col("sig.classes"), F.col("sig.ancestors"), F.col("tag"), F.col("class_tokens"), F.col("ancestor_sig")).alias("similarity"))
    out = stats.join(F.broadcast(ratio), "field", "left").join(F.broadcast(alike), "field", "left")
    return out.withColumns(per_page | {"similarity": F.coalesce("similarity", F.lit(0.0))})


def drift_of(stats: list[dict], spec: SourceSpec, locks: list[dict], n_pages: int, spark: SparkSession, limits: drift.Thresholds = drift.Thresholds()) -> dict[str, list[str]]:
    """Causes by field."""
    lock_of = {r["field"]: r for r in locks}
    kinds = "field string, items double, match_count double, null_count long, cast_fail long, shape_ratio double, similarity double, min_items long, nullable boolean, loose boolean, match_count_ema double, null_rate_ema double"
    rows = [(s["field"], float(s["items"]), float(s["match_count"]), s["null_count"], s["cast_fail"], s["shape_ratio"], s["similarity"], spec.min_items * n_pages, spec.fields[s["field"]].ft.nullable, spec.loose, lock_of[s["field"]]["match_count_ema"], lock_of[s["field"]]["null_rate_ema"]) for s in stats]
    df = spark.createDataFrame(rows, kinds).withColumn("items", F.col("items").cast("long"))
    return {r["field"]: r["causes"] for r in df.withColumn("causes", drift.drift_causes(limits)).where(F.size("causes") > 0).select("field", "causes").collect()}


def repair(pages: DataFrame, item: str | None, spec: SourceSpec, locks: list[dict], causes: dict[str, list[str]], n_pages: int, base: Column | None = None, complete: Callable[[str], str] | None = None, forced: bool = False, html: str = "") -> tuple[list[dict], dict[str, dict]]:
    """(locks after the repair ladder, what was chosen for each healed field).

    Stored fallbacks come first, then ranked candidates; what passes all gates is
    given out in the fields' order.  A model is asked only for fields that are
    left, and not for ones that were broken before, unless the run is forced; it
    sees the parts of ``html`` around the field's old values.
    A field with a manual selector is never given another.
    """
    spark, lock_of = pages.sparkSession, {r["field"]: r for r in locks}
    found = stored(nodes.page_nodes(pages))  # candidates are read off the nodes; selectors run on the pages
    free = {n: spec.fields[n] for n in causes if n in lock_of and spec.fields[n].selector is None}
    ranked = ranked_candidates(found, item, free, base, heal.RUNG_LIMITS[2], lock_of)
    tries: dict[str, tuple[str, int, int, Selector]] = {}
    for name in free:
        rungs = {1: [Selector(f["css"], f["attr"]) for f in lock_of[name]["fallbacks"]], 2: ranked[name]}
        seen = set() if forced else {lock_of[name]["css"]}
        for rung, some in rungs.items():
            for rank, s in enumerate(some, 1):
                if s.css not in seen:
                    seen.add(s.css)
                    tries[f"{name}_{rung}_{rank}"] = (name, rung, rank, s)
    chosen = _gated(spark, found, pages, item, spec, lock_of, tries, n_pages, base) if tries else {}
    for name in free:
        if name not in chosen and complete and (forced or lock_of[name]["status"] != heal.BROKEN):
            snippet = pruning.region_html(html, lock_of[name]["samples"], lock_of[name]["value_shape"]) if html else ""
            if s := proposed(complete, pages, item, name, free[name], snippet, base, heal.RUNG_LIMITS[3]):
                tries[f"{name}_3_1"] = (name, 3, 1, s)
                chosen |= _gated(spark, found, pages, item, spec, lock_of, {f"{name}_3_1": tries[f"{name}_3_1"]}, n_pages, base)
    after = heal.healed_locks(
        spark.createDataFrame(locks, state.LOCKS),
        spark.createDataFrame([(spec.name, n) for n in causes], "source string, field string"),
        spark.createDataFrame([(spec.name, n, c["css"], c["attr"]) for n, c in chosen.items()], "source string, field string, css string, attr string"),
    )
    return [r.asDict(recursive=True) for r in after.orderBy("field_order").collect()], chosen


def _gated(spark: SparkSession, found: DataFrame, pages: DataFrame, item: str | None, spec: SourceSpec, lock_of: dict[str, dict], tries: dict[str, tuple[str, int, int, Selector]], n_pages: int, base: Column | None) -> dict[str, dict]:
    """What the ladder gives to each field among the selectors that pass every gate."""
    tried = probes.probe(pages, item, {k: (spec.fields[name].ft, s) for k, (name, _, _, s) in tries.items()}, base)
    kinds = "key string, source string, field string, field_order int, rung int, rank int, css string, attr string, nullable boolean, min_items long, match_count_ema double, value_shape string, samples array<string>"
    order = list(spec.fields)
    rows = [(k, spec.name, n, order.index(n), rung, rank, s.css, s.attr, spec.fields[n].ft.nullable, spec.min_items, lock_of[n]["match_count_ema"], lock_of[n]["value_shape"] or None, lock_of[n]["samples"]) for k, (n, rung, rank, s) in tries.items()]
    known = [s for n in {t[0] for t in tries.values()} for s in lock_of[n]["samples"] if s]
    # which old samples the pages still have: one flag for each of a few texts
    whole = found.where("depth = 0").select(F.regexp_replace("text", r"(?U)\s+", " ").alias("text"))
    flags = whole.agg(*[F.max(F.col("text").contains(" ".join(s.split()))).alias(f"s{i}") for i, s in enumerate(known)]).first() if known else []
    text = "  ".join(s for s, there in zip(known, flags) if there)
    own = F.transform("raws", lambda x: shapes.value_shape(F.trim(x)))
    same = lambda shape: F.size(F.filter("raws", lambda x: F.regexp_like(F.trim(F.substring(x, 1, shapes.SHAPE_CHARS)), F.concat(F.lit("(?U)"), shape)))) / F.size("raws")
    best = F.array_max(F.transform(own, lambda x: F.size(F.filter(own, lambda y: y == x)))) / F.size("raws")
    has = (F.size("raws") > 0) & F.col("value_shape").isNotNull()
    probed = spark.createDataFrame(rows, kinds).join(tried.withColumnRenamed("field", "key"), "key")
    probed = probed.withColumns({"matched_scopes": F.col("matched_scopes") / n_pages, "scopes": F.col("scopes") / n_pages, "page_text": F.lit(text), "old_shape_ratio": F.when(has, same(F.col("value_shape"))), "new_shape_ratio": F.when(has, best)})
    gated = drift.gate_verdicts(probed).select("source", "field", "field_order", "rung", "rank", "css", "attr", "passed")
    locks = spark.createDataFrame([(spec.name, n, r["css"], r["attr"]) for n, r in lock_of.items()], "source string, field string, css string, attr string")
    return {r["field"]: {"css": r["css"], "attr": r["attr"], "rung": r["rung"]} for r in heal.choose(gated, locks).collect()}


def run_source(spark: SparkSession, spec: SourceSpec, item: str | None, locks: list[dict], pages: DataFrame, good_path: str | None = None, origin_host: str = "", content_len: float | None = None, heal_allowed: bool = True, forced: bool = False, complete: Callable[[str], str] | None = None, base: Column | None = None) -> Run:
    """One full run over ``pages`` (page_id, url, status, html).

    Pages that are challenges, errors or collapsed are set aside; if none is left
    the run is blocked.  Drift is repaired unless ``heal_allowed`` is false;
    ``forced`` repairs every field.  Where a required field stays broken, or the
    run is blocked, the last good items are served as stale; else the items
    become the last good ones.  Rows without any value are left out.
    """
    out = Run(spec.name, "ok", locks=locks, content_len=content_len)
    if not locks:
        out.status, out.error, out.exit_code = "broken", f"{spec.name} is not compiled", 1
        return out

    def stale(status: str, error: str, exit_code: int) -> Run:
        out.status, out.error, out.exit_code = status, error, exit_code
        if good_path and state.has_last_good(spark, good_path, spec.name):
            out.status, out.items = "stale", state.last_good(spark, good_path, spec.name)
        return out

    reason = page_source.block_reason(F.col("status"), F.col("html"), F.col("url"), F.lit(origin_host) if origin_host else F.try_parse_url("url", F.lit("AUTHORITY")), F.lit(content_len).cast("double"))
    judged = pages.withColumn("reason", reason)
    seen = judged.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("html")).alias("chars")).orderBy(F.col("n").desc(), "reason").limit(20).collect()
    fine = [r for r in seen if r["reason"] is None]
    out.events += [{"source": spec.name, "event": "blocked", "reason": r["reason"], "pages": r["n"]} for r in seen if r["reason"] is not None]
    if not fine:
        return stale("blocked", seen[0]["reason"] if seen else "no page", EXIT["blocked"])
    n_pages = fine[0]["n"]
    genuine = judged.where("reason IS NULL").select("page_id", "html")
    raw = stored(extraction.extract_pages(genuine, item, selectors(spec, locks)))
    stats = source_statistics(raw, spec, locks, n_pages, base)
    rows = [r.asDict() for r in stats.collect()]
    out.causes = drift_of(rows, spec, locks, n_pages, spark)
    if forced and not out.causes:
        out.causes = {r["field"]: ["forced"] for r in locks}
    if out.causes and not heal_allowed:
        out.events += [{"source": spec.name, "event": "drift", "field": n, "cause": c, "healed": False} for n, c in out.causes.items()]
        return stale("broken", "drift was found and repair is off", EXIT["drift"])

    before = {r["field"]: r for r in locks}
    if out.causes:
        html = judged.where("reason IS NULL").orderBy("page_id").select("html").first()["html"] if complete else ""
        out.locks, chosen = repair(genuine, item, spec, locks, out.causes, n_pages, base, complete, forced, html or "")
        for r in out.locks:
            n = r["field"]
            if n in chosen:
                thrash = r["status"] == heal.BROKEN
                out.events.append({"source": spec.name, "event": "thrash-revert" if thrash else "heal", "field": n, "cause": out.causes[n], "old": before[n]["css"], "new": r["css"], "rung": chosen[n]["rung"]})
                out.healed += [] if thrash else [n]
            elif n in out.causes:
                out.events.append({"source": spec.name, "event": "heal-failed", "field": n, "cause": out.causes[n]})
        raw = stored(extraction.extract_pages(genuine, item, selectors(spec, out.locks)))
        rows = [r.asDict() for r in source_statistics(raw, spec, out.locks, n_pages, base).collect()]
    else:
        quiet = spark.createDataFrame([], "source string, field string")
        out.locks = [r.asDict(recursive=True) for r in heal.healed_locks(spark.createDataFrame(locks, state.LOCKS), quiet, quiet.withColumns({"css": F.lit(""), "attr": F.lit("")})).orderBy("field_order").collect()]
        out.events += [{"source": spec.name, "event": "heal-confirmed", "field": r["field"]} for r in out.locks if before[r["field"]]["status"] == heal.UNCONFIRMED and r["status"] == heal.VERIFIED]
    _learn(out.locks, rows)
    out.content_len = _ema(content_len, fine[0]["chars"] / n_pages)

    broken = [r["field"] for r in out.locks if r["status"] == heal.BROKEN]
    if required := [n for n in broken if not spec.fields[n].ft.nullable]:
        return stale("broken", f"broken: {', '.join(required)}", EXIT["broken"])
    fields = selectors(spec, out.locks)
    out.items = drop_all_null(extraction.cast_items(raw, {n: ft for n, (ft, _) in fields.items()}, base), list(fields)).withColumn("source", F.lit(spec.name))
    out.status = "healed" if out.healed else "ok"
    if good_path:
        state.save_last_good(out.items, good_path)
    return out


def _ema(old: float | None, new: float | None) -> float | None:
    return old if new is None else new if old is None else shapes.ALPHA * new + (1 - shapes.ALPHA) * old


def _learn(locks: list[dict], rows: list[dict]) -> None:
    """Moving averages of the fields that are not broken."""
    now = {r["field"]: r for r in rows}
    for r in locks:
        if r["status"] != heal.BROKEN and (s := now.get(r["field"])):
            r["match_count_ema"] = _ema(r["match_count_ema"], float(s["match_count"]))
            r["null_rate_ema"] = _ema(r["null_rate_ema"], s["null_count"] / max(s["items"], 1))
            r["len_mean"] = _ema(r["len_mean"], s["len_mean"])


def run_sources(runs: list[Callable[[], Run]]) -> tuple[list[Run], int]:
    """All runs in turn and the worst exit code; one that is blocked or broken does not stop the others."""
    done = [run() for run in runs]
    return done, max((r.exit_code for r in done), default=0)
