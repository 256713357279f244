"""From declared fields and pages to selectors: items and candidates are ranked, tried and kept with a fingerprint."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.types import FieldType
from tarnflow.operators import candidates, probes
from tarnflow.operators.extraction import Selector
from tarnflow.plans.ask import parse_selector_reply
from tarnflow.plans.heal import VERIFIED

#: Item selectors that are tried, candidates of a field for the choice among them, and fallbacks that are kept.
ITEMS_TRIED, QUICK, FALLBACKS, PROPOSALS = 5, 3, 2, 2


@dataclass(frozen=True)
class FieldSpec:
    """A declared field; ``selector`` is a manual one, which always wins."""

    ft: FieldType
    description: str = ""
    selector: Selector | None = None


@dataclass(frozen=True)
class SourceSpec:
    """A declared source: fields in order, an item description (None: pages may be single records), contract."""

    name: str
    fields: dict[str, FieldSpec]
    item: str | None = "items"
    min_items: int = 1
    version: str = "1.0.0"
    loose: bool = False


@dataclass
class Compiled:
    """The chosen item selector, one lock row for each field, and how each was found (manual, heuristic, proposal)."""

    item: str | None
    locks: list[dict] = field(default_factory=list)
    via: dict[str, str] = field(default_factory=dict)
    failed: list[str] = field(default_factory=list)


#: name, candidates (css, attr) in order.
Ranked = dict[str, list[Selector]]


def ranked_candidates(nodes: DataFrame, item: str | None, wanted: dict[str, FieldSpec], base: Column | None = None, most: int = candidates.MAX_FIELDS, locks: dict[str, dict] | None = None) -> Ranked:
    """The best selectors of each field over all pages: those of most pages first, then by score.

    A few strings for each field reach the driver.
    """
    parts = []
    for name, spec in wanted.items():
        lock = (locks or {}).get(name, {})
        one = candidates.field_candidates(nodes, item, spec.ft, spec.description, name, base, lock.get("value_shape") or None, lock.get("samples") or [], lock.get("class_tokens") or [])
        parts.append(one.groupBy("css", "attr").agg(F.count(F.lit(1)).alias("pages"), F.avg("score").alias("score"), F.min("rank").alias("rank")).orderBy(F.col("pages").desc(), F.col("score").desc(), "rank", "css").limit(most).withColumn("field", F.lit(name)))
    rows = reduce(DataFrame.union, parts).collect() if parts else []
    return {n: [Selector(r["css"], r["attr"]) for r in sorted((r for r in rows if r["field"] == n), key=lambda r: (-r["pages"], -r["score"], r["rank"], r["css"]))] for n in wanted}


def passing(nodes: DataFrame, item: str | None, wanted: dict[str, FieldSpec], ranked: Ranked, base: Column | None = None) -> Ranked:
    """The candidates that pass the rule, in order; all are tried in one pass."""
    keys = {f"{name}_{k}": (name, s) for name, some in ranked.items() for k, s in enumerate(some)}
    if not keys:
        return {n: [] for n in wanted}
    tried = probes.probe(nodes, item, {k: (wanted[name].ft, s) for k, (name, s) in keys.items()}, base)
    nullable = F.col("field").isin([k for k, (name, _) in keys.items() if wanted[name].ft.nullable])
    good = {r["field"] for r in tried.where(probes.passes(nullable)).select("field").collect()}
    return {n: [s for k, (name, s) in keys.items() if name == n and k in good] for n in wanted}


def choose_item(nodes: DataFrame, spec: SourceSpec, base: Column | None = None) -> str | None:
    """The item selector under which most fields have a passing candidate; the first of equals; None: the page itself."""
    found = candidates.item_candidates(nodes, spec.min_items).groupBy("css").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"), F.avg("mean_depth").alias("depth"), F.max("robust").alias("robust"))
    options: list[str | None] = [r["css"] for r in found.orderBy(F.col("pages").desc(), F.col("n").desc(), "depth", F.col("robust").desc(), "css").limit(ITEMS_TRIED).collect()]
    if spec.item is None:
        options.append(None)
    best, most = None, -1
    for item in options:
        score = sum(map(bool, passing(nodes, item, spec.fields, ranked_candidates(nodes, item, spec.fields, base, QUICK), base).values()))
        if score > most:
            best, most = item, score
    return best


def proposed(complete: Callable[[str], str], nodes: DataFrame, item: str | None, name: str, spec: FieldSpec, snippet: str, base: Column | None = None, attempts: int = PROPOSALS) -> Selector | None:
    """A model's selector for one field, if it passes; what went wrong goes into the next prompt."""
    ask = f"One field: {name}\nType: {spec.ft.name}\nMeaning: {spec.description or name}\nWithin: {item or 'the page'}\nHTML:\n{snippet}\nEnd with two lines, SELECTOR: <css> and ATTR: <text or an attribute>."
    note = ""
    for _ in range(attempts):
        reply = parse_selector_reply(complete(ask + note))
        if not (css := reply.get("selector")):
            note = "\nThere was no SELECTOR line."
            continue
        selector = Selector(str(css), str(reply.get("attr") or "text"))
        got = probes.probe(nodes, item, {name: (spec.ft, selector)}, base).withColumn("good", probes.passes(F.lit(spec.ft.nullable))).first()
        if got and got["good"]:
            return selector
        note = f"\n{css} matched {got['matched_scopes'] if got else 0} of {got['scopes'] if got else 0} with {got['cast_fail'] if got else 0} values that do not fit, such as {list(got['raws'][:3]) if got else []}."
    return None


def lock_rows(nodes: DataFrame, item: str | None, spec: SourceSpec, chosen: dict[str, tuple[Selector, list[Selector]]]) -> list[dict]:
    """Lock rows (state.LOCKS) of chosen selectors with their fingerprints."""
    prints = {r["field"]: r.asDict() for r in probes.fingerprints(nodes, item, {n: (spec.fields[n].ft, s) for n, (s, _) in chosen.items()}).collect()} if chosen else {}
    order = list(spec.fields)
    return [{"source": spec.name, "field": n, "field_order": order.index(n), "css": s.css, "attr": s.attr, "fallbacks": [{"css": f.css, "attr": f.attr} for f in rest], "status": VERIFIED, "confirm_runs": 0, "heal_count": 0, **prints[n]} for n, (s, rest) in chosen.items()]


def compile_source(nodes: DataFrame, spec: SourceSpec, base: Column | None = None, complete: Callable[[str], str] | None = None, snippet: Callable[[str | None], str] = lambda item: "") -> Compiled:
    """Selectors for all fields of a source from the nodes of some pages.

    A manual selector wins; else the first candidate that passes, with up to
    FALLBACKS others of another css; else a model's proposal where ``complete`` is
    given.  Fields without any are listed as failed.
    """
    item = choose_item(nodes, spec, base)
    open_ = {n: f for n, f in spec.fields.items() if f.selector is None}
    good = passing(nodes, item, open_, ranked_candidates(nodes, item, open_, base), base)
    chosen, out = {}, Compiled(item)
    for name, f in spec.fields.items():
        if f.selector:
            chosen[name], out.via[name] = (f.selector, []), "manual"
        elif good[name]:
            first, *rest = good[name]
            others = list({s.css: s for s in rest if s.css != first.css}.values())
            chosen[name], out.via[name] = (first, others[:FALLBACKS]), "heuristic"
        elif complete and (s := proposed(complete, nodes, item, name, f, snippet(item), base)):
            chosen[name], out.via[name] = (s, []), "proposal"
        else:
            out.failed.append(name)
    out.locks = lock_rows(nodes, item, spec, chosen)
    return out
