"""Lookups: tables of parameters become addresses, pages and typed items.

A lookup is a source whose address takes parameters.  Any number of requests is
one job: addresses are bound as columns, each distinct one is fetched once, and
pages are judged and extracted like stored ones.  As different requests rightly
give different pages, a page without items is no drift by itself: repair is
judged on one page that is known to be good, the fixture.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators import extraction
from tarnflow.plans import heal, runs
from tarnflow.plans.compiling import SourceSpec
from tarnflow.plans.planner import drop_all_null
from tarnflow.sources import pages as page_source
from tarnflow.sources.versions import VersionedTable

#: Exit code of a request's status.
EXIT = {"ok": 0, "not_found": 0, "error": 1, "blocked": 2, "broken": 3}
#: Answers that a memo holds at most; the oldest leave first.
MEMO_SIZE = 1000

Fetch = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class LookupSpec:
    """``params``: each parameter's default, empty for none; ``not_found``: arguments of :func:`page_source.not_found`.

    ``fixture``: parameters of a page that is known to have items; ``ttl``:
    seconds for which a single answer may be given again.
    """

    source: SourceSpec
    template: str
    params: dict[str, str]
    optional: frozenset[str] = frozenset()
    not_found: dict = field(default_factory=dict)
    fixture: dict[str, str] | None = None
    ttl: float = 0


@dataclass
class Answers:
    """``requests``: request_id, url, page_id, status, error and count of each request; ``items``: page_id, item and the fields.

    Requests with the same address share a page.  ``locks`` are those after a
    repair, to be stored where ``healed`` names fields.
    """

    requests: DataFrame
    items: DataFrame
    locks: list[dict]
    healed: list[str] = field(default_factory=list)


def bound(spec: LookupSpec, requests: DataFrame) -> DataFrame:
    """request_id, url and error of each request; a required parameter that is null, empty or no column is an error without url."""
    there = set(requests.columns)
    values = {p: F.coalesce(F.nullif(F.col(p).cast("string"), F.lit("")) if p in there else F.lit(None).cast("string"), F.nullif(F.lit(default), F.lit(""))) for p, default in spec.params.items()}
    missing = F.concat_ws(", ", *[F.when(v.isNull(), F.lit(p)) for p, v in values.items() if p not in spec.optional])
    error = F.when(missing != "", F.concat(F.lit("missing parameters: "), missing))
    return requests.select("request_id", error.alias("error"), F.when(missing == "", page_source.bind_url(spec.template, values)).alias("url"))


def fetched_pages(asked: DataFrame, fetch: Fetch) -> DataFrame:
    """page_id (the least request of an address), url and what ``fetch`` gives for it: url_final, status, html, error."""
    once = asked.where("url IS NOT NULL").groupBy("url").agg(F.min("request_id").alias("page_id"))
    return once.join(fetch(once.select("url")).select("url", "url_final", F.col("status").cast("int").alias("status"), "html", F.col("error").alias("failure")), "url")


def judged_pages(pages: DataFrame, spec: LookupSpec, content_len: float | None) -> DataFrame:
    """``pages`` with ``verdict`` (ok, blocked, not_found) and ``reason``."""
    final = F.coalesce("url_final", "url")
    reason = F.coalesce(F.col("failure"), page_source.block_reason(F.col("status"), F.col("html"), final, F.try_parse_url("url", F.lit("AUTHORITY")), F.lit(content_len).cast("double")))
    absent = page_source.not_found(F.col("html"), F.col("status"), **spec.not_found) if spec.not_found else F.lit(False)
    return pages.withColumn("reason", reason).withColumn("verdict", F.when(F.col("reason").isNotNull(), "blocked").when(absent, "not_found").otherwise("ok"))


def lookup(spark: SparkSession, spec: LookupSpec, item: str | None, locks: list[dict], requests: DataFrame, fetch: Fetch = page_source.fetch, content_len: float | None = None, heal_allowed: bool = True) -> Answers:
    """Answers to all ``requests`` (request_id and columns of parameters; others are ignored).

    Statuses: ``error`` (a parameter is missing), ``blocked``, ``not_found``,
    ``ok`` (with or without items) and ``broken`` (no items, and a field is
    broken or the source is not compiled).  If a fine page has no items, the
    fixture is fetched and repaired, and empty pages are extracted once more.
    No request is lost, repeated ones are answered alike, and an empty table
    gives empty tables.
    """
    asked = runs.stored(bound(spec, requests))
    if not locks:
        error = F.coalesce("error", F.lit(f"{spec.source.name} is not compiled"))
        status = F.when(F.col("error").isNull(), "broken").otherwise("error")
        lost = asked.select("request_id", "url", F.lit(None).cast("long").alias("page_id"), status.alias("status"), error.alias("error"), F.lit(0).cast("long").alias("count"))
        return Answers(lost, spark.createDataFrame([], "page_id long, item int"), locks)
    pages = runs.stored(judged_pages(fetched_pages(asked, fetch), spec, content_len))
    fine = pages.where("verdict = 'ok'")
    items = runs.stored(_items(spec, item, locks, fine))
    healed: list[str] = []
    if heal_allowed and spec.fixture:
        empty = fine.join(items.select("page_id").distinct(), "page_id", "left_anti")
        if not empty.isEmpty():
            locks, healed = heal_on_fixture(spark, spec, item, locks, fetch, content_len)
            if healed:
                items = items.unionByName(runs.stored(_items(spec, item, locks, empty)))
    broken = any(r["status"] == heal.BROKEN for r in locks)
    counts = items.groupBy("page_id").agg(F.count(F.lit(1)).alias("count"))
    outcome = pages.join(counts, "page_id", "left").select("url", "page_id", "verdict", "reason", F.coalesce("count", F.lit(0)).alias("count"))
    status = F.when(F.col("error").isNotNull(), "error").when((F.col("verdict") == "ok") & (F.col("count") == 0) & F.lit(broken), "broken").otherwise(F.coalesce("verdict", F.lit("blocked")))
    nothing = F.when(F.col("url").isNotNull() & F.col("verdict").isNull(), "no answer")
    answers = asked.join(outcome, "url", "left").select("request_id", "url", "page_id", status.alias("status"), F.coalesce("error", "reason", nothing).alias("error"), F.coalesce("count", F.lit(0)).alias("count"))
    return Answers(answers, items, locks, healed)


def _items(spec: LookupSpec, item: str | None, locks: list[dict], pages: DataFrame) -> DataFrame:
    """Items with any value; addresses in them are resolved against their own page's."""
    fields = runs.selectors(spec.source, locks)
    raw = extraction.extract_pages(pages, item, fields)
    based = raw.join(pages.select("page_id", F.coalesce("url_final", "url").alias("_base")), "page_id")
    return drop_all_null(extraction.cast_items(based, {n: ft for n, (ft, _) in fields.items()}, F.col("_base")), list(fields))


def heal_on_fixture(spark: SparkSession, spec: LookupSpec, item: str | None, locks: list[dict], fetch: Fetch, content_len: float | None = None) -> tuple[list[dict], list[str]]:
    """(locks, healed fields) after a run over the fixture's page; locks stay as they are where it is blocked or shows no drift."""
    asked = bound(spec, spark.createDataFrame([(0, *spec.fixture.values())], ["request_id", *spec.fixture]))
    page = runs.stored(judged_pages(fetched_pages(asked, fetch), spec, content_len).where("verdict = 'ok'"))
    if page.isEmpty():
        return locks, []
    base: Column = F.lit(page.select(F.coalesce("url_final", "url")).first()[0])
    run = runs.run_source(spark, spec.source, item, locks, page.select("page_id", F.coalesce("url_final", "url").alias("url"), "status", "html"), content_len=content_len, base=base)
    return (run.locks, run.healed) if run.causes else (locks, [])


class Memo:
    """Answers to single requests that may be given again for ``ttl`` seconds, by source and parameters."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.held = clock, {}

    def get(self, spec: LookupSpec, arguments: dict) -> dict | None:
        when, answer = self.held.get(self._key(spec, arguments), (None, None))
        return answer if when is not None and self.clock() - when < spec.ttl else None

    def put(self, spec: LookupSpec, arguments: dict, answer: dict) -> None:
        if spec.ttl:
            self.held.pop(self._key(spec, arguments), None)
            self.held[self._key(spec, arguments)] = self.clock(), answer
            while len(self.held) > MEMO_SIZE:
                del self.held[next(iter(self.held))]

    @staticmethod
    def _key(spec: LookupSpec, arguments: dict) -> tuple:
        return spec.source.name, tuple(sorted((k, str(v)) for k, v in arguments.items()))


class SharedMemo(Memo):
    """The same for any number of sessions: answers lie in a table of whole versions for each of ``buckets`` parts of the keys.

    An answer rewrites its own bucket only, and drops what has expired there.
    """

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time, buckets: int = 64):
        self.spark, self.path, self.clock, self.buckets = spark, path.rstrip("/"), clock, buckets

    def _bucket(self, key: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/{zlib.crc32(key.encode()) % self.buckets:04d}")

    def get(self, spec: LookupSpec, arguments: dict) -> dict | None:
        key = json.dumps(self._key(spec, arguments))
        held = self._bucket(key).read()
        row = held.where((F.col("key") == key) & (F.col("until") > self.clock())).first() if held is not None else None
        return json.loads(row["answer"]) if row else None

    def put(self, spec: LookupSpec, arguments: dict, answer: dict) -> None:
        if not spec.ttl:
            return
        key, now = json.dumps(self._key(spec, arguments)), self.clock()
        new = self.spark.createDataFrame([(key, now + spec.ttl, json.dumps(answer, default=str))], "key string, until double, answer string")
        self._bucket(key).update(lambda old: new if old is None else old.where((F.col("key") != key) & (F.col("until") > now)).unionByName(new))


def lookup_one(spark: SparkSession, spec: LookupSpec, item: str | None, locks: list[dict], arguments: dict[str, str], memo: Memo | None = None, **how) -> tuple[dict, Answers | None]:
    """(status, error, url, items, healed, cached) of one request, and its answers unless they came from the memo."""
    if memo and (known := memo.get(spec, arguments)):
        return known | {"cached": True}, None
    row = spark.createDataFrame([(0, *(str(v) for v in arguments.values()))], ["request_id", *arguments])
    got = lookup(spark, spec, item, locks, row, **how)
    about = got.requests.first()
    found = got.items.orderBy("item").drop("page_id", "item").collect() if about["count"] else []
    answer = {"status": about["status"], "error": about["error"], "url": about["url"], "items": [r.asDict(recursive=True) for r in found], "healed": got.healed, "cached": False}
    if memo and found and not got.healed:
        memo.put(spec, arguments, answer)
    return answer, got
