"""Addresses of pages, access rules and the verdict on a fetched page."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Signs of a challenge page, and of an address that a block leads to.
CHALLENGES = ("cf-chl", "cf_chl", "captcha", "just a moment", "attention required", "access denied", "are you a robot", "enable javascript and cookies", "ddos protection", "checking your browser")
BLOCK_PATHS = ("/login", "/signin", "/challenge", "/denied", "/captcha")
HEAD_CHARS, COLLAPSED = 4096, 0.2


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A stored crawl: page_id, url, html."""
    return spark.read.parquet(path)


def encoded(value: Column) -> Column:
    return F.replace(F.url_encode(value.cast("string")), F.lit("+"), F.lit("%20"))


def bind_url(template: str, params: dict[str, Column]) -> Column:
    """An address from a template: ``{p}`` takes a parameter as a path part, all others go to the query; null and empty ones are left out."""
    inside = set(re.findall(r"\{(\w+)\}", template))
    out: Column = F.lit(template)
    for name in inside:
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(encoded(params[name]), F.lit("")) if name in params else F.lit(""))
    rest = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{n}="), F.url_encode(v.cast("string")))) for n, v in params.items() if n not in inside]
    if not rest:
        return out
    query = F.concat_ws("&", *rest)
    return F.when(query == "", out).otherwise(F.concat(out, F.lit("&" if "?" in template else "?"), query))


def missing_params(declared: list[str], defaults: dict[str, str], given: dict[str, str]) -> list[str]:
    return [p for p in declared if not (given.get(p) or defaults.get(p))]


def block_reason(status: Column, html: Column, url: Column, origin_host: Column, length_ema: Column) -> Column:
    """Why a page is no genuine answer, or null: status, challenge, other host, log-in address, collapsed content."""
    head = F.lower(F.substring(html, 1, HEAD_CHARS))
    host, path = F.try_parse_url(url, F.lit("AUTHORITY")), F.lower(F.try_parse_url(url, F.lit("PATH")))
    out = F.when(status == 304, F.lit(None).cast("string")).when(status >= 400, F.concat(F.lit("http "), status.cast("string")))
    for sign in CHALLENGES:
        out = out.when(head.contains(sign), F.lit(f"challenge page ({sign!r})"))
    out = out.when(host.isNotNull() & (host != "") & (host != origin_host), F.concat(F.lit("redirected off-host to "), host))
    for sign in BLOCK_PATHS:
        out = out.when(path.contains(sign), F.concat(F.lit("redirected to "), F.try_parse_url(url, F.lit("PATH"))))
    return out.when((length_ema > 0) & (F.length(html) < COLLAPSED * length_ema), F.concat(F.lit("content collapsed ("), F.length(html).cast("string"), F.lit("b vs ~"), length_ema.cast("long").cast("string"), F.lit("b baseline)")))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def not_found(html: Column, status: Column, contains: str | None = None, title_contains: str | None = None, status_is: int | None = None) -> Column:
    """Whether a page is a valid empty answer by any of the declared signs."""
    out = F.lit(False)
    if status_is is not None:
        out = out | F.coalesce(status == status_is, F.lit(False))
    if title_contains:
        out = out | F.coalesce(F.lower(page_title(html)).contains(title_contains.lower()), F.lit(False))
    if contains:
        out = out | F.coalesce(F.lower(html).contains(contains.lower()), F.lit(False))
    return out


def not_found_sign(text: str) -> dict[str, str]:
    """``page title contains 'X'`` and the like as arguments of :func:`not_found`."""
    quoted = re.search(r"['\"]([^'\"]+)['\"]", text)
    return {"title_contains" if "title" in text.lower() else "contains": quoted[1] if quoted else text.strip()}


def allowed(urls: DataFrame, rules: DataFrame, agent: str = "tarnflow", url_col: str = "url") -> DataFrame:
    """Rows of ``urls`` that their host's robots text allows; rules (host, robots) of a host that is missing or null allow all."""
    host = F.try_parse_url(F.col(url_col), F.lit("AUTHORITY"))
    kept = urls.withColumn("_host", host).join(rules.select(F.col("host").alias("_host"), F.col("robots").alias("_robots")).dropDuplicates(["_host"]), "_host", "left")

    @F.pandas_udf("boolean")
    def may(robots: pd.Series, url: pd.Series) -> pd.Series:
        from urllib.robotparser import RobotFileParser

        out, parsers = [], {}
        for text, u in zip(robots, url):
            if text is None:
                out.append(True)
                continue
            if text not in parsers:
                parsers[text] = RobotFileParser()
                parsers[text].parse(text.splitlines())
            out.append(parsers[text].can_fetch(agent, u or ""))
        return pd.Series(out)

    return kept.where(may("_robots", url_col)).select(urls.columns)


ANSWER = ("url", "url_final", "status", "html", "error", "etag", "last_modified")


def answers(asked: Iterable[tuple[str | None, str | None, str | None]], seconds_per_request: float = 2.0, timeout: float = 20.0, pause: float = 1.5) -> Iterator[tuple]:
    """A row (ANSWER) for each (url, etag, last_modified), asked one after the other at a bounded rate for each host."""
    import random
    import time
    import urllib.error
    import urllib.request
    from urllib.parse import urlsplit

    def answer(url: str, got, status: int, html: str | None) -> tuple:
        return url, got.geturl(), status, html, None, got.headers.get("ETag"), got.headers.get("Last-Modified")

    last: dict[str, float] = {}
    for url, *known in asked:
        row = (url, None, None, None, "no address", None, None)
        for attempt in range(2 if url else 0):
            try:
                host = urlsplit(url).netloc
                request = urllib.request.Request(url, headers={h: v for h, v in zip(("If-None-Match", "If-Modified-Since"), known) if v})
                wait = last.get(host, 0) + seconds_per_request * random.uniform(0.7, 1.3) - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                last[host] = time.monotonic()
                with urllib.request.urlopen(request, timeout=timeout) as r:
                    row = answer(url, r, r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"))
                break
            except urllib.error.HTTPError as e:
                row = answer(url, e, e.code, None if e.code == 304 else e.read().decode("utf-8", "replace"))
                break
            except (OSError, ValueError, LookupError) as e:  # no connection, no address, an unknown charset
                row = (url, None, None, None, str(e) or type(e).__name__, None, None)
                if not attempt:
                    time.sleep(pause)
        yield row


def fetch(urls: DataFrame, seconds_per_request: float = 2.0, timeout: float = 20.0, url_col: str = "url", pause: float = 1.5) -> DataFrame:
    """url, url_final, status, html, error, etag and last_modified of each address.

    One host goes to one task, at a bounded rate with jitter; there are two
    attempts, ``pause`` seconds apart.  Where ``urls`` has the columns ``etag`` or
    ``last_modified`` of an earlier answer, the page is asked for only if it
    changed since: 304 comes without html.  A null or malformed address is an error.
    """

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = (row for batch in batches for row in zip(batch["url"], batch["etag"], batch["last_modified"]))
        for row in answers(asked, seconds_per_request, timeout, pause):
            yield pd.DataFrame([row], columns=list(ANSWER)).astype({"status": "Int32"})

    known = [(F.col(c) if c in urls.columns else F.lit(None)).cast("string").alias(c) for c in ("etag", "last_modified")]
    by_host = urls.select(F.col(url_col).alias("url"), *known).repartition(F.try_parse_url("url", F.lit("AUTHORITY")))
    return by_host.mapInPandas(visit, "url string, url_final string, status int, html string, error string, etag string, last_modified string")
