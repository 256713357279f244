"""Live pages as a Spark data source: ``spark.read.format("tarnflow_pages")``.

One partition a host, so the rate limit of a host holds wherever its task runs.
Filters on ``url`` are pushed down: addresses that they exclude are never asked for
(``spark.sql.python.filterPushdown.enabled``).

Options: ``urls`` (one address on each line), ``seconds_per_request``, ``timeout``,
``pause``, ``robots`` (``true``: each host's robots text is asked for first, and
addresses that it forbids are answered with an error), ``agent``, and ``engine``,
``module:function`` of another fetcher with the arguments of
:func:`tarnflow.sources.pages.answers`.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from tarnflow.sources.pages import ANSWER, answers

SCHEMA = "url string, url_final string, status int, html string, error string, etag string, last_modified string"


class Host(InputPartition):
    def __init__(self, host: str, urls: list[str]):
        self.host, self.urls = host, urls


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = list(dict.fromkeys(u.strip() for u in options.get("urls", "").splitlines() if u.strip()))
        self.limits = [float(options.get(k, default)) for k, default in (("seconds_per_request", "2"), ("timeout", "20"), ("pause", "1.5"))]
        self.robots, self.agent = options.get("robots", "false").lower() == "true", options.get("agent", "tarnflow")
        self.engine = options.get("engine", "")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        tests = {EqualTo: lambda f, u: u == f.value, In: lambda f, u: u in f.value, StringStartsWith: lambda f, u: u.startswith(f.value), StringEndsWith: lambda f, u: u.endswith(f.value), StringContains: lambda f, u: f.value in u}
        for f in filters:
            if type(f) in tests and f.attribute == ("url",):
                self.urls = [u for u in self.urls if tests[type(f)](f, u)]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for url in self.urls:
            hosts.setdefault(urlsplit(url).netloc if "//" in url else "", []).append(url)
        return [Host(h, urls) for h, urls in hosts.items()] or [Host("", [])]

    def _forbidden(self, host: str, ask) -> RobotFileParser | None:
        """The host's robots rules; None (all is allowed) where they cannot be had."""
        some = next(u for u in self.urls if urlsplit(u).netloc == host)
        got = dict(zip(ANSWER, next(iter(ask([(f"{urlsplit(some).scheme}://{host}/robots.txt", None, None)], *self.limits)))))
        if got["status"] != 200:
            return None
        rules = RobotFileParser()
        rules.parse((got["html"] or "").splitlines())
        return rules

    def read(self, partition: Host) -> Iterator[tuple]:
        ask = answers
        if self.engine:
            module, _, name = self.engine.partition(":")
            ask = getattr(importlib.import_module(module), name)
        rules = self._forbidden(partition.host, ask) if self.robots and partition.host else None
        fine = [u for u in partition.urls if rules is None or rules.can_fetch(self.agent, u)]
        for url in partition.urls:
            if url not in fine:
                yield (url, None, None, None, "robots.txt forbids it", None, None)
        yield from ask([(u, None, None) for u in fine], *self.limits)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarnflow_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
