"""Sources that are run again and again, each after its own interval.

When a source was last run is a row of a versioned table, so a watch that is
started again goes on where the last one stopped: what fell due meanwhile is run
at once, what was run is not run again before its time.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.sources.versions import VersionedTable

_UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}
#: Bounds of a pause between looks at the table, in seconds.
SHORTEST, LONGEST = 0.5, 5.0
LAST = "source string, last double, ok boolean, error string"


def duration(text: str) -> float:
    """Seconds of ``500ms``, ``2s``, ``15m``, ``6h`` or ``1d``; a plain number is seconds."""
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h|d)?\s*", text)
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    return float(found[1]) * _UNITS[found[2] or "s"]


def rate(text: str) -> float:
    """Seconds between requests of ``1/2s`` or ``30/m``."""
    n, _, per = text.partition("/")
    span = duration(per if re.match(r"\s*\d", per) else f"1{per.strip()}")
    if not re.fullmatch(r"\s*\d+(?:\.\d+)?\s*", n) or not float(n):
        raise ValueError(f"not a rate: {text!r}")
    return span / float(n)


def due_times(schedule: DataFrame, last: DataFrame | None) -> DataFrame:
    """source and ``due``: when each source of ``schedule`` (source, every in seconds) is to run next; never run: at 0."""
    if last is None:
        return schedule.select("source", F.lit(0.0).alias("due"))
    return schedule.join(last.select("source", "last"), "source", "left").select("source", F.coalesce(F.col("last") + F.col("every"), F.lit(0.0)).alias("due"))


def watch_once(spark: SparkSession, schedule: DataFrame, run: Callable[[DataFrame], DataFrame | None], path: str, now: float) -> float | None:
    """Run all sources that are due by ``now`` as one job, oldest first; when the next one falls due (None: no source at all).

    ``run`` takes the due sources (source, due) and may return (source, ok, error)
    of each; those that it says nothing of have gone well.  If it fails as a whole,
    all of them are noted as failed and wait for their next turn; nothing else stops.
    Times are noted after the run: a watch that dies in between runs them again.
    """
    table = VersionedTable(spark, path)
    times = due_times(schedule, table.read()).cache()
    try:
        ready = times.where(F.col("due") <= now).orderBy("due", "source")
        if not ready.isEmpty():
            try:
                told = run(ready)
            except Exception as e:  # a watch goes on
                told = ready.select("source", F.lit(False).alias("ok"), F.lit(str(e)[:500]).alias("error"))
            noted = ready.select("source", F.lit(now).alias("last"))
            if told is None:
                noted = noted.withColumns({"ok": F.lit(True), "error": F.lit("")})
            else:
                noted = noted.join(told.select("source", "ok", "error"), "source", "left").withColumns({"ok": F.coalesce("ok", F.lit(True)), "error": F.coalesce("error", F.lit(""))})
            table.upsert(noted, "source")
        return due_times(schedule, table.read()).agg(F.min("due")).first()[0]
    finally:
        times.unpersist()


def watch(spark: SparkSession, schedule: DataFrame, run: Callable[[DataFrame], DataFrame | None], path: str, until: float | None = None, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> None:
    """:func:`watch_once` again and again, until the clock passes ``until`` or there is nothing to watch."""
    while until is None or clock() < until:
        following = watch_once(spark, schedule, run, path, clock())
        if following is None:
            return
        sleep(min(LONGEST, max(SHORTEST, following - clock())))
