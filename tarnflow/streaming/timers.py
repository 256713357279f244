"""Sources that fall due by timers of their own in the state store.

Each source is a key with one timer.  When it fires, a row says that the source is
due, and the next timer is set; so any number of sources is watched by a streaming
query, and after a restart the checkpoint has every timer that was set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: ``due``: when the source was to run; ``fired``: the clock when that was seen.
DUE = "source string, due timestamp, fired timestamp"


class _Timers(StatefulProcessor):
    def __init__(self, event_time: bool):
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.every = handle.getValueState("every", "millis long, at long")

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max((r for part in rows for r in part.itertuples(index=False)), key=lambda r: r.at_ms)
        known = self.every.get() if self.every.exists() else None
        if known and newest.at_ms < known[1]:
            return  # an older declaration, come late
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if newest.millis <= 0:
            self.every.update((0, int(newest.at_ms)))
            return
        self.every.update((int(newest.millis), int(newest.at_ms)))
        # a new source is due at once, a changed one an interval after its declaration
        first = int(newest.at_ms) + (int(newest.millis) if known and known[0] else 0)
        self.handle.registerTimer(max(first, self._now(timerValues) + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, now, every = expiredTimerInfo.getExpiryTimeInMs(), self._now(timerValues), self.every.get()[0]
        # turns that were missed are one turn; the next ones keep the source's beat
        self.handle.registerTimer(due + every * ((max(now, due) - due) // every + 1))
        yield pd.DataFrame({"source": [key[0]], "due": pd.to_datetime([due], unit="ms"), "fired": pd.to_datetime([max(now, due)], unit="ms")})

    def close(self) -> None:
        pass


def due_sources(schedule: DataFrame, event_time: bool = False) -> DataFrame:
    """A row (DUE) whenever a source falls due, from a stream of declarations (source, every in seconds, at timestamp).

    The newest declaration of a source counts; an ``every`` that is null or not
    above 0 ends its watch.  The clock is the machine's, or with ``event_time`` the
    stream's own (its watermark on ``at``: rows of any source move it on; those
    without a source do nothing else).  Sources fall due in any number of tasks.
    """
    rows = schedule.withWatermark("at", "0 seconds") if event_time else schedule
    keyed = rows.select("source", F.coalesce(F.round(F.col("every") * 1000), F.lit(0)).cast("long").alias("millis"), F.unix_millis("at").alias("at_ms"), "at")
    keyed = keyed.where("at IS NOT NULL" if event_time else "at IS NOT NULL AND source IS NOT NULL")
    fired = keyed.withColumn("source", F.coalesce("source", F.lit(""))).groupBy("source").transformWithStateInPandas(_Timers(event_time), DUE, "Update", "EventTime" if event_time else "ProcessingTime")
    return fired.where("source <> ''")


def watch_stream(schedule: DataFrame, run: Callable[[DataFrame], None], checkpoint: str, event_time: bool = False, interval: str = "1 second") -> StreamingQuery:
    """Call ``run`` with each batch of due sources (distinct, oldest first).

    By the machine's clock the query runs until it is stopped and looks at its timers
    after each ``interval``; by the stream's own clock it takes what is there and ends.

    A batch whose run fails is given again after a restart.
    """

    def batch(due: DataFrame, _: int) -> None:
        if not due.isEmpty():
            run(due.groupBy("source").agg(F.min("due").alias("due"), F.max("fired").alias("fired")).orderBy("due", "source"))

    writer = due_sources(schedule, event_time).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if event_time else writer.trigger(processingTime=interval)).start()
