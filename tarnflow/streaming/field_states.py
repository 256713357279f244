"""What is known of each field as keyed streaming state: reports of runs in, states of fields out.

A key is a (source, field); its state is what its lock row holds.  Runs of a source
are numbered 1, 2, 3, ...  A report that comes early waits in the state store until
those before it are there (or for ``patience`` seconds, if given); one of a run that
was taken already changes nothing.  So the states do not depend on the order or the
batches in which reports arrive, and are those that the batch rules of
:mod:`tarnflow.plans.heal` give run by run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tarnflow.operators.shapes import ALPHA
from tarnflow.plans.heal import BROKEN, CONFIRM_RUNS, KEPT_FALLBACKS, UNCONFIRMED, VERIFIED

#: A run's report on a field: whether it drifted, the selector that repair chose (null: none), and what the run saw.
REPORTS = "source string, field string, run long, drifted boolean, css string, attr string, match_count double, null_rate double, len_mean double"
LOCK = "css string, attr string, fallbacks array<struct<css:string,attr:string>>, status string, confirm_runs int, heal_count int, match_count_ema double, null_rate_ema double, len_mean double"
STATES = f"source string, field string, run long, event string, {LOCK}"
_HELD = [part.split()[0] for part in LOCK.split(", ")]
_SEEN = ("drifted", "css", "attr", "match_count", "null_rate", "len_mean")
_AVERAGES = {"match_count_ema": "match_count", "null_rate_ema": "null_rate", "len_mean": "len_mean"}


def after_run(lock: dict, seen: dict) -> tuple[dict, str | None]:
    """(lock, event) after one run's report: heal, heal-failed, heal-confirmed, thrash-revert or none."""
    new, event, waits = dict(lock), None, lock["status"] == UNCONFIRMED
    if seen["css"] is not None:
        old = {"css": lock["css"], "attr": lock["attr"]}
        others = [f for f in lock["fallbacks"] if (f["css"], f["attr"]) != (seen["css"], seen["attr"])]
        new |= {"css": seen["css"], "attr": seen["attr"], "fallbacks": [old, *others][:KEPT_FALLBACKS], "confirm_runs": 0, "heal_count": lock["heal_count"] + 1, "status": BROKEN if waits else UNCONFIRMED}
        event = "thrash-revert" if waits else "heal"
    elif seen["drifted"]:
        new["status"], event = BROKEN, "heal-failed"
    elif waits:
        new["confirm_runs"] += 1
        if new["confirm_runs"] >= CONFIRM_RUNS:
            new["status"], event = VERIFIED, "heal-confirmed"
    if new["status"] != BROKEN:
        for average, value in _AVERAGES.items():
            if seen[value] is not None:
                new[average] = seen[value] if lock[average] is None else ALPHA * seen[value] + (1 - ALPHA) * lock[average]
    return new, event


def _plain(row: dict, names) -> dict:
    """The named values as plain ones; what pandas shows as missing is None."""
    return {n: None if not isinstance(row[n], list) and pd.isna(row[n]) else row[n] for n in names}


class _FieldStates(StatefulProcessor):
    def __init__(self, patience: float | None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lock = handle.getValueState("lock", "run long, lock string")
        self.waiting = handle.getMapState("waiting", "run long", "seen string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0].to_dict()
        self.lock.update((int(row["run"]), row["lock"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.lock.exists():
            return  # a field that is not compiled has no state
        done, lock = self.lock.get()
        lock = json.loads(lock)
        for part in rows:
            for row in part.to_dict("records"):
                if row["run"] > done and not self.waiting.containsKey((int(row["run"]),)):
                    self.waiting.updateValue((int(row["run"]),), (json.dumps(_plain(row, _SEEN), default=lambda x: x.item()),))
        yield self._taken(key, done, lock, timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done, lock = self.lock.get()
        yield self._taken(key, done, json.loads(lock), timerValues, True)

    def _taken(self, key, done: int, lock: dict, timers, late: bool) -> pd.DataFrame:
        """Take the runs that follow; where ``late``, the first gap is given up."""
        out = []
        if late and not self.waiting.containsKey((done + 1,)):
            done = min((k[0] for k in self.waiting.keys()), default=done + 1) - 1
        while self.waiting.containsKey((done + 1,)):
            done += 1
            lock, event = after_run(lock, json.loads(self.waiting.getValue((done,))[0]))
            self.waiting.removeKey((done,))
            out.append({"source": key[0], "field": key[1], "run": done, "event": event, "lock": json.dumps(lock)})
        self.lock.update((done, json.dumps(lock)))
        if self.patience is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if next(iter(self.waiting.keys()), None) is not None:
                self.handle.registerTimer(int(timers.getCurrentProcessingTimeInMs() + 1000 * self.patience))
        return pd.DataFrame(out, columns=["source", "field", "run", "event", "lock"])

    def close(self) -> None:
        pass


def field_states(reports: DataFrame, locks: DataFrame, patience: float | None = None) -> DataFrame:
    """One row (STATES) for each run taken of each field, from a stream of REPORTS.

    ``locks`` (source, field and the columns of LOCK) are the states before run 1;
    they are read when the stream first starts.  Of several reports of one run the
    first counts.  Fields without a lock and rows without a run give nothing.
    Reports after a gap wait; with ``patience`` the missing runs are given up that
    many seconds after the last report.  Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    start = locks.select("source", "field", F.lit(0).cast("long").alias("run"), F.to_json(F.struct(*_HELD), {"ignoreNullFields": "false"}).alias("lock"))
    keyed = reports.where("run IS NOT NULL").select("source", "field", "run", F.coalesce("drifted", F.lit(False)).alias("drifted"), *_SEEN[1:]).groupBy("source", "field")
    rows = keyed.transformWithStateInPandas(_FieldStates(patience), "source string, field string, run long, event string, lock string", "Update", "None" if patience is None else "ProcessingTime", start.groupBy("source", "field"))
    return rows.select("source", "field", "run", "event", F.from_json("lock", LOCK).alias("l")).select("source", "field", "run", "event", "l.*")
