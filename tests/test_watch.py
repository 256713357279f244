"""Sources with intervals of their own over a clock of the test's."""

import pytest
from pyspark.sql import functions as F

from tarnflow.sources.versions import VersionedTable
from tarnflow.streaming.watch import duration, rate, watch, watch_once


def test_durations():
    assert [duration(x) for x in ("500ms", "2s", "15m", "6h", "1d", "7")] == [0.5, 2, 900, 21600, 86400, 7]
    assert rate("1/2s") == 2 and rate("30/m") == 2
    for bad in ("", "m", "1w", "-1s"):
        with pytest.raises(ValueError):
            duration(bad)
    with pytest.raises(ValueError):
        rate("0/s")


def test_due_times_and_restart(spark, tmp_path):
    path, now, ran = f"file://{tmp_path}/due", [100.0], []
    schedule = spark.createDataFrame([("fast", 4.0), ("slow", 10.0)], "source string, every double")

    def run(ready):
        names = [r.source for r in ready.collect()]
        ran.append((now[0], names))
        return ready.select("source", (F.col("source") != "slow").alias("ok"), F.lit("why").alias("error"))

    def sleep(seconds):
        now[0] += seconds

    watch(spark, schedule, run, path, until=113.0, clock=lambda: now[0], sleep=sleep)
    assert ran == [(100.0, ["fast", "slow"]), (104.0, ["fast"]), (108.0, ["fast"]), (110.0, ["slow"]), (112.0, ["fast"])]
    state = {r.source: (r.last, r.ok, r.error) for r in VersionedTable(spark, path).read().collect()}
    assert state == {"fast": (112.0, True, "why"), "slow": (110.0, False, "why")}
    # another watch goes on from the table: nothing is run before its time, nothing is lost
    del ran[:]
    now[0] = 113.0
    assert watch_once(spark, schedule, run, path, now[0]) == 116.0 and not ran
    now[0] = 300.0
    assert watch_once(spark, schedule, run, path, now[0]) == 304.0 and ran == [(300.0, ["slow", "fast"])] or ran == [(300.0, ["fast", "slow"])]

    def fails(ready):
        raise RuntimeError("no network")

    watch_once(spark, schedule, fails, path, 310.0)
    assert {(r.source, r.ok, r.error) for r in VersionedTable(spark, path).read().collect()} == {("fast", False, "no network"), ("slow", False, "no network")}
    assert watch_once(spark, schedule.where("false"), run, path, 400.0) is None
