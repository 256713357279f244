"""States of fields and timers of sources in the state store."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnflow.plans import heal
from tarnflow.sources.state import LOCKS
from tarnflow.streaming import field_states as states
from tarnflow.streaming import timers

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    before = {k: spark.conf.get(k) for k in (PROVIDER, "spark.sql.shuffle.partitions")}
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def lock(source, field, order):
    return {"source": source, "field": field, "field_order": order, "css": f".{field}", "attr": "text", "fallbacks": [{"css": ".z", "attr": "text"}], "status": heal.VERIFIED, "confirm_runs": 0, "heal_count": 0, "value_shape": "", "samples": [], "match_count_ema": None if order else 4.0, "null_rate_ema": 0.1, "len_mean": None, "tag": "", "class_tokens": [], "ancestor_sig": ""}


def histories(seed, keys, runs):
    """Random reports: quiet runs, drift with and without a choice, again and again the same selectors."""
    rng, out = random.Random(seed), []
    for source, field in keys:
        for run in range(1, runs + 1):
            drifted = rng.random() < 0.3
            css = rng.choice([None, ".a", ".b", ".c"]) if drifted else None
            out.append((source, field, run, drifted, css, css and rng.choice(["text", "href"]), float(rng.randrange(9)), rng.choice([None, 0.25]), rng.choice([None, 3.5, 8.0])))
    return out


def by_batch_rules(spark, locks, reports, runs):
    """(source, field, run) -> what the rules over whole tables give after each run."""
    now, out = spark.createDataFrame(locks, LOCKS), {}
    for run in range(1, runs + 1):
        some = spark.createDataFrame([r for r in reports if r[2] == run], states.REPORTS)
        after = heal.healed_locks(now, some.where("drifted"), some.where("css IS NOT NULL"))
        seen = some.select("source", "field", "match_count", F.col("null_rate").alias("null_count"), F.lit(1).alias("items"), "len_mean")
        fine = heal.updated_statistics(after.where(F.col("status") != heal.BROKEN), seen)
        rows = [r.asDict(recursive=True) for r in fine.unionByName(after.where(F.col("status") == heal.BROKEN)).collect()]
        out |= {(r["source"], r["field"], run): r for r in rows}
        now = spark.createDataFrame(rows, LOCKS)
    return out


def streamed(spark, path, locks, patience=None, last=0):
    """All states that a stream gives for the reports that lie there now (with patience: up to run ``last``); it goes on from its checkpoint."""
    got = []
    reports = spark.readStream.schema(states.REPORTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out = states.field_states(reports, spark.createDataFrame(locks, LOCKS), patience)
    query = out.writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{path}/check")
    if patience is None:
        query = query.trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return got
    query, until = query.trigger(processingTime="0 seconds").start(), time.time() + 60
    while time.time() < until and query.exception() is None and not any(r.run == last for r in got):
        time.sleep(0.2)
    query.stop()
    assert query.exception() is None
    return got


def put(spark, path, rows):
    spark.createDataFrame(rows, states.REPORTS).coalesce(1).write.mode("append").parquet(f"{path}/in")


def test_states_do_not_depend_on_order(spark, tmp_path):
    keys = [("s", "a"), ("s", "b"), ("t", "a")]
    locks = [lock(s, f, k) for k, (s, f) in enumerate(keys)]
    reports = histories(3, keys, 6)
    want = by_batch_rules(spark, locks, reports, 6)
    mixed = reports + reports[:5] + [("u", "none", 1, False, None, None, 1.0, 0.0, 1.0), ("s", "a", None, True, None, None, 1.0, 0.0, 1.0)]
    random.Random(8).shuffle(mixed)
    path, got = f"file://{tmp_path}", []
    for some in (mixed[:9], mixed[9:]):  # the second call restarts from the checkpoint
        put(spark, path, some)
        got += streamed(spark, path, locks)
    assert sorted((r.source, r.field, r.run) for r in got) == sorted(want)
    for r in got:
        w = want[r.source, r.field, r.run]
        for name in ("css", "attr", "status", "confirm_runs", "heal_count"):
            assert r[name] == w[name], (r, w)
        assert [f.asDict() for f in r.fallbacks] == w["fallbacks"]
        for name in ("match_count_ema", "null_rate_ema", "len_mean"):
            assert r[name] == w[name] or abs(r[name] - w[name]) < 1e-12
    assert {r.event for r in got} >= {"heal", "heal-failed", None}


def test_events():
    quiet, chosen = {k: None for k in ("css", "attr", "match_count", "null_rate", "len_mean")} | {"drifted": False}, {"drifted": True, "css": ".n", "attr": "text", "match_count": 1.0, "null_rate": 0.0, "len_mean": 2.0}
    now, told = lock("s", "a", 0), []
    for seen in (quiet, chosen, quiet, quiet, chosen | {"css": ".m"}, chosen, quiet):
        now, event = states.after_run(now, seen)
        told.append((event, now["status"]))
    assert told == [(None, heal.VERIFIED), ("heal", heal.UNCONFIRMED), (None, heal.UNCONFIRMED), ("heal-confirmed", heal.VERIFIED), ("heal", heal.UNCONFIRMED), ("thrash-revert", heal.BROKEN), (None, heal.BROKEN)]
    assert now["css"] == ".n" and [f["css"] for f in now["fallbacks"]] == [".m", ".a", ".z"][:3]


def test_a_gap_is_given_up_after_a_while(spark, tmp_path):
    path, locks = f"file://{tmp_path}", [lock("s", "a", 0)]
    quiet = lambda run: ("s", "a", run, False, None, None, 4.0, 0.0, 2.0)
    put(spark, path, [quiet(1), quiet(4)])
    assert [r.run for r in streamed(spark, path, locks, 0.0, 4)] == [1, 4]
    put(spark, path, [quiet(3), quiet(2), quiet(5)])  # two of them are too late
    assert [r.run for r in streamed(spark, path, locks, 0.0, 5)] == [5]



def test_timers_by_a_clock_of_the_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    kinds, path, fired = "source string, every double, at timestamp", f"file://{tmp_path}", []

    def tick(seconds, *rows):
        """The clock moves on to start + seconds, in a query of its own that starts from the checkpoint."""
        some = [(s, e, start + timedelta(seconds=seconds)) for s, e in rows] or [(None, None, start + timedelta(seconds=seconds))]
        spark.createDataFrame(some, kinds).coalesce(1).write.mode("append").parquet(f"{path}/in")
        before = len(fired)
        run = lambda due: fired.extend((r.source, int((r.due - start).total_seconds())) for r in due.collect())
        query = timers.watch_stream(spark.readStream.schema(kinds).parquet(f"{path}/in"), run, f"{path}/check", event_time=True)
        assert query.awaitTermination(120) and query.exception() is None
        return fired[before:]

    assert tick(0, ("fast", 10.0), ("slow", 60.0), ("never", None)) in ([], [("fast", 0), ("slow", 0)])
    tick(5)
    assert sorted(fired) == [("fast", 0), ("slow", 0)]
    assert tick(11) == [("fast", 10)]
    assert tick(12) == []
    assert tick(47) == [("fast", 20)]  # missed turns are one turn
    assert tick(51) == [("fast", 50)]
    assert tick(65) == [("fast", 60), ("slow", 60)] and sorted(fired[-2:]) == [("fast", 60), ("slow", 60)]
    tick(66, ("fast", 0.0))  # its watch ends
    assert tick(130) == [("slow", 120)]
