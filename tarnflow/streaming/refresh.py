"""Continuous refresh: pages as a stream -> items, and statistics of fields as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnflow.operators.shapes import ALPHA, affine_ema


def page_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def refresh(pages: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Hand each micro-batch of pages to ``run``; without an interval all there is now, then stop."""
    writer = pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def running_ema(stream: DataFrame, key: str, value: str, order: str, alpha: float = ALPHA) -> DataFrame:
    """(key, n, ema) after each micro-batch: the moving average lives in the state store.

    The rows of a batch are taken in their order; the state is two numbers for a key.
    """
    kind = {f.name: f.dataType.simpleString() for f in stream.schema.fields}[key]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.0)
        rows = pd.concat(parts).sort_values([order, value], kind="stable")[value].dropna().to_numpy(float)
        if len(rows):
            a, b, first = affine_ema(rows, alpha)
            n, mean = n + len(rows), first if n == 0 else a * mean + b
        state.update((n, mean))
        yield pd.DataFrame({key: [k[0]], "n": [n], "ema": [mean]})

    return stream.select(key, value, order).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)
