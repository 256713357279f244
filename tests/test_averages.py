"""Moving averages of keys of any size."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tarnflow.operators import shapes


def plain(values, alpha=0.3):
    mean = None
    for x in values:
        mean = x if mean is None else alpha * x + (1 - alpha) * mean
    return mean


def test_affine_steps_compose():
    draw = np.random.default_rng(2)
    x = draw.normal(size=500)
    a, b, c = shapes.affine_ema(x[:1], 0.3)
    mean = c
    for part in np.split(x[1:], [1, 7, 200, 201]):
        a, b, _ = shapes.affine_ema(part, 0.3)
        mean = a * mean + b
    assert abs(mean - plain(x)) < 1e-12 and abs(shapes.affine_ema(x, 0.3)[2] - plain(x)) < 1e-12


def test_ema_by_key(spark):
    draw = np.random.default_rng(1)
    rows = [(f"k{draw.integers(0, 3)}" if i % 3 else "hot", i, float(draw.normal()) if i % 11 else None) for i in range(6000)] + [(None, 1, 5.0), ("one", 1, 2.0), ("none", 1, None)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "o", "x"]).astype({"x": float}), "k string, o long, x double").withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(7)
    got = {r.k: (r.n, r.ema) for r in shapes.ema_by_key(df, "k", "x", "o").collect()}
    for key in {r[0] for r in rows} - {"none"}:
        values = [x for k, _, x in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]) if x is not None]
        assert got[key][0] == len(values) and abs(got[key][1] - plain(values)) < 1e-12
    assert "none" not in got and shapes.ema_by_key(df.where("false"), "k", "x", "o").collect() == []


def test_a_key_of_many_rows_lies_in_all_tasks(spark):
    df = spark.range(2_000_000).select(F.lit("k").alias("k"), F.col("id").alias("o"), (F.col("id") % 1000).cast("double").alias("x"))
    got = shapes.ema_by_key(df, "k", "x", "o")
    assert got.first().n == 2_000_000 and abs(got.first().ema - plain([float(i % 1000) for i in range(1_999_000, 2_000_000)])) < 1e-9
    spread = df.repartitionByRange("k", "o", "x").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 500_000
