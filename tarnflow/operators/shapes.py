"""Value shapes, selector robustness, similarity of node signatures and moving averages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE_CHARS, ALPHA = 120, 0.3
# The classes of a shape and the characters that a pattern escapes.
SHAPE_CLASSES = ((r"\d+", "\ue000", r"\d+"), (r"\p{L}+", "\ue001", r"[^\W\d_]+"), (r"(?U)\s+", "\ue002", r"\s+"))
ESCAPED = r"([#\-.()\[\]{}*+?^$|\\&~])"
HASH_LIKE = r"\.(?=(?:css-|sc-|[\w-]*[a-f0-9]{6,}(?![\w-])|[a-z]+-[A-Za-z0-9]{5,8}(?![\w-])))[\w-]+"


def value_shape(text: Column) -> Column:
    """An anchored pattern: runs of digits, letters and spaces become their class, other signs stay."""
    out = F.substring(text, 1, SHAPE_CHARS)
    for pattern, sign, _ in SHAPE_CLASSES:
        out = F.regexp_replace(out, pattern, sign)
    out = F.regexp_replace(out, ESCAPED, r"\\$1")
    for _, sign, written in SHAPE_CLASSES:
        out = F.replace(out, F.lit(sign), F.lit(written))
    return F.concat(F.lit("^"), out, F.lit("$"))


def most_frequent(df: DataFrame, keys: list[str], value: str, ordinal: str, name: str) -> DataFrame:
    """For each group the value that occurs most; of equals the one seen first.  Counts are pre-aggregated."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(ordinal).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_n", (-F.col("_first")).alias("_o"))).alias(name))


def shape_ratio(text: Column, pattern: Column) -> Column:
    """Aggregate: the share of non-null texts that match; 1 without texts or without a pattern."""
    hit = F.regexp_like(text, F.concat(F.lit("(?U)"), pattern))
    return F.coalesce(F.avg(F.when(text.isNotNull(), hit.cast("double"))), F.lit(1.0))


def jaccard(one: Column, two: Column) -> Column:
    """Similarity of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(one, two))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(one, two)) / union)


def node_similarity(tag: Column, classes: Column, ancestors: Column, old_tag: Column, old_classes: Column, old_ancestors: Column) -> Column:
    """0.4 for the tag, 0.4 of the classes' and 0.2 of the ancestors' similarity; 0 without a node."""
    lists = [F.filter(F.split(a, "<"), lambda x: x != "") for a in (ancestors, old_ancestors)]
    score = 0.4 * (tag == old_tag).cast("double") + 0.4 * jaccard(classes, old_classes) + 0.2 * jaccard(*lists)
    return F.coalesce(score, F.lit(0.0))


def robustness(css: Column) -> Column:
    """0 to 1: deep, positional, hash-like and bare selectors lose, ids gain."""
    depth = F.regexp_count(css, F.lit("[> ]"))
    nth, hashed = F.regexp_count(css, F.lit(":nth-(child|of-type)")), F.regexp_count(css, F.lit(HASH_LIKE))
    score = F.lit(1.0) - F.when(depth > 6, 0.3).otherwise(0.0) - 0.2 * nth - 0.4 * hashed + F.when(css.rlike(r"#|\[id\^?="), 0.05).otherwise(0.0) - F.when(css.rlike(r"[.#\[]"), 0.0).otherwise(0.35)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def ema(values: Column, alpha: float = ALPHA) -> Column:
    """Exponential moving average of an array in its order; the first value starts it."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(alpha * x + (1 - alpha) * a))


def affine_ema(x: np.ndarray, alpha: float) -> tuple[float, float, float]:
    """(a, b, c): a run of values takes an average m to a * m + b, and is c where it is the first.

    Steps m -> alpha * x + (1 - alpha) * m compose to one of the same form, so runs
    are summed up anywhere and put together in their order.
    """
    decay = (1 - alpha) ** np.arange(len(x) - 1, -1, -1.0)
    b = alpha * float(decay @ x)
    return (1 - alpha) ** len(x), b, b + (1 - alpha) * float(decay[0]) * float(x[0])


def ema_by_key(df: DataFrame, key: str, value: str, order: str, alpha: float = ALPHA) -> DataFrame:
    """(key, n, ema) of each key's values that are not null, in order; the first value starts the average.

    Rows are range-partitioned by key and order, so a key of any size lies in as
    many tasks as its rows ask for; each task sums up its run of a key as one
    affine step, and a key's few steps are put together in their order.  Values of
    equal order are taken by size.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = batch.column(0)
            codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy()
            x = batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1)) if len(codes) else []
            parts = [affine_ema(p, alpha) for p in np.split(x, cuts[1:])] if len(cuts) else []
            out = [keys.take(pa.array(cuts, pa.int64())), pa.array([part] * len(parts), pa.int64()), pa.array(range(nth, nth + len(parts)), pa.int64()), pa.array(np.diff(np.append(cuts, len(x))), pa.int64()), *(pa.array([p[i] for p in parts], pa.float64()) for i in range(3))]
            nth += len(parts)
            yield pa.RecordBatch.from_arrays(out, ["k", "part", "nth", "n", "a", "b", "c"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("x"), F.col(order).alias("o")).where("x IS NOT NULL")
    ordered = rows.repartitionByRange("k", "o", "x").sortWithinPartitions("k", "o", "x").select("k", "x")
    steps = ordered.mapInArrow(runs, f"k {kind}, part long, nth long, n long, a double, b double, c double")
    whole = steps.groupBy("k").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "nth", "a", "b", "c"))).alias("steps"))
    mean = F.aggregate("steps", F.lit(None).cast("double"), lambda m, s: F.when(m.isNull(), s["c"]).otherwise(s["a"] * m + s["b"]))
    return whole.select(F.col("k").alias(key), "n", mean.alias("ema"))
