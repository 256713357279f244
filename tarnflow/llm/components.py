"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import written

MAX_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the links (long columns a, b).

    Links of a node with itself are ignored; repeated and reversed ones do no
    harm; an empty table gives an empty one.  Each round's links are written to
    shared storage; counts and a checksum, never links, reach the driver.
    """
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs = written(pairs)
    state = _state(pairs)
    for _ in range(MAX_ROUNDS):
        # large star: every larger neighbour of u is linked with u's smallest neighbour
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: u and its smaller neighbours are linked with the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        new = written(small.union(least.select(F.col("m").alias("a"), "b")).distinct())
        was, state, pairs = state, _state(new), new
        if was == state:
            break
    else:
        raise RuntimeError("components do not settle")
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("component")).union(pairs.select("a", "a").distinct())
