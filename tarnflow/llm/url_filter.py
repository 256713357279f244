"""URL rules by a Bloom filter cascade.

Every url has a small set of keys: each domain suffix of its host, joined with
the start of its path at each length that a rule's path has.  A rule fits
exactly when its own key is among them.  A cascade of Bloom filters tells listed
keys from all others of the corpus: level 1 holds the listed keys, level 2 the
keys of the corpus's complete key universe that level 1 takes wrongly, level 3
the listed keys that level 2 takes wrongly, and so on until none is left.  A key
of the universe is listed exactly when the first level without it is an even
one; no join against the list is needed to judge a url.

The first level is sized so that about as many keys pass it wrongly as the list
has; all levels together are then of the order of the list, whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import mix

Rule = tuple[str, str, str]  # verdict, host, path

RULES: list[Rule] = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

#: Probes of one key in a level, and the most levels a cascade may have.
PROBES, MAX_LEVELS = 3, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


class BloomLevel:
    """Bits of one level; its seed sets it apart from the others."""

    def __init__(self, bits: int, seed: int):
        self.bits, self.seed = max(64, bits), seed
        self.words = np.zeros((self.bits + 63) // 64, np.uint64)

    def _at(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        one = mix(hashes ^ np.uint64(mix(np.array([self.seed], np.uint64))[0]))
        two = mix(one) | np.uint64(1)
        for i in range(PROBES):
            yield (one + np.uint64(i) * two) % np.uint64(self.bits)

    def add(self, hashes: np.ndarray) -> None:
        for at in self._at(hashes):
            np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._at(hashes):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def cascade_has(levels: list[BloomLevel], hashes: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed: they leave the cascade at an even level, or at none of an odd number."""
    left = np.full(len(hashes), len(levels))
    alive = np.arange(len(hashes))
    for depth, level in enumerate(levels):
        inside = level.has(hashes[alive])
        left[alive[~inside]] = depth
        alive = alive[inside]
    return left % 2 == 1


def _sized(n: int, rate: float) -> int:
    """Bits of a level for n keys so that others pass at the given rate."""
    return math.ceil(-PROBES * max(n, 1) / math.log(1 - rate ** (1 / PROBES)))


def build_cascade(universe: DataFrame, listed: np.ndarray) -> list[BloomLevel]:
    """Levels for the listed hashes over the ``key_hash`` column of the complete key universe.

    Only keys that level 1 takes wrongly reach the driver: about as many as the
    list has by the choice of the level's size.  They are counted first, and the
    first level is enlarged until they are few.
    """
    listed = np.unique(listed)
    size = max(1, universe.agg(F.approx_count_distinct("key_hash")).first()[0])
    most = 16 * len(listed) + 1024
    rate = min(0.5, len(listed) / (math.sqrt(2) * size)) if len(listed) else 0.5
    while True:
        first = BloomLevel(_sized(len(listed), rate), 1)
        first.add(listed)

        def passed(batches: Iterator[pa.RecordBatch], first=first, listed=listed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                keys = np.unique(keys[first.has(keys)])
                keys = keys[~np.isin(keys, listed)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key_hash"])

        found = universe.select("key_hash").mapInArrow(passed, "key_hash long").distinct().limit(most + 1).collect()
        if len(found) <= most:
            break
        rate /= 16  # a larger first level: fewer pass
    levels, wrong = [first], np.array([r[0] for r in found], np.int64).view(np.uint64)
    inside, outside = wrong, listed
    while len(inside):
        if len(levels) == MAX_LEVELS:
            raise ValueError("the cascade does not end")
        level = BloomLevel(_sized(len(inside), 0.5), len(levels) + 1)
        level.add(inside)
        levels.append(level)
        inside, outside = outside[level.has(outside)], inside
    return levels


def filter_urls(df: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id_col``, host, path, rule (its key, like ``net/de/``; else null) and verdict of each url.

    A rule fits its host and all subdomains where the path starts with its own;
    the longest (host and path together, then host) wins.  Urls without a rule
    are not listed: ``default``.  Null urls and such without ``://`` have an
    empty host and path.  Repeated rows stay repeated; an empty table or an
    empty list of rules works.
    """
    rules = RULES if rules is None else rules
    verdicts = {host + path: verdict for verdict, host, path in rules}
    ranked = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1])), reverse=True)
    lengths = sorted({len(path) for _, _, path in rules})
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_uf_url"))
    host, path = host_and_path(F.col("_uf_url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))

    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths])) if lengths else F.array().cast("array<string>")
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, F.lit("\n"), p))))
    keyed = pages.withColumn("keys", F.array_distinct(pairs))
    hashes = F.transform("keys", lambda k: F.xxhash64(k))
    universe = keyed.select(F.explode(hashes).alias("key_hash"))

    spark = df.sparkSession
    names = [host + "\n" + path for _, host, path in ranked]
    listed = np.array([r[0] for r in spark.createDataFrame([(n,) for n in names], "k string").select(F.xxhash64("k")).collect()], np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(build_cascade(universe, listed))

    @F.pandas_udf("array<boolean>")
    def is_listed(column: pd.Series) -> pd.Series:
        sizes = column.map(len).to_numpy()
        flat = np.concatenate(column.to_list()).astype(np.int64).view(np.uint64) if sizes.sum() else np.zeros(0, np.uint64)
        return pd.Series(np.split(cascade_has(sent.value, flat), np.cumsum(sizes)[:-1]))

    judged = keyed.withColumn("listed", is_listed(hashes))
    fits = F.transform(F.filter(F.arrays_zip("keys", "listed"), lambda z: z["listed"]), lambda z: z["keys"])
    rank = lambda k: F.struct(F.length(k).alias("length"), F.length(F.substring_index(k, "\n", 1)).alias("host_length"), k.alias("key"))
    best = F.replace(F.array_max(F.transform(fits, rank))["key"], F.lit("\n"), F.lit(""))
    verdict = F.create_map(*[F.lit(x) for pair in verdicts.items() for x in pair])[F.col("rule")] if verdicts else F.lit(None).cast("string")
    return judged.withColumn("rule", best).select("page_id", "host", "path", "rule", F.coalesce(verdict, F.lit(default)).alias("verdict"))
