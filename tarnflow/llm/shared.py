"""Helpers that several operators use: table reading, shared scratch space and
vectorised word hashing inside Arrow tasks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles; bounds the numpy temporaries.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch of whole texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session is told to hand texts to Python in batches of bounded bytes (smaller settings stay)."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None) or "0"
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; null text is empty."""
    return bounded_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The folder is ``spark.checkpoint.dir``; only where it is unset and Spark runs
    on one machine (tests) a temporary folder is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tarnflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tarnflow/{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """The same rows, read back from a Parquet table in shared storage; ``by``: columns that it is partitioned by.

    Cuts the lineage in a way that survives lost executors.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the shuffle files of a query when it has ended and not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def dropped(df: DataFrame) -> None:
    """Delete the table of :func:`written` that ``df`` reads, when all that needs it has been written."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def frequent_head(df: DataFrame, count: str, size: Column, max_rows: int, max_bytes: int) -> tuple[Column, bool]:
    """(which rows have the highest counts, whether that is all of them): as many as both bounds allow, so they can be broadcast.

    Rows are taken by levels of their count, sixteen to each doubling; a level
    that goes beyond a bound is left out as a whole, and so are all below it.
    """
    level = F.floor(F.log2(count) * 16)
    sizes = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size")).orderBy(F.desc("level")).collect()
    rows = held = 0
    cut = None
    for row in sizes:
        rows, held = rows + row.n, held + row["size"]
        if rows > max_rows or held > max_bytes:
            return (level >= cut if cut is not None else F.lit(False)), False
        cut = row.level
    return F.lit(True), True


def memory_returned() -> None:
    """Hand what a task has freed back to the system: Spark keeps its worker for the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


# ---------------------------------------------------------------- word hashing

_MIX1, _MIX2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BYTE = np.random.RandomState(20240229).randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

_BASE2 = 0xD1342543DE82EF95
_BYTE2 = np.random.RandomState(20250817).randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int, key: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= 8 * STEP_BYTES:
            _powers[key] = have
    return have[:n]


powers = _power
#: (value of each byte, base, key of the base's powers) of two independent hashes of byte strings.
BASES = ((_BYTE, _BASE, "up"), (_BYTE2, _BASE2, "up2"))


class Places:
    """Places of 64-bit hashes in a sorted array of them, which an index over their first bits leads to."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        counts = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32)
        self.tries = int(counts.max())
        self.keys = np.append(keys, np.uint64(0))  # one more, so that every place can be looked at

    def __len__(self) -> int:
        return len(self.keys) - 1

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1: it is not there."""
        n = len(self)
        out = np.full(len(keys), -1, np.int32)
        at, left = self.first[(keys >> self.shift).astype(np.int64)], None  # None: all
        for _ in range(self.tries):
            its, asked = self.keys[at], keys if left is None else keys[left]
            inside = at < n
            hit = np.flatnonzero((its == asked) & inside)
            out[hit if left is None else left[hit]] = at[hit]
            more = np.flatnonzero((its < asked) & inside)
            if not len(more):
                break
            at, left = at[more] + np.int32(1), more if left is None else left[more]
        return out


class WordRule:
    """Words are maximal runs of the bytes that are not separators, A-Z lower-cased.

    Bytes from 0x80 are word bytes, so the rule is the same on UTF-8 bytes and
    on characters.
    """

    def __init__(self, separators: bytes):
        code = np.arange(256)
        code[65:91] += 32
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        self.value = np.where(self.is_word, _BYTE[code], np.uint64(0))

    def hashed(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first byte, end byte, document) of each word of documents laid end to end."""
        empty = np.zeros(0, np.int64)
        if not len(data):
            return np.zeros(0, np.uint64), empty, empty, empty
        inside = self.is_word[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = ends[ends < len(data)]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = cuts[cuts > 0] - 1
        last[cuts] = inside[cuts]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.cumsum(self.value[data] * _power(_BASE, len(data), "up"), dtype=np.uint64)
        before = np.where(start > 0, total[start - 1], np.uint64(0))
        raw = (total[stop - 1] - before) * _power(pow(_BASE, -1, 1 << 64), len(data), "down")[start]
        return mix(raw), start, stop, np.searchsorted(ends, start, side="right")


#: White space of ASCII separates words; all else is kept.
SPACED = WordRule(b" \t\n\x0b\x0c\r")
#: Runs of digits, letters and all non-ASCII characters.
ALNUM = WordRule(bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words of one sequence (empty when it is shorter)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mix(out ^ words[j : j + n])
    return out


def text_steps(batch: pa.RecordBatch, column: str = "text", step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, end offset of each row) over parts of a batch.

    A part has at most ``step`` bytes, or one row that is longer.
    """
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + step, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i + 1 : j + 1] - offs[i]
        i = j


def hashed_documents(batch: pa.RecordBatch, rule: WordRule) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of every row of a batch."""
    for i, j, data, ends in text_steps(batch):
        words, _, _, doc = rule.hashed(data, ends)
        cuts = np.searchsorted(doc, np.arange(j - i + 1))
        for r in range(j - i):
            yield i + r, words[cuts[r] : cuts[r + 1]]
