"""Token ids as ORC files: integer run-length encoded ids, row indexes, Bloom filters on ids.

Documents are range-partitioned and sorted by id, so files and their stripes
hold disjoint, ascending id ranges: row-group statistics and Bloom filters prune
a lookup to a few stripes, and any reader can take stripes in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.llm.shared import id_and_text, scratch
from tarnflow.llm.tokens import encoder

END_ID = 2
STRIPE_BYTES, ROW_INDEX_STRIDE = 16 << 20, 1000
#: Ids that :func:`lookup` pushes down to the files.
LOOKED_UP = 100
FILE_SCHEMA = "doc_id long, part int, n long, ids array<int>"


def write_token_files(df: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write ORC files under ``path``, ascending by id.

    Column ``part`` numbers the files' ranges in id order, ``n`` counts a
    document's ids.  Null texts are empty
    (one id, the end).  Rows with a null id come first; repeated ids stay, in
    the order of their texts.  An empty table writes no rows.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer, True), TaskContext.get().partitionId()
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1).to_pylist()
            some, size, at = [], 0, 0
            for n, ids in enumerate(enc.stream(texts), 1):
                some.append(ids)
                size += len(ids)
                if size > 2_000_000 or n == len(texts):
                    flat = np.insert(np.concatenate(some), np.cumsum([len(x) for x in some]), end_id).astype(np.int32)
                    offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in some])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([docs.slice(at, n - at), pa.array(np.full(n - at, part, np.int32)), pa.array(np.diff(offsets).astype(np.int64)), lists], ["doc_id", "part", "n", "ids"])
                    some, size, at = [], 0, n

    ordered = id_and_text(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    writer = ordered.mapInArrow(encoded, FILE_SCHEMA).write
    for k, v in {"compression": "zstd", "orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": ROW_INDEX_STRIDE, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}.items():
        writer = writer.option(k, v)
    writer.orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, ids: Sequence[int] | DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids of the documents asked for; ids that no document has give no row, repeated documents give one row each.

    A few ids are a filter that reaches the files: whole files and stripes go by
    their statistics, row groups by the row index and the Bloom filter.  More ids
    than LOOKED_UP, or a table of them (one row for each id, nulls ignored), are
    joined.
    """
    rows = read_token_files(spark, path).select("doc_id", "ids")
    if isinstance(ids, DataFrame):
        return rows.join(ids.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
    wanted = sorted(set(ids))
    if len(wanted) > LOOKED_UP:
        return lookup(spark, path, spark.createDataFrame([(i,) for i in wanted], "doc_id long"))
    return rows.where(F.col("doc_id").isin(wanted)) if wanted else rows.where(F.lit(False))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files.

    Only one narrow row for a document is shuffled; the single ordered pass is
    over one row for each file range.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            flat = memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "n_tokens", "ids_crc32"])

    files = read_token_files(spark, path)
    rows = files.select("doc_id", "part", "ids").mapInArrow(measured, "doc_id long, part int, n_tokens long, ids_crc32 long")
    sums = files.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(F.broadcast(starts), "part")  # one row for each partition that was written
        .select("doc_id", (F.col("part_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def tokenise_to_orc(df: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the token files (to shared scratch space unless a path is given) and return their index."""
    spark = df.sparkSession
    path = path or scratch(spark)
    write_token_files(df, path, tokenizer)
    return token_index(spark, path)
