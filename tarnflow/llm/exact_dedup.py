"""Exact deduplication by content sort (DataFrame functions only).

Rows are range-partitioned on sampled splitters of their normalised bytes and
sorted externally inside each partition, so equal texts are adjacent; a window
over the full text then compares neighbours byte for byte.  The splitter key is
a short prefix of the text followed by its hash, so that a prefix which many
texts share is split too and the sample that reaches the driver stays small.

A text that very many rows share would land in one partition.  Such hot texts
are found beforehand by counting hashes of all rows (narrow, pre-aggregated);
their rows are dealt to as many salted runs as their count asks for, and the
runs are merged in a second, small aggregation on the full text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: At most this many texts can be hot: a hot text has over 1/MAX_HOT of all rows.
MAX_HOT = 1000
#: No text with fewer rows than this is hot.
LEAST_HOT = 64
#: Characters of the text in the splitter key.
PREFIX_CHARS = 24


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None) -> DataFrame:
    """All rows and columns of ``df`` and, beside them, what became of each row.

    Adds ``keep_id`` (the largest id of the rows with an equal text),
    ``group_size``, ``kept`` and ``text_sha256``.  ``normalise``: Column ->
    Column, applied before texts are compared (default: none).

    Null texts are empty texts and equal to each other.  Rows with a null id are
    kept only where their whole group has none.  Of repeated rows (same id and
    text) exactly one is kept.  An empty table gives an empty result.  Columns
    of ``df`` that bear an added name are replaced.
    """
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = df.drop("keep_id", "group_size", "kept", "text_sha256")
    p = "_cs"
    while any(c.lower().startswith(p) for c in df.columns):  # no column of ``df`` is written over
        p += "_"
    keyed = df.withColumn(p + "_text", normalise(text) if normalise else text).withColumn(p + "_hash", F.xxhash64(p + "_text")).withColumn(p + "_id", F.col(id_col).cast("long"))

    limit = max(LEAST_HOT, -(-df.count() // MAX_HOT))
    hot = keyed.groupBy(p + "_hash").count().where(F.col("count") > limit).select(p + "_hash", F.ceil(F.col("count") / limit).alias(p + "_runs"))
    salted = keyed.join(F.broadcast(hot), p + "_hash", "left").withColumn(p + "_salt", F.when(F.col(p + "_runs").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(p + "_id", F.lit(7)), F.col(p + "_runs"))).cast("long"))

    place = [p + "_prefix", p + "_hash", p + "_salt"]
    order = [*place, p + "_text", F.col(p + "_id").desc_nulls_last()]
    dealt = salted.withColumn(p + "_prefix", F.substring(p + "_text", 1, PREFIX_CHARS)).repartitionByRange(*place).sortWithinPartitions(*order)
    run = Window.partitionBy(*place, p + "_text").orderBy(F.col(p + "_id").desc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    compared = dealt.select(
        "*",
        F.row_number().over(run).alias(p + "_nth"),
        F.first(p + "_id").over(whole).alias(p + "_most"),
        F.count(F.lit(1)).over(whole).alias(p + "_n"),
        F.sha2(F.col(p + "_text"), 256).alias("text_sha256"),
    )

    runs = compared.where((F.col(p + "_salt") > 0) & (F.col(p + "_nth") == 1))
    merged = runs.groupBy(p + "_text").agg(F.max(p + "_most").alias(p + "_hot_most"), F.sum(p + "_n").alias(p + "_hot_n"), F.first("text_sha256").alias("text_sha256"), F.first(p + "_hash").alias(p + "_hash")).drop(p + "_text")
    out = compared.join(F.broadcast(merged), [p + "_hash", "text_sha256"], "left")
    out = out.withColumn("keep_id", F.coalesce(p + "_hot_most", p + "_most")).withColumn("group_size", F.coalesce(p + "_hot_n", p + "_n"))
    nulls_run = F.when(F.col(p + "_id").isNull() & (F.col(p + "_salt") > 0), F.col("keep_id").isNull()).otherwise(F.lit(True))
    out = out.withColumn("kept", (F.col(p + "_nth") == 1) & F.col(p + "_id").eqNullSafe(F.col("keep_id")) & nulls_run)
    return out.select(*df.columns, "keep_id", "group_size", "kept", "text_sha256")
