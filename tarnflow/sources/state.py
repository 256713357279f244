"""State as tables: last good items, selector locks, history events and page snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.sources.versions import VersionedParts

LOCKS = "source string, field string, field_order int, css string, attr string, fallbacks array<struct<css:string,attr:string>>, status string, confirm_runs int, heal_count int, value_shape string, samples array<string>, match_count_ema double, null_rate_ema double, len_mean double, tag string, class_tokens array<string>, ancestor_sig string"
RING = 5


def save_last_good(items: DataFrame, path: str) -> None:
    """Replace the items of the sources in ``items`` and no others, in one step for readers."""
    VersionedParts(items.sparkSession, path).put(items)


def last_good(spark: SparkSession, path: str, source: str) -> DataFrame | None:
    """The stored items of a source, marked as stale; None where there are none."""
    found = VersionedParts(spark, path).read(source)
    return None if found is None else found.withColumn("stale", F.lit(True))


def has_last_good(spark: SparkSession, path: str, source: str) -> bool:
    return source in VersionedParts(spark, path).parts()


def sources_with_last_good(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in VersionedParts(spark, path).parts()], "source string")


def save_locks(locks: list[dict], path: str, spark: SparkSession, item: str | None = None, content_len: float | None = None) -> None:
    """Replace the locks of the sources in ``locks`` and no others, in one step for readers; each row carries its source's item selector and mean length."""
    rows = spark.createDataFrame(locks, LOCKS).withColumns({"item_selector": F.lit(item).cast("string"), "content_len_ema": F.lit(content_len).cast("double")})
    VersionedParts(spark, path).put(rows)


def load_locks(spark: SparkSession, path: str, source: str) -> tuple[list[dict], str | None, float | None]:
    """(locks in the fields' order, item selector, mean length) of a source; no locks where it is not compiled."""
    rows = VersionedParts(spark, path).read(source)
    found = rows.orderBy("field_order").collect() if rows is not None else []
    locks = [{k: v for k, v in r.asDict(recursive=True).items() if k not in ("item_selector", "content_len_ema")} for r in found]
    return locks, found[0]["item_selector"] if found else None, found[0]["content_len_ema"] if found else None


def save_snapshots(pages: DataFrame, path: str, run: str) -> None:
    """The pages of a good run as one folder ``run=RUN``; only the newest RING runs stay."""
    pages.write.mode("overwrite").parquet(f"{path}/run={run}")
    spark = pages.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    kept = sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().startswith("run="))
    for old in kept[:-RING]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)


def append_history(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, with the time of writing."""
    events.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).write.mode("append").json(path)


def read_history(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """Events in order of time; lines that are no JSON are left out."""
    out = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return (out.where(F.col("field") == field) if field else out).orderBy("ts")


def ring_buffer(rows: DataFrame, key: str, order: str, ordinal: str, size: int = RING) -> DataFrame:
    """The newest ``size`` rows of each key.

    A key's candidates are cut down in each input partition before the shuffle
    (the window below is planned as a limit by group), so a hot key is no burden.
    """
    newest = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col(ordinal).desc())
    return rows.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= size)


def write_jsonl(items: DataFrame, path: str, flat: bool = True) -> None:
    """One item for each line, or one envelope (source, count, items) for each source."""
    if not flat:
        fields = [c for c in items.columns if c != "source"]
        items = items.groupBy("source").agg(F.count(F.lit(1)).alias("count"), F.collect_list(F.struct(*fields)).alias("items"))
    items.write.mode("append").json(path)
