"""Benchmark decontamination by winnowing.

Of every run of ``w`` consecutive k-gram hashes the least (the rightmost of
equals) is kept as a fingerprint.  Two texts that share ``k + w - 1`` words share
such a run and therefore a fingerprint.  Fingerprints of the documents are
joined with those of the benchmark (hash semi-join inside the scan, against a
table of bounded size); each hit is extended to the windows around it, which are
compared word for word.

The benchmark is taken in blocks of bounded size; one block is the usual case
and needs no shuffle.  With more blocks the documents are read once for each and
their spans merged by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import ALNUM, bounded_batches, grams, id_and_text, text_steps, written

WINDOW_WORDS, GRAM_WORDS = 10, 5
#: Benchmark text that one block holds (the bound of what is broadcast).
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, text_hash long, n_words long, spans array<struct<first:int,stop:int>>, items array<string>"


def fingerprints(words: np.ndarray, doc: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the winnowed k-grams of texts laid end to end, for shared spans of t words."""
    k = min(GRAM_WORDS, t)
    w = t - k + 1
    h = grams(words, k)
    n = len(words) - t + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.flatnonzero(doc[:n] == doc[t - 1 :])  # windows inside one text
    best, at = h[start], start.copy()
    for j in range(1, w):
        other = h[start + j]
        less = other <= best
        best, at = np.where(less, other, best), np.where(less, start + j, at)
    at = np.unique(at)
    return at, h[at]


class BenchmarkIndex:
    """Windows of a block of items by their words, and the fingerprints of each window length."""

    def __init__(self, items: list[tuple[str, str]]):
        self.windows: dict[int, dict[bytes, list[str]]] = {}
        for item, text in items:
            data = np.frombuffer(text.encode(), np.uint8)
            _, start, stop, _ = ALNUM.hashed(data, np.array([len(data)]))
            words = [text.encode()[a:b].lower() for a, b in zip(start.tolist(), stop.tolist())]
            if words:
                t = min(WINDOW_WORDS, len(words))
                by_words = self.windows.setdefault(t, {})
                for key in {b" ".join(words[i : i + t]) for i in range(len(words) - t + 1)}:
                    by_words.setdefault(key, []).append(item)
        self.prints: dict[int, np.ndarray] = {}
        for t, by_words in self.windows.items():
            # a window's own fingerprint is one of its text's, and the other way round
            keys = sorted(by_words)
            data = np.frombuffer(b"\n".join(keys), np.uint8)
            ends = np.cumsum([len(k) + 1 for k in keys]) - 1
            words, _, _, doc = ALNUM.hashed(data, ends)
            self.prints[t] = np.unique(fingerprints(words, doc, t)[1])

    def hits(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]], set[str]]]:
        """(row, words, merged spans of hit words, items) of each text."""
        words, start, stop, doc = ALNUM.hashed(data, ends)
        cuts = np.searchsorted(doc, np.arange(len(ends) + 1))
        tries: dict[int, list[tuple[int, int]]] = {}
        for t, prints in self.prints.items():
            at, h = fingerprints(words, doc, t)
            if len(prints) and len(at):
                at = at[prints[np.minimum(np.searchsorted(prints, h), len(prints) - 1)] == h]
                before = t - min(GRAM_WORDS, t)
                first = np.unique(at[:, None] - np.arange(before + 1)[None, :])
                first = first[(first >= 0) & (first + t <= len(words))]
                first = first[doc[first] == doc[first + t - 1]]
                for i in first.tolist():
                    tries.setdefault(int(doc[i]), []).append((i, t))
        for r in range(len(ends)):
            spans: list[tuple[int, int]] = []
            items: set[str] = set()
            if r in tries:
                base = int(cuts[r])
                text = [data[a:b].tobytes().lower() for a, b in zip(start[base : cuts[r + 1]].tolist(), stop[base : cuts[r + 1]].tolist())]
                for i, t in sorted(tries[r]):
                    if found := self.windows[t].get(b" ".join(text[i - base : i - base + t])):
                        items.update(found)
                        if spans and i - base <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(spans[-1][1], i - base + t))
                        else:
                            spans.append((i - base, i - base + t))
            yield r, int(cuts[r + 1] - cuts[r]), spans, items


def _against(docs: DataFrame, items: list[tuple[str, str]]) -> tuple[DataFrame, Broadcast]:
    sent = docs.sparkSession.sparkContext.broadcast(BenchmarkIndex(items))
    span = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, ends in text_steps(batch):
                found = list(sent.value.hits(data, ends))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([n for _, n, _, _ in found], pa.int64()), pa.array([[{"first": a, "stop": b} for a, b in s] for _, _, s, _ in found], span), pa.array([sorted(x) for _, _, _, x in found], pa.list_(pa.string()))],
                    ["doc_id", "text_hash", "n_words", "spans", "items"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(matched, SCHEMA), sent


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """(number of blocks, items) of each block of bounded size (at least one); a block is read when it is asked for."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("item IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        yield blocks, [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()]


def benchmark_hits(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans of hit words and the items with occurring windows, for every row.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.
    A window is WINDOW_WORDS consecutive words of an item; a shorter item is one
    window.  Null and empty texts have no words; items without words, null items
    and an empty benchmark hit nothing.  Repeated rows stay repeated.
    """
    docs = id_and_text(df, id_col, text_col)
    whole, blocks = None, 1
    for blocks, items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        part, sent = _against(docs, items)
        if blocks == 1:
            return part.drop("text_hash")
        part = written(part)  # driver and tasks hold one block at a time
        sent.destroy()
        whole = part if whole is None else whole.union(part)
    whole = whole.groupBy("doc_id", "text_hash", "n_words").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.count(F.lit(1)).alias("rows"))
    merged = F.expr("""aggregate(all, cast(array() AS array<struct<first:int,stop:int>>), (m, s) ->
        CASE WHEN size(m) > 0 AND s.first <= element_at(m, -1).stop
             THEN concat(slice(m, 1, size(m) - 1), array(named_struct('first', element_at(m, -1).first, 'stop', greatest(element_at(m, -1).stop, s.stop))))
             ELSE concat(m, array(s)) END)""")
    times = F.expr(f"explode(sequence(1, int(rows / {blocks})))")
    return whole.select("doc_id", "n_words", merged.alias("spans"), "items", times.alias("nth")).drop("nth")


def contamination(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, from :func:`benchmark_hits`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``df`` without any window of the benchmark, with all their columns; filtered inside the scan, block after block."""
    df = bounded_batches(df)
    for blocks, items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = df.sparkSession.sparkContext.broadcast(BenchmarkIndex(items))

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for i, _, data, ends in text_steps(batch, text_col):
                    for r, _, spans, _ in sent.value.hits(data, ends):
                        keep[i + r] = not spans
                yield batch.filter(pa.array(keep))

        df = df.mapInArrow(clean, df.schema)
        if blocks > 1:
            df = written(df)  # driver and tasks hold one block at a time
            sent.destroy()
    return df
