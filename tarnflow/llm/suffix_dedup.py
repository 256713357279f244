"""Repeated passages by sparse suffix arrays.

Suffixes are kept only at minimiser positions: of each run of ``GAP`` k-grams of
words the least hash is chosen (the rightmost of equals), so two copies of a
passage choose the same places.  A window of ``LEAST`` words has its place in its
first ``GAP`` words, and from there ``HEAD = LEAST - GAP + 1`` words follow.
Suffixes whose first HEAD words occur in one document only are dropped at once.

A kept suffix stands for the run of windows that have chosen it: the same head
with some words to its left and the rest to its right.  Suffixes are dealt out by
their head and sorted there by what each window has on both sides; neighbours
are compared, and equal ones of different documents are a match, which extends
left and right over all windows of the run that match.  So a word is in a passage
if, and only if, it lies in a window that another document has too, whatever the
number of copies, the edits around them, or the partitions.

A head that very many suffixes have (a line that whole corpora repeat) does not
go to one task: its suffixes are summed by their windows first, with partial sums
before the shuffle, and matches are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.shared import SPACED, dropped, grams, id_and_text, mix, text_steps, written

LEAST, GAP, GRAM = 50, 18, 8
HEAD = LEAST - GAP + 1
#: Suffixes of one head that go to one task at most (some MB); of more, the windows are summed.
HOT = 50_000
#: Suffixes that a task compares at once, where heads allow it.
STEP_ROWS = 200_000
_NONE = np.iinfo(np.int64).max


def runs_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, step = words.copy(), 1  # out: hash of runs of `step` words
    done, at = np.zeros(n, np.uint64), 0
    while step <= size:
        if size & step:
            done = mix(done ^ out[at : at + n])
            at += step
        if 2 * step > size:
            break
        out = mix(out[: len(out) - step] * np.uint64(0x9E3779B97F4A7C15) ^ out[step:])
        step *= 2
    return done


def chosen_places(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, place): first word of each window of LEAST words inside one text, and the place that it chooses."""
    n = len(words) - LEAST + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = grams(words, GRAM)
    start = np.flatnonzero(doc[:n] == doc[LEAST - 1 :])
    best, at = h[start], start.copy()
    for j in range(1, GAP):
        less = h[start + j] <= best
        best, at = np.where(less, h[start + j], best), np.where(less, start + j, at)
    return start, at


def _suffixes(docs: DataFrame) -> DataFrame:
    """(head, doc_id, at) of the kept suffixes, written."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, ends in text_steps(batch):
                words, _, _, doc = SPACED.hashed(data, ends)
                at = np.unique(chosen_places(words, doc)[1])
                heads = runs_of(words, HEAD)[at]
                first = np.searchsorted(doc, np.arange(len(ends)))
                yield pa.RecordBatch.from_arrays([pa.array(heads.view(np.int64)), pa.array(names[i + doc[at]], pa.int64()), pa.array((at - first[doc[at]]).astype(np.int32))], ["head", "doc_id", "at"])

    return written(docs.mapInArrow(found, "head long, doc_id long, at int"))


def _with_windows(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(head, hot, doc_id, first, windows) of the suffixes at ``places``: the hashes of the windows that chose them, as bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lists = batch.column(0).to_numpy(), batch.column(2)
            for i, j, data, ends in text_steps(batch):
                words, _, _, doc = SPACED.hashed(data, ends)
                start, at = chosen_places(words, doc)
                first = np.searchsorted(doc, np.arange(j - i + 1))
                part = lists.slice(i, j - i)
                row = np.repeat(np.arange(j - i), part.value_lengths().to_numpy())
                here = part.flatten()
                head, want, hot = (here.field(k).to_numpy(zero_copy_only=False) for k in ("head", "at", "hot"))
                want = want + first[row]
                order = np.argsort(want, kind="stable")
                head, want, hot = head[order], want[order], hot[order]
                # places of this text; one of another text with the same id is not, or has another head
                a, b = np.searchsorted(at, want), np.searchsorted(at, want, side="right")
                have = runs_of(words, HEAD).view(np.int64)
                keep = (b > a) & (have[np.minimum(want, max(len(have) - 1, 0))] == head if len(have) else False)
                a, b, head, hot, row = a[keep], b[keep], head[keep], hot[keep], row[order][keep]
                windows = runs_of(words, LEAST)[start] if len(start) else np.zeros(0, np.uint64)
                flat = windows.tobytes()
                keys = [flat[8 * x : 8 * y] for x, y in zip(a.tolist(), b.tolist())]
                begin = (start[a] - first[row]).astype(np.int32) if len(a) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(head, pa.int64()), pa.array(hot, pa.bool_()), pa.array(names[i + row], pa.int64()), pa.array(begin), pa.array(keys, pa.binary())], ["head", "hot", "doc_id", "first", "windows"])

    by_doc = places.groupBy("doc_id").agg(F.collect_set(F.struct("head", "at", "hot")).alias("places"))
    return docs.join(by_doc, "doc_id").select("doc_id", "text", "places").mapInArrow(cut, "head long, hot boolean, doc_id long, first int, windows binary")


def matching(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each row the least other document with an equal key, or a largest number where there is none."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])  # neighbours are compared
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    least = d[first]
    second = np.minimum.reduceat(np.where(d == least[group], _NONE, d), first)
    out = np.empty(len(doc), np.int64)
    out[order] = np.where(d == least[group], second[group], least[group])
    return out


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by head -> (doc_id, first, stop, partner) of those that match."""

    def compared(rows: pa.Table) -> pa.RecordBatch:
        doc, first = rows["doc_id"].to_numpy(), rows["first"].to_numpy().astype(np.int64)
        windows = rows["windows"].combine_chunks()
        size = np.diff(np.frombuffer(windows.buffers()[1], np.int32)[windows.offset : windows.offset + len(windows) + 1]) // 8
        key = np.frombuffer(b"".join(windows.to_pylist()), np.uint64)
        row = np.repeat(np.arange(len(doc)), size)
        ends = np.cumsum(size)
        nth = np.arange(len(key)) - (ends - size)[row]
        partner = matching(doc[row], key)
        hit = np.flatnonzero(partner != _NONE)
        row, nth, partner = row[hit], nth[hit], partner[hit]
        start = np.flatnonzero(np.diff(row, prepend=-1))
        if not len(start):
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64())], ["doc_id", "first", "stop", "partner"])
        at = row[start]
        cols = [doc[at], first[at] + np.minimum.reduceat(nth, start), first[at] + np.maximum.reduceat(nth, start) + LEAST, np.minimum.reduceat(partner, start)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "first", "stop", "partner"])

    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        head = batch.column(0).to_numpy()
        if size >= STEP_ROWS and (waiting[-1].column(0)[-1].as_py() != head[-1]):
            cut = int(np.argmax(head != waiting[-1].column(0)[-1].as_py()))  # rows of the last head still belong to what waits
            yield compared(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
            batch, waiting, size = batch.slice(cut), [], 0
        waiting.append(batch)
        size += len(batch)
    if waiting:
        yield compared(pa.Table.from_batches(waiting))


def _two_least(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, doc_id) of the two least documents of each key; tasks hand on two rows of a key at most."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id"))
    return docs.select(*keys, "doc_id").distinct().withColumn("nth", nth).where("nth <= 2").drop("nth")


def _hot_matches(rows: DataFrame) -> DataFrame:
    """The same of the rows (head, doc_id, first, windows) of hot heads, with the two least documents of equal windows."""
    runs = _two_least(rows, "head", "windows")
    hexed = F.hex("windows")
    keys = F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("windows") / 8).cast("int") - 1), lambda k: F.substr(hexed, k * 16 + 1, F.lit(16))))
    each = runs.select("head", "windows", "doc_id", keys.alias("nth", "key"))
    least = _two_least(each, "head", "key").groupBy("head", "key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("second")).where("least <> second")
    both = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("least", "second"))))), 1, 2)  # of the few windows of a run
    hits = each.select("head", "windows", "nth", "key").distinct().join(least, ["head", "key"]).groupBy("head", "windows").agg(F.min("nth").alias("a"), F.max("nth").alias("b"), both.alias("both"))
    partner = F.when(F.col("doc_id") != F.col("both")[0], F.col("both")[0]).otherwise(F.col("both")[1])
    return rows.join(hits, ["head", "windows"]).select("doc_id", (F.col("first") + F.col("a")).cast("long").alias("first"), (F.col("first") + F.col("b") + LEAST).cast("long").alias("stop"), partner.alias("partner"))


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, n_words, partner_id and is_later of each passage that another document repeats.

    Words are separated by ASCII white space and compared with A-Z lower-cased.
    A word is in a passage if it lies in LEAST consecutive words that another
    document has too (compared by 64-bit hashes of all these words); passages
    that touch are joined.  ``partner_id`` is a document that has some of it: the
    least one where that is another than this; ``is_later`` says that it is a
    smaller one, so that the passage can be cut here.  Null, empty and short
    texts have none, nor have rows with a null id; rows that share an id count as
    one document, with word places of each of their texts.  An empty table gives
    an empty result.
    """
    docs = id_and_text(df, id_col, text_col).where("doc_id IS NOT NULL")
    suffixes = _suffixes(docs)
    heads = suffixes.groupBy("head").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y").select("head", (F.col("n") > HOT).alias("hot"))
    rows = written(_with_windows(docs, suffixes.join(heads, "head")))
    dropped(suffixes)
    cool = rows.where("NOT hot").select("head", "doc_id", "first", "windows").repartition("head").sortWithinPartitions("head")
    matches = cool.mapInArrow(_matches, "doc_id long, first long, stop long, partner long").union(_hot_matches(rows.where("hot")))

    so_far = Window.partitionBy("doc_id").orderBy("first", "stop").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy("doc_id").orderBy("first", "stop").rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("first") <= F.max("stop").over(so_far), 0).otherwise(1)
    islands = matches.withColumn("new", new).withColumn("island", F.sum("new").over(running))
    spans = islands.groupBy("doc_id", "island").agg(F.min("first").alias("start_word"), F.max("stop").alias("end_word"), F.min("partner").alias("partner_id"))
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "partner_id", (F.col("partner_id") < F.col("doc_id")).alias("is_later"))
