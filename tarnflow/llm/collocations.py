"""Collocations: phrases of words that occur together far more often than apart.

Counting follows suffix-sigma.  Every word opens a suffix, cut after ``MOST``
words or where its piece ends.  Suffixes are dealt out by language and first
word, sorted in reverse lexicographic order, and one pass over the sorted
suffixes counts every prefix, as equal prefixes are then adjacent.  Phrases are
joined with the counts of their parts afterwards.

Single words are counted first.  That pass gives the languages' totals and a
dictionary of bounded size, the most frequent words with their numbers, in which
suffixes are spelled; a word with fewer than ``least`` occurrences can be in no
candidate and ends a suffix.  Where the frequent words outgrow the dictionary, a
suffix ends at the first word outside it, and the phrases that hold such a word
are counted as text, by grouping.  Either way every occurrence is counted once.

A first word with very many suffixes does not go to one task: suffixes are dealt
out by their first words up to the first one that is not frequent enough to fill
a share by itself.  Prefixes of such words only may then lie in several shares,
so their counts are partial and are summed.  Equal suffixes of a batch are added
up before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.shared import WordRule, bounded_batches, dropped, frequent_head, memory_returned, mix, text_steps, written

#: Most words of a phrase.
MOST = 4
#: Bounds of the dictionary: words, and bytes of their spellings.
MAX_WORDS, MAX_BYTES = 1 << 19, 16 << 20
#: Suffixes of a share on average; a word with a quarter of that fills a share too well to be dealt out by itself.
SHARE = 1 << 20
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_WORDS = WordRule(b" \t" + _BREAKS)
_BREAK = np.isin(np.arange(256), list(_BREAKS))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _language_keys(langs: pa.Array) -> np.ndarray:
    """Hash of each row's language."""
    coded = langs.dictionary_encode()
    hashes = [int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest()) for name in coded.dictionary.to_pylist()]
    return np.array(hashes, np.uint64)[coded.indices.to_numpy()] if hashes else np.zeros(0, np.uint64)


def _words(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lower-cased bytes, key, start, stop, row, whether the next word follows in the same piece) of the words of a batch, by steps."""
    hashes = _language_keys(batch.column(1))
    for i, _, data, ends in text_steps(batch):
        words, start, stop, doc = _WORDS.hashed(data, ends)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])]) if len(data) else np.zeros(1, np.int64)
        joined = np.zeros(len(words), bool)
        if len(words):
            joined[:-1] = (doc[1:] == doc[:-1]) & (breaks[start[1:]] == breaks[start[:-1]])
        yield data.tobytes().translate(_LOWER), mix(words ^ hashes[i + doc]), start, stop, i + doc, joined


def _inputs(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return bounded_batches(df).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, key, n) of all words, written; key is the 64-bit hash by which tasks find a word in the dictionary."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, parts, size = [], [], 0
            for text, key, start, stop, row, _ in _words(batch):
                low.append(text)
                parts.append((key, start + size, stop + size, row))
                size += len(text)
            if not parts:
                continue
            key, start, stop, row = (np.concatenate(x) for x in zip(*parts))
            text = b"".join(low)
            keys, at, n = np.unique(key, return_index=True, return_counts=True)
            spelled = pa.array([text[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist())], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row[at])), spelled, pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["lang", "word", "key", "n"])
        memory_returned()

    return written(docs.mapInArrow(counted, "lang string, word string, key long, n long").groupBy("lang", "word", "key").agg(F.sum("n").alias("n")))


def _dictionary(words: DataFrame, least: int, max_words: int, max_bytes: int) -> tuple[pa.Table, bool]:
    """The most frequent words in descending order of count, within both bounds, and whether these are all with ``least`` occurrences."""
    frequent = words.where(F.col("n") >= least)
    taken, whole = frequent_head(frequent, "n", F.octet_length("word") + F.octet_length("lang"), max_words, max_bytes)
    return frequent.where(taken).toArrow().sort_by([("n", "descending"), ("lang", "ascending"), ("word", "ascending")]), whole


class Dictionary:
    """Numbers of words: 1 for the most frequent one, 0 for none; numbers up to ``hot`` are of words that fill a share."""

    def __init__(self, table: pa.Table, share: int):
        keys = table["key"].to_numpy().view(np.uint64)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise RuntimeError("two frequent words have one hash")
        self.words = table["word"].combine_chunks()
        self.langs = table["lang"].combine_chunks()
        self.hot = int((table["n"].to_numpy() > share // 4).sum())

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at].astype(np.int64) + 1, 0)


def _suffixes(number: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """(n, MOST) numbers of the words of each suffix, 0 after its end."""
    out = np.zeros((len(number), MOST), np.int64)
    out[:, 0] = number
    goes_on = joined & (number > 0)
    for k in range(1, MOST):
        m = len(number) - k
        if m <= 0:
            break
        out[:m, k] = np.where(goes_on[:m], number[k:], 0)
        goes_on[:m] &= joined[k:] & (number[k:] > 0)
    return out


def _summed(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal suffixes added up, in reverse lexicographic order."""
    order = np.lexsort((low, high))[::-1]
    high, low, n = high[order], low[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(high) else np.zeros(0, np.int64)
    return high[new], low[new], np.add.reduceat(n, new) if len(new) else n


def prefix_counts(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, first suffix that has the prefix, count) of all prefixes of 2 to MOST words, of suffixes in order.

    A suffix is two numbers of 64 bits with two words of 32 bits each.  What a
    stack does suffix by suffix is done for a whole length at a time: a prefix
    ends where the next suffix differs in its first words.
    """
    for size in range(2, MOST + 1):
        keep = np.uint64(0xFFFFFFFF00000000 if size == 3 else 0xFFFFFFFFFFFFFFFF)
        lower = low & keep if size > 2 else np.zeros(len(low), np.uint64)
        last = (high if size == 2 else low >> np.uint64(32) if size == 3 else low) & np.uint64(0xFFFFFFFF)
        new = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (lower[1:] != lower[:-1])])) if len(high) else np.zeros(0, np.int64)
        if len(new):
            count = np.add.reduceat(n, new)
            there = last[new] > 0
            yield size, new[there], count[there]


def _coded_counts(docs: DataFrame, words: Broadcast, shares: int, least: int) -> DataFrame:
    """(lang, phrase, size, f, whole) of phrases of two words and more that are in the dictionary; where not whole, f is to be summed."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Dictionary = words.value
        for batch in batches:
            found = []
            for _, key, _, _, _, joined in _words(batch):
                rows = _suffixes(known.numbers(key), joined)
                rows = rows[rows[:, 1] > 0].astype(np.uint64)
                found.append((rows[:, 0] << np.uint64(32) | rows[:, 1], rows[:, 2] << np.uint64(32) | rows[:, 3]))
            if not found:
                continue
            high, low = (np.concatenate(x) for x in zip(*found))
            high, low, n = _summed(high, low, np.ones(len(high), np.int64))
            place, hot, going = np.zeros(len(high), np.uint64), np.uint64(known.hot), np.ones(len(high), bool)
            for word in (high >> np.uint64(32), high & np.uint64(0xFFFFFFFF), low >> np.uint64(32), low & np.uint64(0xFFFFFFFF)):
                place = np.where(going, mix(place ^ word), place)
                going &= (word <= hot) & (word > 0)
            share = (place % np.uint64(shares)).astype(np.int32)
            order = np.argsort(share, kind="stable")
            cuts = np.flatnonzero(np.diff(share[order], prepend=-1))
            for at in np.split(order, cuts[1:]) if len(cuts) else ():
                yield pa.RecordBatch.from_arrays([pa.array(share[at[:1]]), *(pa.array([x[at].tobytes()], pa.binary()) for x in (high, low, n.astype(np.uint32)))], ["share", "high", "low", "n"])
        memory_returned()

    def counted(rows: pa.Table) -> pa.Table:
        known: Dictionary = words.value
        high, low, n = (np.frombuffer(b"".join(rows[c].to_pylist()), t) for c, t in (("high", np.uint64), ("low", np.uint64), ("n", np.uint32)))
        high, low, n = _summed(high, low, n.astype(np.int64))
        out = []
        for size, at, count in prefix_counts(high, low, n):
            number = np.stack([high[at] >> np.uint64(32), high[at] & np.uint64(0xFFFFFFFF), low[at] >> np.uint64(32), low[at] & np.uint64(0xFFFFFFFF)])[:size].astype(np.int64)
            partial = (number <= known.hot).all(axis=0)
            keep = partial | (count >= least)
            number, count, partial = number[:, keep] - 1, count[keep], partial[keep]
            spelled = [known.words.take(pa.array(x)).to_pylist() for x in number]
            out.append(pa.table({"lang": known.langs.take(pa.array(number[0])), "phrase": pa.array([" ".join(p) for p in zip(*spelled)], pa.string()), "size": pa.array(np.full(len(count), size, np.int32)), "f": pa.array(count, pa.int64()), "whole": pa.array(~partial)}))
        memory_returned()
        empty = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64()), ("whole", pa.bool_())]).empty_table()
        return pa.concat_tables([empty, *out])

    blocks = docs.mapInArrow(dealt, "share int, high binary, low binary, n binary")
    return blocks.groupBy("share").applyInArrow(counted, "lang string, phrase string, size int, f long, whole boolean")


def _spelled_counts(docs: DataFrame, words: Broadcast) -> DataFrame:
    """(lang, phrase, size, f, whole) of phrases of two words and more that hold a word outside the dictionary; f is to be summed."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Dictionary = words.value
        for batch in batches:
            for low, key, start, stop, row, joined in _words(batch):
                outside = known.numbers(key) == 0
                goes_on, holds = np.ones(len(key), bool), outside.copy()
                text = [low[a:b].decode() for a, b in zip(start.tolist(), stop.tolist())]
                for size in range(2, MOST + 1):
                    m = len(key) - size + 1
                    if m <= 0:
                        break
                    goes_on, holds = goes_on[:m] & joined[size - 2 : size - 2 + m], holds[:m] | outside[size - 1 :]
                    at = np.flatnonzero(goes_on & holds)
                    phrases = [" ".join(text[i : i + size]) for i in at.tolist()]
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row[at])), pa.array(phrases, pa.string()), pa.array(np.full(len(at), size, np.int32)), pa.array(np.ones(len(at), np.int64)), pa.array(np.zeros(len(at), bool))], ["lang", "phrase", "size", "f", "whole"])

    return docs.mapInArrow(spelled, "lang string, phrase string, size int, f long, whole boolean")


def phrase_counts(df: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, max_bytes: int = MAX_BYTES, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of all phrases of one to MOST words with ``least`` occurrences, (lang, n) with all words).

    Words are runs of other characters than spaces and tabs in the pieces between
    ``. , ; : ! ?`` and line ends, with A-Z lower-cased.  The bounds change how
    the work is dealt out, never the counts.
    """
    docs = _inputs(df, text_col, lang_col)
    words = _word_counts(docs)
    table, whole = _dictionary(words, least, max_words, max_bytes)
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")))
    shares = max(1, -(-(words.agg(F.sum("n")).first()[0] or 0) // share))
    known = df.sparkSession.sparkContext.broadcast(Dictionary(table, share))
    counts = _coded_counts(docs, known, shares, least)
    if not whole:
        counts = counts.union(_spelled_counts(docs, known))
    counts = written(counts)
    summed = counts.where("NOT whole").groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    single = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("f"))
    frequent = written(single.union(counts.where("whole").drop("whole")).union(summed).where(F.col("f") >= least))
    dropped(counts)
    dropped(words)
    return frequent, totals


def collocations(df: DataFrame, least: int = 30, top: int = 2000, text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases of 2 to MOST words.

    ``a`` is the phrase's count, at least ``least``.  Of its cuts into two parts
    with counts ``l`` and ``r`` the one with the lowest score
    floor(2000000 * a / (l + r)) counts (of equal ones the first).  A phrase that
    lies inside a longer one with at least 80 % of its count is left out.  ``n``:
    all words of the language.  Ranks go by score and ``a``, both descending, then
    by phrase.  Sums and products are decimals of 38 digits.

    A null language is ``und``; null and empty texts have no words; repeated rows
    count each time; columns besides text and language are not read; an empty
    table gives an empty result.
    """
    frequent, totals = phrase_counts(df, least, text_col, lang_col, **bounds)
    several = frequent.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))

    def part(first, words):
        return F.array_join(F.slice(F.split("phrase", " ", -1), first, words), " ")

    cuts = several.select("*", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    left = frequent.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    scored = scored.withColumn("score", F.expr("cast((cast(2000000 as decimal(38, 0)) * a) div (cast(l as decimal(20, 0)) + r) as long)"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = several.where("size > 2").select("lang", F.col("a").alias("longer"), F.explode(F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(split(phrase, ' ', -1), i, m), ' '))))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where("longer IS NULL OR cast(100 as decimal(38, 0)) * longer < cast(80 as decimal(38, 0)) * a")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    part_of = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)  # no language is ranked in one task as a whole
    first = kept.withColumn("rank", F.row_number().over(part_of)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
