"""Quality classifier: interpolated modified Kneser-Ney trigrams of trusted text.

Trusted documents (labelled good and not toxic) of each language give trigram
counts; the smoothed probabilities come from the n-grams grouped by context and
then by pair (continuation counts, counts of counts, context totals).  Every document
is scored by its perplexity under its language's model and rejected above a
quantile of the perplexities of all trusted documents that the model was not
fitted on.

Words that trusted text rarely has are replaced by their shape, and a word that
repeats the one before by a sign of its own, so the model judges odd spellings
and repetition and not rare names.

The model is fitted on all trusted documents but one in HELD_OUT, so its n-grams
grow with the corpus and stay a table of Spark.  The log-probability of a word is
a sum of four terms: of its unigram and its context word, which depend on the
vocabulary only and are known to every task, and of its pair, of its context pair
and of its trigram, where trusted text has them.  Terms of the most frequent
n-grams are known to every task, too; all others are found by one join.

N-grams travel in rows of arrays, one row for each bucket that a block of text
has n-grams in.  A bucket of a hash of two signs holds the terms of that pair, of
the trigrams that end in it and of the context that it is to the next word, so
each word asks one bucket.  Scoring goes by parts of the documents, so that only
a part's shuffle lies on disk at once.
"""

from __future__ import annotations

import uuid
import warnings
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.llm.shared import Places, bounded_batches, dropped, memory_returned, mix, scratch, shuffles_deleted, text_steps, written
from tarnflow.llm.wordshape import AGAIN, shaped

#: Labelled documents of a language that the model is fitted on at most, and words of them; None: all.
TRUSTED_DOCUMENTS: int | None = None
TRUSTED_WORDS: int | None = None
#: Characters that count as a word, and the share of the words that one document can have: of longer ones the start is fitted on.
WORD_SIZE, LARGEST_SHARE = 6, 0.05
#: Parts by a hash of the id in which a language's labelled documents are ranked.
RANKED_APART = 64
#: Parts of a scoring at most, words of trusted text for each and for a bucket of the model.
PARTS, PART_ROWS, BUCKET_ROWS = 8, 3_000_000, 1_000_000
#: Buckets of a model at least.
BUCKETS = 16
#: Shares in which trigrams by pair turn into terms.
SHARES = 4
#: Words whose trigrams a task counts together before it hands them on.
BLOCK_WORDS = 1 << 19
#: N-grams that every task knows at most, the most frequent ones, and their bytes.
HEAD_ROWS, HEAD_BYTES = 1 << 16, 16 << 20
#: Lists of ids up to this length are sent to every task, longer ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Of each 4 trusted documents one is never fitted on; it and all beyond the bounds set the threshold.
HELD_OUT = 4
#: Times that trusted text of a language must have a word for it to be known.
LEAST_KNOWN = 20
#: The threshold: this quantile of held-out documents and a margin in nats, wider for few words (divided by the root of their number).
QUANTILE, MARGIN, FEW_WORDS = 0.99, 0.5, 3.0
#: Perplexities are rounded to so many places before their quantile, so a language has few different values at any size.
PLACES = 4
_PAD = np.uint64(0x9E3779B97F4A7C15)
Batches = Iterator[pa.RecordBatch]


def _documents(df: DataFrame) -> DataFrame:
    return bounded_batches(df).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The doc_id of every document that is labelled good and not toxic; one with conflicting labels is not trusted."""
    return labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 0").select("doc_id")


def _row() -> Column:
    """A hash of what a score depends on: equal rows have equal scores."""
    return F.xxhash64("doc_id", "lang", "text")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def training_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, lang of what the model is fitted on: all trusted documents but one of each HELD_OUT, in the order of a hash of the id.

    The second is the first to be left out: a language of two trusted documents has a model and a limit.
    Where a bound is set, those beyond it are left out, too.
    """
    docs = docs.select("doc_id", "text", "lang")
    order, bits = F.xxhash64("doc_id", F.lit(3)), RANKED_APART.bit_length() - 1
    known = docs.select("doc_id", "lang", F.length("text").alias("size"), _row().alias("row")).join(trusted_ids(labels), "doc_id")
    known = known.groupBy("doc_id").agg(F.min_by(F.struct("lang", "size", "row"), "row").alias("x"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies", "x.*")
    # the parts are ranges of the hash: a rank is that within its part after all of the parts before
    known = written(known.withColumn("part", F.shiftright(order, 64 - bits)))
    ranked = known.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "part").orderBy(order, "doc_id")))
    before = known.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("lang", "part", (F.sum("n").over(Window.partitionBy("lang").orderBy("part")) - F.col("n")).alias("before"))  # RANKED_APART rows of a language
    chosen = ranked.join(before, ["lang", "part"]).withColumn("nth", F.col("nth") + F.col("before"))
    most = None
    if TRUSTED_DOCUMENTS is not None:
        chosen = chosen.where(F.col("nth") <= TRUSTED_DOCUMENTS)
    if TRUSTED_WORDS is not None:
        most = int(TRUSTED_WORDS * LARGEST_SHARE * WORD_SIZE)
        words = F.sum(F.least("size", F.lit(most)) / WORD_SIZE).over(Window.partitionBy("lang").orderBy("nth"))
        chosen = chosen.withColumn("words", words).where(F.col("words") <= TRUSTED_WORDS)
    ids = written(chosen.where(F.col("nth") % HELD_OUT != 2).select(F.col("row").alias("its_row"), "copies"))
    once = ids.where("copies = 1")
    out = docs.join(_small(once, once.count()), _row() == F.col("its_row")).select("doc_id", "text", "lang")
    if again := (repeated := ids.where("copies > 1")).count():
        out = out.union(docs.join(_small(repeated, again), _row() == F.col("its_row")).select("doc_id", "text", "lang").dropDuplicates(["doc_id"]))
    return out if most is None else out.withColumn("text", F.substring("text", 1, most))


def _lang_hash(lang: str) -> np.uint64:
    return mix(np.array([zlib.crc32(lang.encode())], np.uint64))[0]


def _key(*parts) -> np.ndarray:
    out = mix(parts[0] ^ np.uint64(len(parts)))
    for p in parts[1:]:
        out = mix(out ^ p)
    return out


def _word_counts(batches: Batches) -> Batches:
    for batch in batches:
        langs = np.array([_lang_hash(x) for x in batch.column(1).to_pylist()], np.uint64)
        for i, _, data, ends in text_steps(batch, "text"):
            word, shape, _, doc = shaped(data, ends)
            if len(word):
                _, first, n = np.unique(_key(langs[i + doc], word), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (langs[i + doc[first]], word[first], shape[first], n.astype(np.int64))], ["lang", "w", "shape", "n"])


@dataclass
class Vocabulary:
    """Words that stand for themselves, by language; the keys of all signs of trusted text, whose places are their numbers, and the number of each one's language; words of trusted text."""

    known: dict[str, Places]
    signs: Places
    lang: np.ndarray
    langs: list[str]
    size: int

    def numbered(self, data: np.ndarray, ends: np.ndarray, langs: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, u, v, w) of every word of texts laid end to end, as numbers of signs; -1: not in trusted text.  Before a text's start is a sign of its own."""
        word, shape, again, doc = shaped(data, ends)
        token = np.empty(len(word), np.uint64)
        name_of = np.array(names, object)[doc] if len(doc) else np.zeros(0, object)
        for name in set(names):
            its = name_of == name
            token[its] = self.known_or_shape(name, word[its], shape[its], again[its])
        w, start = self.find(_key(langs[doc], token)), self.find(_key(langs, np.full(len(langs), _PAD)))[doc]
        v, u = start.copy(), start
        same1, same2 = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
        v[1:][same1] = w[:-1][same1]
        u[2:][same2] = w[:-2][same2]
        return doc, u, v, w

    def known_or_shape(self, name: str, word: np.ndarray, shape: np.ndarray, again: np.ndarray) -> np.ndarray:
        out = np.where(self.known[name].places(word) >= 0, word, shape) if name in self.known else shape
        return np.where(again, mix(out ^ AGAIN), out)

    def find(self, keys: np.ndarray) -> np.ndarray:
        return self.signs.places(keys)


@dataclass
class Local:
    """What every task knows of the model: terms of signs by their numbers, what an unseen word of a language has, terms of the most frequent n-grams."""

    words: Vocabulary
    own: np.ndarray
    back: np.ndarray
    unseen: dict[int, float]
    keys: Places
    terms: np.ndarray
    rest: float = -20.0

    def base(self, lang: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Terms of the word itself and of the one before."""
        if not len(self.own):
            return np.full(len(w), self.rest)
        kinds, at = np.unique(lang, return_inverse=True)
        unseen = np.array([self.unseen.get(k, self.rest) for k in kinds.tolist()])[at]
        own = self.own[w]  # of signs without a count of their own: NaN
        return np.where((w < 0) | np.isnan(own), unseen, own) + np.where(v < 0, 0, self.back[v])

    def frequent(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the task knows the term, the term)."""
        at = self.keys.places(keys)
        yes = at >= 0
        x = np.zeros(len(keys))
        x[yes] = self.terms[at[yes]]
        return yes, x


@dataclass
class Model:
    """``local``, and the table of the terms of all n-grams: bucket, then arrays of key, x, n in the order of the keys."""

    local: Local
    terms: DataFrame
    parts: int
    buckets: int
    table: str

    def forget(self) -> None:
        """Delete the table."""
        dropped(self.terms)
        self.terms.sparkSession.sql(f"DROP TABLE {self.table}")


def _pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of two signs; its rest by the number of buckets is their bucket."""
    return mix(mix(v.astype(np.uint64)) ^ w.astype(np.uint64))


def _trigram_key(u: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return mix(pair + (u.astype(np.uint64) + np.uint64(1)) * _PAD)


#: A pair's key as a context.
_CONTEXT = np.uint64(0x94D049BB133111EB)


def _rows(keys: np.ndarray, buckets: int, **columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(buckets that have any of the keys, cuts between them, the columns in that order)."""
    bucket = (keys % np.uint64(buckets)).astype(np.int16 if buckets < 1 << 15 else np.int64)  # numbers of 16 bits are sorted by radix
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=bucket.dtype if buckets < 1 << 15 else np.int64))
    some = np.flatnonzero(np.diff(cuts))
    return some, np.append(cuts[some], len(keys)), {k: x[order] for k, x in columns.items()}


def _binary(cuts: np.ndarray, values: np.ndarray) -> pa.Array:
    """The bytes of the values between each cut and the next."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(cuts) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _packed(some: np.ndarray, cuts: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(some, np.int32)), *(_binary(cuts, x) for x in columns.values())], ["bucket", *columns])


def _one(bucket: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return _packed(np.array([bucket]), np.array([0, len(next(iter(columns.values())))]), columns)


_TYPES = {"u": np.int32, "v": np.int32, "w": np.int32, "c": np.int64, "a": np.float32, "g": np.float32, "key": np.uint64, "x": np.float32, "n": np.int64}


def _values(rows: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    """The arrays of all rows, one after the other."""
    return [np.frombuffer(b"".join(rows.column(k).to_pylist()), _TYPES[k]) for k in names]


def _each(batches: Batches) -> Batches:
    """One row at a time."""
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1)
    memory_returned()


def _firsts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_columns])
    return np.flatnonzero(new)


def _summed(u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
    """Distinct trigrams in the order of their contexts, and their counts."""
    order = np.lexsort((w, (u.astype(np.int64) << 32) | v))
    u, v, w = u[order], v[order], w[order]
    first = _firsts(u, v, w)
    return {"u": u[first], "v": v[first], "w": w[first], "c": np.add.reduceat(c[order], first)}


def _discounts(t: np.ndarray) -> np.ndarray:
    """The discounts of counts 1, 2 and above of each language, by how many n-grams of it occur 1, 2, 3 and 4 times."""
    y = t[:, 0] / np.maximum(t[:, 0] + 2 * t[:, 1], 1)
    d = [np.maximum(0.1, k - (k + 1) * y * t[:, k] / np.maximum(t[:, k - 1], 1)) for k in (1, 2, 3)]
    return np.stack([np.minimum(x, k - 0.05) for k, x in enumerate(d, 1)], 1)


def _cut(d: np.ndarray, lang: np.ndarray, c: np.ndarray) -> np.ndarray:
    return d[lang, np.minimum(c, 3) - 1]


def _vocabulary(train: DataFrame) -> Vocabulary:
    names = sorted(r[0] for r in train.select("lang").distinct().collect())
    of_hash = {int(_lang_hash(n).view(np.int64)): i for i, n in enumerate(names)}
    words = written(train.mapInArrow(_word_counts, "lang long, w long, shape long, n long").groupBy("lang", "w").agg(F.first("shape").alias("shape"), F.sum("n").alias("n")))
    kept, rare = (x.toArrow() for x in (words.where(F.col("n") >= LEAST_KNOWN).select("lang", "w"), words.where(F.col("n") < LEAST_KNOWN).select("lang", F.col("shape").alias("w")).distinct()))
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dropped(words)
    lang, word = kept["lang"].to_numpy(), kept["w"].to_numpy().view(np.uint64)
    known = {names[of_hash[h]]: Places(np.sort(word[lang == h])) for h in np.unique(lang).tolist()}
    signs, of = [_key(np.array([_lang_hash(n) for n in names], np.uint64), np.full(len(names), _PAD))], [np.arange(len(names))]
    for some in (kept, rare):
        lang, word = (some[c].to_numpy().view(np.uint64) for c in ("lang", "w"))
        signs += [_key(lang, word), _key(lang, mix(word ^ AGAIN))]
        kinds, at = np.unique(lang.view(np.int64), return_inverse=True)
        of += 2 * [np.array([of_hash[h] for h in kinds.tolist()], np.int64)[at]]
    signs, first = np.unique(np.concatenate(signs), return_index=True)
    return Vocabulary(known, Places(signs), np.concatenate(of)[first].astype(np.int32), names, size)


def fit(train: DataFrame) -> Model:
    """Modified Kneser-Ney terms of the documents, for each language."""
    spark = train.sparkSession
    train = train.select("text", "lang")
    vocabulary = _vocabulary(train)
    count = len(vocabulary.signs)
    parts, buckets = min(PARTS, max(1, -(-vocabulary.size // PART_ROWS))), max(BUCKETS, -(-vocabulary.size // BUCKET_ROWS))
    sent = spark.sparkContext.broadcast(vocabulary)
    trigrams = "bucket int, u binary, v binary, w binary, c binary"

    def by_language(sign: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(vocabulary.lang[sign], values, minlength=len(vocabulary.langs))

    def counted(batches: Batches) -> Batches:
        waiting, size = [], 0

        def block() -> pa.RecordBatch:
            u, v, w = (np.concatenate(x) for x in zip(*waiting))
            out = _summed(u, v, w, np.ones(len(u), np.int64))
            return _packed(*_rows(_pair_key(out["u"], out["v"]), buckets, **out))

        for batch in batches:
            langs = batch.column(1).to_pylist()
            hashes = np.array([_lang_hash(x) for x in langs], np.uint64)
            for i, j, data, ends in text_steps(batch, "text"):
                _, *signs = sent.value.numbered(data, ends, hashes[i:j], langs[i:j])
                waiting.append(signs)
                size += len(signs[0])
                if size >= BLOCK_WORDS:
                    yield block()
                    waiting, size = [], 0
        if size:
            yield block()
        memory_returned()

    def by_context(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_one(rows["bucket"][0].as_py(), _summed(*_values(rows, "u", "v", "w", "c")))])

    n3 = written(train.mapInArrow(counted, trigrams).groupBy("bucket").applyInArrow(by_context, trigrams))

    def often(batches: Batches) -> Batches:
        for row in _each(batches):
            w, c = _values(row, "w", "c")
            lang, its = sent.value.lang[w], c <= 4
            n = np.bincount(lang[its] * 4 + c[its] - 1, minlength=4 * len(sent.value.langs))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    t3 = np.zeros(4 * len(vocabulary.langs))
    for r in n3.mapInArrow(often, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # four rows of a language
        t3[r["at"]] = r["n"]
    d3 = _discounts(t3.reshape(-1, 4))

    def shares(row: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Trigrams with first of each context, its total, the mass it leaves to lower orders, and the cut of every trigram."""
        u, v, w, c = _values(row, "u", "v", "w", "c")
        first, cut = _firsts(u, v), _cut(d3, sent.value.lang[w], c)
        total = np.add.reduceat(c, first)
        return u, v, w, c, first, total, np.add.reduceat(cut, first) / total, cut

    def to_pairs(batches: Batches) -> Batches:
        for row in _each(batches):
            u, v, w, c, first, total, g, cut = shares(row)
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(u))))
            columns = {"u": u, "v": v, "w": w, "c": c, "a": ((c - cut) / total[of]).astype(np.float32), "g": g[of].astype(np.float32)}
            yield _packed(*_rows(_pair_key(v, w), buckets, **columns))

    def by_pair(rows: pa.Table) -> pa.Table:
        names = ["u", "v", "w", "c", "a", "g"]
        columns = dict(zip(names, _values(rows, *names)))
        order = np.argsort((columns["v"].astype(np.int64) << 32) | columns["w"], kind="stable")
        return pa.Table.from_batches([_one(rows["bucket"][0].as_py(), {k: x[order] for k, x in columns.items()})])

    paired = trigrams + ", a binary, g binary"
    # in shares, each deleted when its terms are stored
    n2 = written(n3.mapInArrow(to_pairs, paired).groupBy("bucket").applyInArrow(by_pair, paired).withColumn("share", F.pmod("bucket", F.lit(SHARES))), "share")
    terms, path, name = "bucket int, key binary, x binary, n binary", scratch(spark), f"tarnflow_terms_{uuid.uuid4().hex}"

    def stored(rows: DataFrame) -> None:
        """Rows of few buckets in each task: a file for each bucket without a shuffle."""
        rows.write.mode("append").bucketBy(buckets, "bucket").option("path", path).saveAsTable(name)

    def context_terms(batches: Batches) -> Batches:
        for row in _each(batches):
            u, v, _, _, first, total, g, _ = shares(row)
            key = _pair_key(u[first], v[first]) ^ _CONTEXT
            order = np.argsort(key)
            yield _one(row["bucket"][0].as_py(), {"key": key[order], "x": np.log(g)[order].astype(np.float32), "n": total[order]})

    stored(n3.mapInArrow(context_terms, terms))
    dropped(n3)

    def sign_counts(batches: Batches) -> Batches:
        """Of each first sign of pairs their continuation counts' sum, how many are 1, 2, 3 and 4, and how many there are; of each second sign how many there are."""
        for row in _each(batches):
            v, w = _values(row, "v", "w")
            first = _firsts(v, w)
            c = np.diff(np.append(first, len(v)))
            v, w, n = v[first], w[first], np.ones(len(first), np.int64)
            at = _firsts(v)
            sums = [np.add.reduceat(x.astype(np.int64), at) for x in (c, c == 1, c == 2, c == 3, c == 4, n)]
            second, k = np.unique(w, return_counts=True)
            none = np.zeros(len(second), np.int64)
            columns = [np.append(v[at], second), *(np.append(x, none) for x in sums), np.append(np.zeros(len(at), np.int64), k)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["sign", "c", "t1", "t2", "t3", "t4", "n", "before"])

    names = ["c", "t1", "t2", "t3", "t4", "n", "before"]
    got = n2.select("v", "w").mapInArrow(sign_counts, "sign int, " + ", ".join(f"{k} long" for k in names)).groupBy("sign").agg(*[F.sum(k).alias(k) for k in names]).toArrow()  # a row for each sign
    sign, sums = got["sign"].to_numpy(), {k: got[k].to_numpy() for k in names}
    d2 = _discounts(np.stack([by_language(sign, sums[f"t{k}"]) for k in (1, 2, 3, 4)], 1))
    total2, g2, p1 = np.ones(count), np.ones(count), np.full(count, np.nan)
    ahead = sums["n"] > 0
    its = sign[ahead]
    of = d2[vocabulary.lang[its]]
    t1, t2, n, c = (sums[k][ahead] for k in ("t1", "t2", "n", "c"))
    total2[its], g2[its] = c, (of[:, 0] * t1 + of[:, 1] * t2 + of[:, 2] * (n - t1 - t2)) / c
    after = sums["before"] > 0
    its, c = sign[after], sums["before"][after]
    d1 = _discounts(np.stack([by_language(its, c == k) for k in (1, 2, 3, 4)], 1))
    cut, total1 = _cut(d1, vocabulary.lang[its], c), np.maximum(by_language(its, c), 1)
    p0 = by_language(its, cut) / total1 / (by_language(its, np.ones(len(its))) + 1)
    p1[its] = (c - cut) / total1[vocabulary.lang[its]] + p0[vocabulary.lang[its]]
    lower = spark.sparkContext.broadcast((total2, g2, p1))

    def pair_terms(batches: Batches) -> Batches:
        total2, g2, p1 = lower.value
        for row in _each(batches):
            u, v, w, c, a, g = _values(row, "u", "v", "w", "c", "a", "g")
            first = _firsts(v, w)
            n = np.diff(np.append(first, len(v)))
            x, y = v[first], w[first]
            p2 = (n - _cut(d2, sent.value.lang[y], n)) / total2[x] + g2[x] * p1[y]
            pair, low = _pair_key(x, y), np.repeat(p2, n)
            key = np.append(pair, _trigram_key(u, np.repeat(pair, n)))
            term = np.append(np.log(p2 / (g2[x] * p1[y])), np.log((a + g * low) / (g * low)))
            order = np.argsort(key)
            yield _one(row["bucket"][0].as_py(), {"key": key[order], "x": term[order].astype(np.float32), "n": np.append(np.add.reduceat(c, first), c)[order]})

    for folder in sorted({f.rsplit("/", 1)[0] for f in n2.inputFiles()}):
        its = spark.read.schema(paired).parquet(folder)
        stored(its.mapInArrow(pair_terms, terms))
        dropped(its)
    table = spark.table(name)
    head = _head(table)
    keys = head["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    unseen = {int(_lang_hash(k)): float(np.log(x)) for k, x in zip(vocabulary.langs, p0) if x > 0}
    return Model(Local(vocabulary, np.log(p1), np.log(g2), unseen, Places(keys[order]), head["x"].to_numpy()[order]), table.select("bucket", "key", "x"), parts, buckets, name)


def _head(terms: DataFrame) -> pa.Table:
    """key and x of the most frequent n-grams, as many as both bounds allow: by levels of their counts, sixteen to each doubling, the last of them whole."""

    def level(n: np.ndarray) -> np.ndarray:
        return np.floor(np.log2(n) * 16).astype(np.int64)

    def levels(batches: Batches) -> Batches:
        for row in _each(batches):
            at, n = np.unique(level(*_values(row, "n")), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64))], ["level", "n"])

    rows, cut = 0, None
    for r in terms.select("n").mapInArrow(levels, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():
        rows += r["n"]
        if rows > HEAD_ROWS or rows * 12 > HEAD_BYTES:
            break
        cut = r["level"]

    def chosen(batches: Batches) -> Batches:
        for row in _each(batches):
            key, x, n = _values(row, "key", "x", "n")
            its = np.zeros(len(n), bool) if cut is None else level(n) >= cut
            yield pa.RecordBatch.from_arrays([pa.array(key[its].view(np.int64)), pa.array(x[its])], ["key", "x"])

    return terms.select("key", "x", "n").mapInArrow(chosen, "key long, x float").toArrow()


#: What a word asks of its bucket: the terms of its pair, of its trigram, and of the pair as the context of the next word.
_ASKS_PAIR, _ASKS_TRIGRAM, _ASKS_CONTEXT = 1, 2, 4
_ASKED = "bucket int, pair binary, u binary, asks binary, row binary, times binary, known binary, n_words binary"


def _asked(local: Broadcast, buckets: int) -> Callable[[Batches], Batches]:
    """For each bucket what words ask it, in the order of their rows, with the rows and how many words each has here; in rows of their own the sums of known terms and the words of each row."""

    def asked(batches: Batches) -> Batches:
        model = local.value
        for batch in batches:
            langs = batch.column(2).to_pylist()
            hashes = np.array([_lang_hash(x) for x in langs], np.uint64)
            row = batch.column(0).to_numpy()
            for i, j, data, ends in text_steps(batch, "text"):
                doc, u, v, w = model.words.numbered(data, ends, hashes[i:j], langs[i:j])
                x, asks = model.base(hashes[i:j][doc], v, w), np.zeros(len(doc), np.uint8)
                starts = _firsts(doc)
                pair = _pair_key(v, w)
                around = np.empty_like(pair)
                around[1:] = pair[:-1]
                around[starts] = _pair_key(u[starts], v[starts])
                extra = np.zeros(0, np.int64)
                for ask, seen, keys in ((_ASKS_PAIR, (v >= 0) & (w >= 0), pair), (_ASKS_CONTEXT, (u >= 0) & (v >= 0), around ^ _CONTEXT), (_ASKS_TRIGRAM, (u >= 0) & (v >= 0) & (w >= 0), None)):
                    at = np.flatnonzero(seen)
                    yes, term = model.frequent(_trigram_key(u[at], pair[at]) if keys is None else keys[at])
                    x[at[yes]] += term[yes]
                    at = at[~yes]
                    if ask == _ASKS_CONTEXT:  # of the pair before; a text's first context is no pair of it
                        first = np.zeros(len(doc), bool)
                        first[starts] = True
                        extra = at[first[at]]
                        at = at[~first[at]] - 1
                    asks[at] |= ask
                at = np.flatnonzero(asks)
                doc_of = np.append(doc[at], doc[extra])
                columns = {"pair": np.append(pair[at], around[extra]), "u": np.append(u[at], u[extra]), "asks": np.append(asks[at], np.full(len(extra), _ASKS_CONTEXT, np.uint8)), "doc": doc_of}
                by = np.argsort(doc_of, kind="stable") if len(extra) else slice(None)
                columns = {k: c[by] for k, c in columns.items()}
                some, cuts, columns = _rows(columns["pair"], buckets, **columns)
                its = columns.pop("doc")
                new = np.zeros(len(its), bool)
                new[_firsts(its)] = True
                new[cuts[:-1]] = True
                first = np.flatnonzero(new)
                runs = np.searchsorted(first, cuts)
                none = np.zeros(len(some) + 1, np.int64)
                arrays = [pa.array(some.astype(np.int32)), *(_binary(cuts, c) for c in columns.values()), _binary(runs, row[i:j][its[first]]), _binary(runs, np.diff(np.append(first, len(its)))), _binary(none, none), _binary(none, none)]
                yield pa.RecordBatch.from_arrays(arrays, _NAMES)
                total, words = np.bincount(doc, x, minlength=j - i), np.bincount(doc, minlength=j - i).astype(np.int64)
                nothing, whole = _binary([0, 0], none[:0]), [0, j - i]
                yield pa.RecordBatch.from_arrays([pa.array([int(row[i]) % buckets], pa.int32()), nothing, nothing, nothing, _binary(whole, row[i:j]), nothing, _binary(whole, total), _binary(whole, words)], _NAMES)
        memory_returned()

    return asked


_NAMES = [c.split()[0] for c in _ASKED.split(", ")]


_ANSWERED = "block int, row binary, sum binary, n_words binary"


def _answered(blocks: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each block of rows the sums of the terms that words ask of one bucket, and what is known of rows without it; n_words is -1 in the former."""

    def answered(asks: pa.Table, terms: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(asks[name].to_pylist()), kind)
        pair, u, what, times = read("pair", np.uint64), read("u", np.int32), read("asks", np.uint8), read("times", np.int64)
        x = np.zeros(len(pair))
        for row in _each(terms.to_batches()) if len(pair) else ():
            key, term = _values(row, "key", "x")
            known = Places(key)
            for ask in (_ASKS_PAIR, _ASKS_TRIGRAM, _ASKS_CONTEXT):
                its = np.flatnonzero(what & ask)
                keys = pair[its] if ask == _ASKS_PAIR else pair[its] ^ _CONTEXT if ask == _ASKS_CONTEXT else _trigram_key(u[its], pair[its])
                at = known.places(keys)
                x[its[at >= 0]] += term[at[at >= 0]]
        rows, whole = asks["row"].to_pylist(), [len(k) > 0 for k in asks["known"].to_pylist()]
        row = np.frombuffer(b"".join([r for r, k in zip(rows, whole) if not k] + [r for r, k in zip(rows, whole) if k]), np.int64)
        sums = np.add.reduceat(x, np.cumsum(times) - times) if len(times) else np.zeros(0)
        columns = {"row": row, "sum": np.append(sums, read("known", np.float64)), "n_words": np.append(np.full(len(sums), -1), read("n_words", np.int64))}
        return pa.Table.from_batches([_packed(*_rows(row.view(np.uint64), blocks, **columns)).rename_columns([c.split()[0] for c in _ANSWERED.split(", ")])])

    return answered


def _summed_rows(answers: pa.Table) -> pa.Table:
    """row, total, words and copies of the rows of one block; equal rows are summed together: their mean is that of one."""
    row, x, n = (np.frombuffer(b"".join(answers[k].to_pylist()), kind) for k, kind in (("row", np.int64), ("sum", np.float64), ("n_words", np.int64)))
    row, at = np.unique(row, return_inverse=True)
    sums = [np.bincount(at, y, minlength=len(row)) for y in (np.maximum(n, 0), n >= 0)]
    return pa.table([pa.array(row), pa.array(np.bincount(at, x, minlength=len(row))), *(pa.array(y.astype(np.int64)) for y in sums)], ["row", "total", "words", "copies"])


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_words and log_perplexity (null without words) of every row of doc_id, text, lang."""
    spark = docs.sparkSession
    rows = docs.select(_row().alias("row"), "doc_id", "text", "lang")
    asked, path = _asked(spark.sparkContext.broadcast(model.local), model.buckets), scratch(spark)
    for part in range(model.parts):
        some = rows.where(F.pmod("row", F.lit(model.parts)) == part).select("row", "text", "lang")
        found = some.mapInArrow(asked, _ASKED).groupBy("bucket").cogroup(model.terms.groupBy("bucket")).applyInArrow(_answered(model.buckets), _ANSWERED)
        found.groupBy("block").applyInArrow(_summed_rows, "row long, total double, words long, copies long").write.mode("append").parquet(path)
    sums = spark.read.schema("row long, total double, words long, copies long").parquet(path)
    mean = F.when(F.col("words") > 0, -F.col("total") / F.col("words"))
    return rows.drop("text").join(sums, "row").select("doc_id", "lang", (F.col("words") / F.col("copies")).cast("long").alias("n_words"), mean.alias("log_perplexity"), "row")


def limits_of(scores: DataFrame, labels: DataFrame, trained: DataFrame) -> dict[str, float]:
    """Of each language the quantile of the perplexities of all trusted documents but the ``trained`` ones.

    Warns of languages that have trusted text and no limit, as all their documents are kept.
    """
    unseen = scores.where("log_perplexity IS NOT NULL").join(trained.select("doc_id"), "doc_id", "left_anti").join(trusted_ids(labels), "doc_id", "left_semi")
    values = unseen.groupBy("lang", F.round("log_perplexity", PLACES).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    limits = {r["lang"]: r["limit"] for r in values.groupBy("lang").agg(F.percentile("x", QUANTILE, F.col("n")).alias("limit")).collect()}  # one row for each language with trusted text
    if without := sorted({r[0] for r in trained.select("lang").distinct().collect()} - set(limits)):
        warnings.warn(f"no trusted document is left to set a limit, so all are kept, in: {', '.join(map(repr, without))}", stacklevel=3)
    return limits


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, log_perplexity, row, threshold and keep of every row of :func:`_documents`."""
    trained = training_documents(docs, labels)
    with shuffles_deleted(docs.sparkSession):
        model = fit(trained)
        scores = written(perplexities(docs, model))  # narrow rows, read for the limits and for the result
    limits = docs.sparkSession.createDataFrame(list(limits_of(scores, labels, written(trained.select("doc_id", "lang"))).items()), "lang string, limit double")
    model.forget()
    scored = scores.join(F.broadcast(limits), "lang", "left")  # one row for each language with trusted text
    scored = scored.withColumn("threshold", F.col("limit") + MARGIN + FEW_WORDS / F.sqrt(F.greatest("n_words", F.lit(1))))
    return scored.withColumn("keep", F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(True)))


def classify(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, log_perplexity, threshold and keep for every row of documents.

    Null texts are empty.  Texts without words have no perplexity and are kept,
    as are documents of languages without trusted text.  A null language counts
    as a language of its own.  Repeated rows stay repeated; an empty table works.
    """
    return _judged(_documents(df), labels).select("doc_id", "lang", "n_words", "log_perplexity", "threshold", "keep")


def good_documents(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``df`` that :func:`classify` keeps, with all their columns; texts are shuffled only where more than BROADCAST_IDS are rejected."""
    bad = written(_judged(_documents(df), labels).where("NOT keep").select(F.col("row").alias("bad_row")).distinct())
    own = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return df.join(_small(bad, bad.count()), own == F.col("bad_row"), "left_anti")
