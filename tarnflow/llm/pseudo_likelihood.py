"""Documents scored by masked pseudo-likelihood.

A small network reads the two tokens on either side of a place and predicts the
token there.  The sum of these conditional log-probabilities over all places of
a document is its pseudo-log-likelihood.

* Vocabulary: the most frequent words of the whole corpus; all others stand as
  one of SHAPES buckets by their shape.
* Output: a class of the vocabulary first, then a word of that class, so a
  place costs ``CLASSES + CLASS_WORDS`` outputs and not the whole vocabulary.
  Output biases start at the corpus's own frequencies.
* Training, in numpy inside the tasks: ROUNDS passes, each over its share of the
  documents, so that every document is used once and every place of it is masked
  and predicted: a place's own token is never among its neighbours.  Each task trains a copy on all its documents and
  hands back its parameters; Spark sums them, weighted by places, row by row of
  the matrices, and only the mean reaches the driver.  What is gathered grows
  with the number of tasks, what reaches the driver does not.
* Scoring: one scan without a shuffle, whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import Places, id_and_text, text_steps
from tarnflow.llm.wordshape import shaped

CLASSES, CLASS_WORDS, SHAPES = 32, 64, 256
VOCABULARY = CLASSES * CLASS_WORDS
WIDTH, SIDES = 16, (-2, -1, 1, 2)
ROUNDS, BATCH, RATE = 3, 1024, 0.08
#: Words counted together before their counts are handed on, and rows of counts handed on at once.
BLOCK_WORDS, COUNT_ROWS = 2_000_000, 1 << 16
#: Places that are scored at once.
SCORE_STEP = 4_096
_COLUMNS = [f"c{i}" for i in range(WIDTH)]
Batches = Iterator[pa.RecordBatch]


@dataclass
class Vocabulary:
    """Sorted hashes of known words, the id of each, and how often each id occurs."""

    known: np.ndarray
    ids: np.ndarray
    counts: np.ndarray

    def __post_init__(self):
        self.places = Places(self.known)

    def tokens(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, document) of every word of texts laid end to end."""
        word, shape, _, doc = shaped(data, ends)
        out = (VOCABULARY - SHAPES + (shape % np.uint64(SHAPES)).astype(np.int64)).astype(np.int32)
        if len(self.known) and len(word):
            at = self.places.places(word)
            out = np.where(at >= 0, self.ids[at], out)
        return out, doc


def count_vocabulary(docs: DataFrame) -> Vocabulary:
    """The most frequent words of all documents, by exact counts; counts of all words by shape bucket."""

    def counted(batches: Batches) -> Batches:
        words, buckets, size = [], np.zeros(SHAPES, np.int64), 0

        def block() -> Batches:
            token, n = np.unique(np.concatenate(words), return_counts=True)
            token, n = token.view(np.int64), n.astype(np.int64)
            at = np.arange(SHAPES, dtype=np.int64)
            kind = np.concatenate([np.zeros(len(token), bool), np.ones(SHAPES, bool)])
            rows = pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([token, at])), pa.array(np.concatenate([n, buckets]))], ["is_shape", "token", "n"])
            for a in range(0, len(rows), COUNT_ROWS):
                yield rows.slice(a, COUNT_ROWS)

        for batch in batches:
            for _, _, data, ends in text_steps(batch):
                word, shape, _, _ = shaped(data, ends)
                words.append(word)
                buckets = buckets + np.bincount((shape % np.uint64(SHAPES)).astype(np.int64), minlength=SHAPES)
                size += len(word)
                if size >= BLOCK_WORDS:
                    yield from block()
                    words, buckets, size = [], np.zeros(SHAPES, np.int64), 0
        if size:
            yield from block()

    sums = docs.select("text").mapInArrow(counted, "is_shape boolean, token long, n long").groupBy("is_shape", "token").agg(F.sum("n").alias("n"))
    ranked = sums.orderBy(F.col("is_shape").desc(), F.col("n").desc(), "token").limit(VOCABULARY).toPandas()  # SHAPES rows and the vocabulary: a top-k of fixed size
    is_shape = ranked["is_shape"].to_numpy(bool)
    top, rest = ranked[~is_shape], ranked[is_shape]
    words = top["token"].to_numpy(np.int64).view(np.uint64)
    counts = np.zeros(VOCABULARY)
    counts[: len(words)] = top["n"]
    counts[VOCABULARY - SHAPES + rest["token"].to_numpy(np.int64)] = rest["n"]
    at = np.argsort(words)
    return Vocabulary(words[at], at.astype(np.int32), counts)


class Network:
    """Parameters, one matrix of WIDTH columns each: a place's neighbours -> hidden -> class and word."""

    def __init__(self, counts: np.ndarray):
        rng = np.random.RandomState(20240311)
        n = VOCABULARY
        share = (counts + 0.5) / (counts + 0.5).sum()
        by_class = share.reshape(CLASSES, CLASS_WORDS)
        # rows: embeddings (one for the edge of a text), mixing matrix, hidden bias, outputs of classes and words with their biases
        self.e = (rng.randn(n + 1, WIDTH) * 0.1).astype(np.float32)
        self.w = (rng.randn(len(SIDES) * WIDTH, WIDTH) / np.sqrt(len(SIDES) * WIDTH)).astype(np.float32)
        self.b = np.zeros(WIDTH, np.float32)
        self.uc, self.bc = np.zeros((CLASSES, WIDTH), np.float32), np.log(by_class.sum(1)).astype(np.float32)
        self.uw, self.bw = np.zeros((n, WIDTH), np.float32), np.log(by_class / by_class.sum(1, keepdims=True)).ravel().astype(np.float32)

    PARTS = ("e", "w", "b", "uc", "bc", "uw", "bw")

    def flat(self) -> np.ndarray:
        """All parameters as rows of WIDTH numbers."""
        x = np.concatenate([getattr(self, p).ravel() for p in self.PARTS])
        return np.pad(x, (0, -len(x) % WIDTH)).reshape(-1, WIDTH)

    def fill(self, rows: np.ndarray) -> Network:
        x, at = rows.ravel(), 0
        for p in self.PARTS:
            old = getattr(self, p)
            setattr(self, p, x[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def _outputs(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class logits of every place, places in the order of their class, first of each class in it, logits over the class's words in that order)."""
        kind = (target // CLASS_WORDS).astype(np.int8)
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        sorted_h, inner = h[order], np.empty((len(h), CLASS_WORDS), np.float32)
        for c in range(CLASSES):
            if cuts[c] < cuts[c + 1]:
                own = slice(c * CLASS_WORDS, (c + 1) * CLASS_WORDS)
                np.matmul(sorted_h[cuts[c] : cuts[c + 1]], self.uw[own].T, out=inner[cuts[c] : cuts[c + 1]])
        inner += self.bw.reshape(CLASSES, CLASS_WORDS)[kind[order]]
        return h @ self.uc.T + self.bc, order, cuts, inner

    def log_p(self, context: np.ndarray, target: np.ndarray, mixed: list[np.ndarray]) -> np.ndarray:
        """Log-probability of each target between its neighbours; ``mixed``: :meth:`mix_tables`."""
        h = np.tanh(sum((mixed[k][context[:, k]] for k in range(1, len(SIDES))), mixed[0][context[:, 0]]) + self.b)
        logits, order, _, inner = self._outputs(h, target)
        rows, sorted_target = np.arange(len(target)), target[order]
        out = np.empty(len(target), np.float64)
        for x, at, here in ((inner, sorted_target % CLASS_WORDS, order), (logits, target // CLASS_WORDS, None)):
            x -= x.max(1, keepdims=True)
            one = x[rows, at] - np.log(np.exp(x, out=x).sum(1))
            if here is None:
                out += one
            else:
                out[here] = one
        return out

    def mix_tables(self) -> list[np.ndarray]:
        """Of each side: what every token adds to the hidden layer."""
        return [self.e @ self.w[k * WIDTH : (k + 1) * WIDTH] for k in range(len(SIDES))]


class Trainer:
    """Adagrad on one task's copy of the network."""

    def __init__(self, net: Network):
        self.net = net
        self.seen = {p: np.full_like(getattr(net, p), 1e-4) for p in Network.PARTS}

    def _move(self, part: str, at, grad: np.ndarray) -> None:
        self.seen[part][at] += grad * grad
        getattr(self.net, part)[at] -= RATE * grad / np.sqrt(self.seen[part][at])

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        net, n = self.net, len(target)
        x = net.e[context].reshape(n, -1)
        h = np.tanh(x @ net.w + net.b)
        d, order, cuts, inner = net._outputs(h, target)
        rows, sorted_target, sorted_h = np.arange(n), target[order], h[order]
        for p, at in ((d, target // CLASS_WORDS), (inner, sorted_target % CLASS_WORDS)):
            p -= p.max(1, keepdims=True)
            np.exp(p, out=p)
            p *= 1 / (p.sum(1, keepdims=True) * np.float32(n))
            p[rows, at] -= np.float32(1 / n)
        sorted_dh = np.empty_like(h)
        uw, bw = np.zeros_like(net.uw), np.zeros((CLASSES, CLASS_WORDS), np.float32)
        for c in range(CLASSES):
            its = slice(cuts[c], cuts[c + 1])
            if cuts[c] < cuts[c + 1]:
                own = slice(c * CLASS_WORDS, (c + 1) * CLASS_WORDS)
                np.matmul(inner[its], net.uw[own], out=sorted_dh[its])
                np.matmul(inner[its].T, sorted_h[its], out=uw[own])
        some = np.flatnonzero(np.diff(cuts))
        bw[some] = np.add.reduceat(inner, cuts[some], axis=0)
        dh = d @ net.uc
        dh[order] += sorted_dh
        dh *= 1 - h * h
        dx = (dh @ net.w.T).reshape(-1, WIDTH)
        flat = context.ravel().astype(np.int16)  # numbers of 16 bits are sorted by radix
        by = np.argsort(flat, kind="stable")
        flat = flat[by]
        first = np.flatnonzero(np.diff(flat, prepend=np.int16(-1)))
        moves = [("uc", slice(None), d.T @ h), ("bc", slice(None), d.sum(0)), ("uw", slice(None), uw), ("bw", slice(None), bw.ravel())]
        moves += [("w", slice(None), x.T @ dh), ("b", slice(None), dh.sum(0)), ("e", flat[first], np.add.reduceat(dx[by], first, axis=0))]
        for part, at, grad in moves:
            self._move(part, at, grad)


def contexts(token: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Neighbours of every place; VOCABULARY stands for what lies outside of the text."""
    out = np.full((len(token), len(SIDES)), VOCABULARY, np.int32)
    for k, side in enumerate(SIDES):
        n = abs(side)
        if n < len(token):
            here, there = (slice(n, None), slice(None, -n)) if side < 0 else (slice(None, -n), slice(n, None))
            out[here, k] = np.where(doc[here] == doc[there], token[there], VOCABULARY)
    return out


def train(docs: DataFrame) -> tuple[Vocabulary, Network]:
    """Vocabulary and network of all texts of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    words = count_vocabulary(docs)
    net = Network(words.counts)
    share = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(ROUNDS))
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((words, net))  # VOCABULARY * WIDTH numbers, whatever the corpus

        def trained(batches: Batches, sent=sent) -> Batches:
            words, start = sent.value
            net = Network(words.counts).fill(start.flat())
            trainer, places, waiting, size = Trainer(net), 0, [], 0
            for batch in batches:
                for _, _, data, ends in text_steps(batch):
                    token, doc = words.tokens(data, ends)
                    waiting.append((contexts(token, doc), token))
                    size += len(waiting[-1][1])
                    if size >= BATCH:
                        context, target = (np.concatenate(x) for x in zip(*waiting))
                        # neighbours in a text fall into different steps
                        steps = size // BATCH
                        for s in range(steps):
                            trainer.step(context[s::steps], target[s::steps])
                        places, waiting, size = places + size, [], 0
            if size:
                trainer.step(*(np.concatenate(x) for x in zip(*waiting)))
                places += size
            if places:
                rows = net.flat().astype(np.float64) * places
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(np.full(len(rows), places)), *(pa.array(c) for c in np.ascontiguousarray(rows.T))], ["at", "places", *_COLUMNS])

        schema = "at int, places long, " + ", ".join(f"{c} double" for c in _COLUMNS)
        copies = docs.where(share == turn).select("text").mapInArrow(trained, schema)
        mean = copies.groupBy("at").agg(*[(F.sum(c) / F.sum("places")).alias(c) for c in _COLUMNS]).orderBy("at").toPandas()
        if len(mean):
            net = Network(words.counts).fill(mean[_COLUMNS].to_numpy())
    return words, net


def score(docs: DataFrame, words: Vocabulary, net: Network) -> DataFrame:
    """doc_id, n_tokens, pseudo_log_likelihood and per_token (null without tokens) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((words, net))

    def scored(batches: Batches) -> Batches:
        words, net = sent.value
        mixed = net.mix_tables()
        for batch in batches:
            for i, j, data, ends in text_steps(batch):
                token, doc = words.tokens(data, ends)
                around, total = contexts(token, doc), np.zeros(j - i)
                for a in range(0, len(token), SCORE_STEP):
                    part = slice(a, a + SCORE_STEP)
                    total += np.bincount(doc[part], net.log_p(around[part], token[part], mixed), minlength=j - i)
                n = np.bincount(doc, minlength=j - i)
                mean = pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(total), mean], ["doc_id", "n_tokens", "pseudo_log_likelihood", "per_token"])

    return docs.mapInArrow(scored, "doc_id long, n_tokens long, pseudo_log_likelihood double, per_token double")


def pseudo_likelihood(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all rows of ``df`` and score each: doc_id, n_tokens, pseudo_log_likelihood, per_token.

    Null and empty texts and such of white space only have no tokens, a sum of 0
    and a null mean.  Repeated rows stay repeated; rows with a null id are
    scored too; an empty table gives an empty result.
    """
    docs = id_and_text(df, id_col, text_col)
    return score(docs, *train(docs))
