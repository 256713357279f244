"""The language models against plain models: Kneser-Ney by hand, and a unigram model that knows no context."""

import math
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import pseudo_likelihood, quality

VOCABULARY = [a + b for a in "bar dol fen gim hos".split() for b in "ka mo ti nu".split()]


def chain(rng, n, order):
    """Words that follow each other by a rule, now and then by chance; none repeats the one before."""
    out = [rng.choice(order)]
    while len(out) < n:
        word = order[(order.index(out[-1]) + rng.choice([1, 1, 1, 2, 5])) % len(order)] if rng.random() < 0.8 else rng.choice(order)
        if word != out[-1]:
            out.append(word)
    return out


class Plain:
    """Interpolated modified Kneser-Ney of trigrams, by dictionaries."""

    def __init__(self, texts):
        three = Counter(t for words in texts for t in zip(["<", "<"] + words, ["<"] + words, words))
        # "<" stands before the first word only
        two = Counter((v, w) for _, v, w in three)
        one = Counter(w for _, w in two)
        self.tables = [self.shares(counts) for counts in (one, two, three)]
        self.unseen = self.tables[0][1][()] / (len(one) + 1)

    @staticmethod
    def shares(counts):
        of = Counter(counts.values())
        y = of[1] / max(of[1] + 2 * of[2], 1)
        cut = [min(max(0.1, k - (k + 1) * y * of[k + 1] / max(of[k], 1)), k - 0.05) for k in (1, 2, 3)]
        total, mass = defaultdict(int), defaultdict(float)
        split = lambda key: ((), key) if isinstance(key, str) else (key[:-1], key[-1])
        for key, c in counts.items():
            total[split(key)[0]] += c
            mass[split(key)[0]] += cut[min(c, 3) - 1]
        own = {split(key): (c - cut[min(c, 3) - 1]) / total[split(key)[0]] for key, c in counts.items()}
        return own, {context: mass[context] / total[context] for context in total}

    def p(self, word, context):
        own, left = self.tables[len(context)]
        if not context:
            return own.get(((), word), 0.0) + self.unseen
        lower = self.p(word, context[1:])
        return own.get((context, word), 0.0) + left[context] * lower if context in left else lower

    def log_perplexity(self, words):
        return -sum(math.log(self.p(w, (u, v))) for u, v, w in zip(["<", "<"] + words, ["<"] + words, words)) / len(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    orders = {"xx": VOCABULARY, "yy": rng.sample(VOCABULARY, len(VOCABULARY))}
    return [(i, chain(rng, rng.randrange(8, 60), orders[("xx", "yy")[i % 2]]), ("xx", "yy")[i % 2]) for i in range(240)]


def frame(spark, corpus):
    return spark.createDataFrame([(i, " ".join(w), lang) for i, w, lang in corpus], "doc_id long, text string, lang string")


def test_kneser_ney_is_that_of_plain_counts(spark, corpus):
    train, new = corpus[:160], corpus[160:]
    model = quality.fit(frame(spark, train).repartition(5))
    plain = {lang: Plain([w for _, w, x in train if x == lang]) for lang in ("xx", "yy")}
    got = {r.doc_id: (r.n_words, r.log_perplexity) for r in quality.perplexities(frame(spark, corpus), model).collect()}
    for i, words, lang in train + new:
        assert got[i][0] == len(words) and got[i][1] == pytest.approx(plain[lang].log_perplexity(words), abs=2e-6), i
    for context in (("<", "<"), ("<", VOCABULARY[0]), tuple(VOCABULARY[:2]), ("no", "where")):
        assert sum(plain["xx"].p(w, context) for w in VOCABULARY) + plain["xx"].unseen == pytest.approx(1, abs=1e-2)


def test_classify_is_that_of_plain_counts(spark, corpus):
    docs = frame(spark, corpus)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i, _, _ in corpus], "doc_id long, quality int, toxic int")
    words = {i: w for i, w, _ in corpus}
    trained = {r.doc_id for r in quality.training_documents(docs, labels).collect()}
    trusted = {i for i, _, _ in corpus if i % 3}
    assert trained < trusted
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    for lang in ("xx", "yy"):
        of = [i for i, _, x in corpus if x == lang]
        plain = Plain([words[i] for i in of if i in trained])
        limit = np.quantile([round(plain.log_perplexity(words[i]), quality.PLACES) for i in of if i in trusted - trained], quality.QUANTILE)
        for i in of:
            threshold = limit + quality.MARGIN + quality.FEW_WORDS / math.sqrt(len(words[i]))
            assert out[i].threshold == pytest.approx(threshold, abs=2e-4)
            assert out[i].keep == (out[i].log_perplexity <= out[i].threshold)


def test_all_trusted_documents_are_fitted_on_or_set_the_limit(spark):
    rows = [(i, f"bar fen {i}", ("xx", "yy")[i % 20 == 0]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    trained = quality.training_documents(docs.union(docs.where("doc_id < 100")), labels).collect()
    assert Counter(r.lang for r in trained) == {"xx": 2850, "yy": 150} and len({r.doc_id for r in trained}) == 3000


def test_kneser_ney_by_parts_and_joins_is_that_of_plain_counts(spark, corpus, monkeypatch):
    monkeypatch.setattr(quality, "PART_ROWS", 1)
    monkeypatch.setattr(quality, "PARTS", 3)
    monkeypatch.setattr(quality, "HEAD_ROWS", 40)
    train = corpus[:160]
    model = quality.fit(frame(spark, train).repartition(5))
    assert len(model.local.keys) <= 40 and model.parts == 3
    plain = {lang: Plain([w for _, w, x in train if x == lang]) for lang in ("xx", "yy")}
    rows = quality.perplexities(frame(spark, corpus + corpus[:5]), model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in corpus + corpus[:5])
    words = {i: (w, lang) for i, w, lang in corpus}
    for r in rows:
        w, lang = words[r.doc_id]
        assert r.n_words == len(w) and r.log_perplexity == pytest.approx(plain[lang].log_perplexity(w), abs=2e-6)


def test_words_ask_their_buckets_in_packed_rows(spark, corpus, monkeypatch):
    """A block of text sends one row for each bucket and one of its own, however many words it has, and no term twice."""
    monkeypatch.setattr(quality, "HEAD_ROWS", 0)
    model = quality.fit(frame(spark, corpus).repartition(5))
    assert len(model.local.keys) == 0
    words = sum(len(w) for _, w, _ in corpus)
    rows = pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in corpus]), pa.array([" ".join(w) for _, w, _ in corpus]), pa.array([x for _, _, x in corpus])], ["row", "text", "lang"])
    sent = pa.Table.from_batches(list(quality._asked(SimpleNamespace(value=model.local), model.buckets)(iter([rows]))))
    assert len(sent) <= model.buckets + 1
    asks = np.frombuffer(b"".join(sent["asks"].to_pylist()), np.uint8)
    # pairs and trigrams of every word; contexts of every word, the first one of a text by a row of its own
    assert len(asks) == words + len(corpus) and [int((asks & k > 0).sum()) for k in (1, 2, 4)] == [words] * 3


def test_places_of_hashes():
    rng = np.random.RandomState(2)
    keys = np.unique(np.concatenate([rng.randint(0, 2**63, 5000).astype(np.uint64) * np.uint64(2), np.arange(300, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(300, dtype=np.uint64)]))
    some = np.concatenate([keys, keys + np.uint64(1), rng.randint(0, 2**63, 999).astype(np.uint64)])
    at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
    for n in (0, 1, len(keys)):
        want = np.where((at < n) & (keys[at] == some), at, -1)
        assert (quality.Places(keys[:n]).places(some) == want).all()


def test_known_words_are_found_by_an_index(monkeypatch):
    """Ids are those of a search through the sorted words, which is not made."""
    text = np.frombuffer(("bar fen gim unheard " * 50 + "bar").encode(), np.uint8)
    ends = np.array([400, len(text)])
    word, shape, _, _ = pseudo_likelihood.shaped(text, ends)
    known = np.unique(word[:3])
    words = pseudo_likelihood.Vocabulary(known, np.arange(3, dtype=np.int32), np.ones(pseudo_likelihood.VOCABULARY))
    bucket = pseudo_likelihood.VOCABULARY - pseudo_likelihood.SHAPES + (shape % np.uint64(pseudo_likelihood.SHAPES)).astype(np.int64)
    want = np.where(np.isin(word, known), np.searchsorted(known, word), bucket)
    search = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, *b, **c: pytest.fail("searched") if len(a) == len(known) and a is not ends else search(a, *b, **c))
    got, _ = words.tokens(text, ends)
    assert (got == want).all() and got.dtype == np.int32


def test_nine_of_ten_bad_documents_are_rejected(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert got[got["quality"] == 1]["keep"].mean() >= 0.98 and (~got[got["quality"] == 0]["keep"]).mean() >= 0.9


def test_pseudo_likelihood_beats_unigrams_on_held_out_texts(spark):
    rng = random.Random(9)
    text = lambda: " ".join(chain(rng, 150, VOCABULARY))
    train, new = [(i, text()) for i in range(4000)], [(10_000 + i, text()) for i in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    words, net = pseudo_likelihood.train(frame(train))
    scores = [r.per_token for r in pseudo_likelihood.score(frame(new), words, net).collect()]
    counts = Counter(w for _, t in train for w in t.split())
    total = sum(counts.values())
    unigram = [sum(math.log(counts[w] / total) for w in t.split()) / 150 for _, t in new]
    assert np.mean(scores) > np.mean(unigram) + 0.3


def test_every_place_of_a_text_is_trained_on(spark):
    """Each text repeats four words, so places 3, 7, ... of all texts hold the same word: it is predicted as well as the others."""
    rows = [(i, "bar fen gim dol " * 10) for i in range(3000)]
    words, net = pseudo_likelihood.train(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    token, doc = words.tokens(np.frombuffer(rows[0][1].encode(), np.uint8), np.array([160]))
    p = net.log_p(pseudo_likelihood.contexts(token, doc), token, net.mix_tables())
    by_place = [float(p[k::4].mean()) for k in range(4)]
    assert len(token) == 40 and min(by_place) > -1, by_place


def test_a_step_takes_all_classes_at_once(monkeypatch):
    rng, calls, exp = np.random.RandomState(3), [], np.exp
    net = pseudo_likelihood.Network(np.arange(pseudo_likelihood.VOCABULARY) + 1.0)
    context, target = (rng.randint(0, pseudo_likelihood.VOCABULARY, size).astype(np.int32) for size in ((1024, 4), 1024))
    trainer = pseudo_likelihood.Trainer(net)
    before = net.log_p(context, target, net.mix_tables()).mean()
    monkeypatch.setattr(np, "exp", lambda *a, **b: calls.append(1) or exp(*a, **b))
    for _ in range(5):
        trainer.step(context, target)
    assert len(calls) == 10 and net.log_p(context, target, net.mix_tables()).mean() > before + 0.1
