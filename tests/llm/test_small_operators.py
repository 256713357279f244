"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnflow.llm import decontam, exact_dedup, jaccard, packing, pseudo_likelihood, quality, suffix_dedup, token_orc, url_filter
from tarnflow.llm.tokens import Encoder, tokenizer_path

WORDS = [a + b for a in "ka lo mi re su ta ven dor".split() for b in "ra ne lis mo ti gan".split()]


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def changed(text, seed, share):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in text.split(" "))


def corpus():
    base = [words(i, 60 + 7 * i) for i in range(12)]
    texts = base + [changed(base[i % 4], i, 0.02) for i in range(12)] + [base[0]] * 6 + [None, "", "  ", None, "one", "one", "One two", "Ünïcode é 漢字 \u00a0 x", words(99, 6000), words(99, 6000) + " end", "a\nb\n\n c\t d  e", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext|> c", "x <|ENDOFTEXT|> <|endoftext|"]
    return list(enumerate(texts)) + [(5, texts[5]), (None, "no id"), (None, base[1])]


@pytest.fixture(scope="module")
def docs(spark):
    kinds = "doc_id long, text string, lang string, n long, kept string, count long, token long"
    return spark.createDataFrame([(i, t, "en", 1, "x", 2, 3) for i, t in corpus()], kinds).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_exact_dedup(docs, none, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_HOT", 2)
    same = {}
    for i, t in corpus():
        same.setdefault(t or "", []).append(i)
    most = {t: max((i for i in ids if i is not None), default=None) for t, ids in same.items()}
    want = sorted(((i, most[t or ""], len(same[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in corpus()), key=str)
    for limit in (2, 1000):
        monkeypatch.setattr(exact_dedup, "LEAST_HOT", limit)
        out = exact_dedup.exact_dedup(docs)
        assert rows_of(out, "doc_id", "keep_id", "group_size", "text_sha256") == want
        assert out.where("kept").count() == len(same) and out.columns.count("kept") == 1
    assert exact_dedup.exact_dedup(none).count() == 0


def shingles(text):
    w = [x for x in re.split(r"[ \t\n\x0b\x0c\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard(docs, none):
    have = [(i, shingles(t)) for i, t in corpus() if i is not None]
    parent = {i: i for i, _ in have}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in have:
        for b, t in have:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    got = jaccard.jaccard_components(docs.where("doc_id IS NOT NULL")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(s), top(i)) for i, s in have)
    assert jaccard.jaccard_components(docs).count() == len(corpus())
    left = jaccard.one_of_each_group(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {top(i) for i, _ in have} | {None}
    assert jaccard.jaccard_components(none).count() == 0


def test_overlap_bound():
    rng = np.random.RandomState(1)
    for n, m, common in ((40, 50, 30), (400, 390, 5), (3, 3, 3), (70_000, 60_000, 50_000)):
        a = rng.randint(1, 2**62, n).astype(np.uint64)
        b = np.concatenate([a[:common], rng.randint(1, 2**62, m - common).astype(np.uint64)])
        assert jaccard.overlap_bound(jaccard.profile(np.unique(a)), jaccard.profile(np.unique(b))) >= len(np.intersect1d(a, b))


BENCH = [("b1", words(1, 70)), ("b2", "one"), ("b3", ""), ("b4", None), ("b5", words(77, 10)), ("b6", words(3, 30).upper() + "!!")]


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: rule.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    want = []
    for i, t in corpus():
        w, hit, items = cut(t), set(), set()
        for name, text in BENCH:
            b = cut(text)
            k = min(10, len(b))
            for a in range(len(b) - k + 1 if b else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == b[a : a + k]:
                        hit.update(range(p, p + k))
                        items.add(name)
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    for size in (decontam.BLOCK_BYTES, 300):  # one block and several
        out = decontam.contamination(decontam.benchmark_hits(docs, bench, block_bytes=size))
        assert rows_of(out, *out.columns) == sorted(want, key=str)
        assert decontam.clean_documents(docs, bench, block_bytes=size).count() == sum(not w[-1] for w in want)
    assert decontam.benchmark_hits(none, bench).count() == 0 and decontam.clean_documents(docs, bench.where("false")).count() == docs.count()


def test_packing(docs, none):
    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    want = {}
    for i, t in corpus():
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault((i, len(ids)), []).append(ids)
    covered, at = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
        covered.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        assert any(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in want[r.doc_id, r.doc_tokens])
    assert {k: sum(r.length for r in v) for k, v in covered.items()} == {k: k[1] * len(v) for k, v in want.items()}
    assert all(n <= 4096 and (n == 4096 or n & (n - 1) == 0) for n in at.values())
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("name, keeps_space", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_are_the_librarys(name, keeps_space):
    """Random texts with strings of added tokens inside words, at ends, repeated and cut short."""
    lib, rng = Tokenizer.from_file(tokenizer_path(name)), random.Random(17)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endof", "text|>", "<|", "word", "Wörter", "don't", "漢字", "1234", ",", ".", " ", "  ", "\n", "\t", "\0", "\u00a0", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)] + parts
    got = list(Encoder(tokenizer_path(name), keeps_space).stream(texts))
    assert [x.tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_is_balanced():
    lengths = np.random.RandomState(3).lognormal(6, 1, 2000).astype(np.int64) + 1
    cost, size = {}, {}
    for _, _, n, seq in packing.pack_lengths(lengths):
        cost[seq], size[seq] = cost.get(seq, 0) + packing.cost(n), size.get(seq, 0) + n
    full = [cost[s] for s, n in size.items() if n == 4096]
    assert sum(size.values()) == lengths.sum() and np.std([c for c in full if c < packing.cost(4096)]) < 0.35 * np.mean(full)


def test_token_files(spark, docs, none, tmp_path):
    import pyarrow.orc as orc

    path = tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    here = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = token_orc.tokenise_to_orc(here, path, f"file://{tmp_path}/orc").orderBy("doc_id").collect()
    start, seen = 0, dict((i, t) for i, t in corpus() if i is not None)
    for r in got:
        ids = np.array([*lib.encode(seen[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(seen)
    files = sorted((tmp_path / "orc").glob("*.orc"))
    ids = [x for f in files for x in orc.ORCFile(f).read(columns=["doc_id"])["doc_id"].to_pylist()]
    assert ids == sorted(ids)
    assert token_orc.tokenise_to_orc(docs, path).count() == len(corpus()) and token_orc.tokenise_to_orc(none, path).count() == 0


URLS = ["http://a.example.com/en/7x", "https://EXAMPLE.com/en/7", "ftp://x.net/de/8", "http://sub.example.net/de/8?q", "http://org/es/", "http://org/es", "http://borg/es/1", "://com/en/#a", None, "", "no", "http://", "http://com", "x://a.b.com?/en/", "http://net/de/"]


def test_url_filter(spark):
    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"

    rows = [(i, u) for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = url_filter.filter_urls(df)
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(((i, *judge(u)) for i, u in rows), key=str)
    assert url_filter.filter_urls(df.where("false")).count() == 0
    assert url_filter.filter_urls(df, rules=[]).where("verdict = 'allow'").count() == len(rows)


def test_cascade_is_exact(spark):
    listed = np.array([r[0] for r in spark.range(500).select(F.xxhash64("id")).collect()], np.int64).view(np.uint64)
    universe = spark.range(20_000).select(F.xxhash64("id").alias("key_hash"))
    levels = url_filter.build_cascade(universe, listed)
    keys = universe.toPandas()["key_hash"].to_numpy(np.int64).view(np.uint64)
    assert (url_filter.cascade_has(levels, keys) == np.isin(keys, listed)).all() and len(levels) > 1


def test_repeated_passages(spark, docs, none):
    shared = words(500, 80)
    rows = [(i, f"{words(600 + i, 30 + i)} {shared} {words(700 + i, 20)}") for i in range(6)] + [(6, words(800, 300)), (7, None), (8, ""), (9, "w " * 400), (10, shared[:200])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.repeated_passages(df).collect()}
    assert set(got) == set(range(6))
    for i, r in got.items():
        assert r.start_word <= 30 + i and r.end_word >= 110 + i - 0 and r.n_words >= 80 and r.is_later == (r.partner_id < i)
    assert suffix_dedup.repeated_passages(none).count() == 0
    assert suffix_dedup.repeated_passages(docs).where("doc_id IS NULL").count() == 0


def test_pseudo_likelihood(spark, docs, none):
    rng = random.Random(5)
    pairs = [(a, b) for a, b in zip(WORDS[:20], WORDS[20:40])]
    text = lambda: " ".join(w for _ in range(60) for w in rng.choice(pairs))
    rows = [(i, text()) for i in range(6000)]
    mixed = [(10_000 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, (_, t) in enumerate(rows[:20])]
    df = spark.createDataFrame(rows + mixed, "doc_id long, text string").coalesce(2)
    got = {r.doc_id: r.per_token for r in pseudo_likelihood.pseudo_likelihood(df).collect()}
    assert sum(got[i] - got[10_000 + i] for i in range(20)) / 20 > 0.3
    out = pseudo_likelihood.pseudo_likelihood(docs).collect()
    assert len(out) == len(corpus()) and all((r.n_tokens == 0) == (r.per_token is None) for r in out)
    assert pseudo_likelihood.pseudo_likelihood(none).count() == 0


def test_probabilities_add_up():
    net = pseudo_likelihood.Network(np.arange(pseudo_likelihood.VOCABULARY) + 1.0)
    net.uc += np.random.RandomState(1).randn(*net.uc.shape).astype(np.float32)
    context = np.tile(np.array([[3, 4, 5, pseudo_likelihood.VOCABULARY]], np.int32), (pseudo_likelihood.VOCABULARY, 1))
    p = np.exp(net.log_p(context, np.arange(pseudo_likelihood.VOCABULARY), net.mix_tables()))
    assert p.sum() == pytest.approx(1, abs=1e-3)


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit_on = labels.where("doc_id % 2 = 0")
    got = quality.classify(docs, fit_on).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good, bad = got[got["quality"] == 1], got[got["quality"] == 0]
    assert good["keep"].mean() >= 0.95 and (~bad["keep"]).mean() >= 0.5


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels)
    assert out.count() == len(corpus()) and out.where("n_words = 0 AND NOT keep").count() == 0
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.where("keep").count()
    assert quality.classify(none, labels).count() == 0 and quality.classify(docs, labels.where("false")).where("keep").count() == len(corpus())


def test_quality_limits_are_of_all_trusted_documents_not_trained_on(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRUSTED_WORDS", 6000)
    monkeypatch.setattr(quality, "FEW_WORDS", 0.0)
    monkeypatch.setattr(quality, "MARGIN", 0.0)
    rows = [(i, words(i, 20 + i % 50), "en" if i % 3 else "de") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    trained = {r.doc_id for r in quality.training_documents(df, labels).collect()}
    assert 0 < len(trained) < 300
    got = quality.classify(df, labels).toPandas()
    unseen = got[~got["doc_id"].isin(trained)]
    want = unseen.groupby("lang")["log_perplexity"].quantile(quality.QUANTILE)
    for lang, limit in got.groupby("lang")["threshold"].first().items():
        assert limit == pytest.approx(want[lang], abs=1e-3)


def test_quality_long_document_neither_ends_nor_empties_the_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRUSTED_WORDS", 6000)
    rows = [(i, words(i, 60) if i % 4 else words(i, 9000), "en") for i in range(80)] + [(100, words(100, 9000), "de"), (101, words(101, 9000), "de"), (102, words(102, 50), "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    trained = quality.training_documents(df, labels).collect()
    size = {x: sum(len(r.text) for r in trained if r.lang == x) for x in ("de", "en", "fr")}
    assert sum(r.lang == "en" for r in trained) > 20 and 0.5 * 36_000 < size["en"] <= 36_000 and size["de"] and size["fr"]
    with pytest.warns(UserWarning, match="'fr'"):
        got = quality.classify(df, labels).toPandas()
    assert got.groupby("lang")["threshold"].count().to_dict() == {"de": 2, "en": 80, "fr": 0}


def test_vocabulary_is_of_exact_counts(spark):
    rare = [f"{a}{b}" for a in WORDS for b in WORDS][:1500]
    rows = [(i, "often " * 1000 + " ".join(rare[:1000] if i < 3 else rare[i : 1000 + i])) for i in range(150)]  # each rare word is less than one in 1/8192 of all or near it
    df = spark.createDataFrame(rows + [(1000 + i, "often " * 4000) for i in range(400)], "doc_id long, text string").coalesce(1)
    exact = {}
    for r in df.collect():
        for w in r.text.split():
            exact[w] = exact.get(w, 0) + 1
    assert sum(n * 8192 < sum(exact.values()) for n in exact.values()) > 1000 and len(exact) < pseudo_likelihood.VOCABULARY - pseudo_likelihood.SHAPES
    got = pseudo_likelihood.count_vocabulary(df)
    counts = got.counts[: pseudo_likelihood.VOCABULARY - pseudo_likelihood.SHAPES]
    assert len(got.known) == len(exact) and sorted(counts[counts > 0]) == sorted(exact.values())
    assert got.counts[pseudo_likelihood.VOCABULARY - pseudo_likelihood.SHAPES :].sum() == sum(exact.values())


def test_exact_dedup_writes_over_no_column(spark):
    names = ["_cs_text", "_cs__hash", "_CS", "_cs_salt"]
    df = spark.createDataFrame([(i, t, f"mine{i}", i, "x", "y") for i, t in enumerate(["a", "b", "a", None, ""])], f"doc_id long, text string, {names[0]} string, {names[1]} long, {names[2]} string, {names[3]} string")
    got = exact_dedup.exact_dedup(df).orderBy("doc_id").collect()
    assert [(r["_cs_text"], r["_cs__hash"], r["_CS"], r["_cs_salt"], r.keep_id, r.group_size, r.kept) for r in got] == [("mine0", 0, "x", "y", 2, 2, False), ("mine1", 1, "x", "y", 1, 1, True), ("mine2", 2, "x", "y", 2, 2, True), ("mine3", 3, "x", "y", 4, 2, False), ("mine4", 4, "x", "y", 4, 2, True)]
