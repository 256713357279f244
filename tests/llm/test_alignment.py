"""Alignments against whole texts tokenised one by one, in all ways of dealing out the work."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import alignment
from tarnflow.llm.tokens import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(texts):
    tok = alignment.Tokenizers(A, B)
    docs = []
    for text in texts:
        text = text or ""
        a = tok.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tok.b.encode(text) if text else []
        pieces = [[tok.a_bytes[i] for i in a], [tok.b_bytes[i] for i in b]]
        if any(b"".join(p) != (" " + text).encode() for p in pieces) or not text:
            docs.append(([], [], [], Counter()))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in pieces]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, links, lo = [], Counter(), 0
        for end in both:
            x, y = (ids[bisect_right(e, lo) : bisect_right(e, end)] for ids, e in zip((a, b), ends))
            groups.append((x, y))
            links.update((u, v) for u in x for v in y)
            lo = end
        docs.append((a, b, groups, links))
    held = Counter(p for *_, links in docs for p in links)
    best = defaultdict(int)
    for (u, _), n in held.items():
        best[u] = max(best[u], n)
    out = []
    for a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


ODD = [None, "", " ", "  ", "\n", "\r\n", " \n x", "a  b", "a    b c", "x  y　 z", "a▁b c", "<|endoftext|> <s> </s> <unk> <0x0A>", "tab\tand\t\ttabs \t ", "it's we'll  don't", "日本語 テキスト と 改行\nです", "é é ﬁ ＃ 🙂🙂 🇩🇪", "x\x00y \x1c z\x85 w", ");\r\n{\r x", "trailing   ", "ends\n\n", "née été à la", "       many    spaces\n\n\n\nlines", "9 99 999 9999 12345", "a\x0bb \x0cc"]


def invented(seed, n):
    draw = random.Random(seed)
    words = ["the", "Cat", "naïve", "12", "...", "don't", "日本", "🙂", "xqzv" * 3, "▁", " ", "of", "é", "<s>"]
    texts = list(ODD)
    for i in range(n):
        some = words if i % 7 == 0 else [w for w in words if w != "▁"]
        texts.append("".join(draw.choice([draw.choice(some), str(draw.randint(0, 400))]) + draw.choice([" ", " ", "", "  ", "\n", "\t", ", ", "\r\n", ". "]) for _ in range(draw.randint(1, 60))))
    return texts


@pytest.mark.parametrize("bounds", [{}, {"max_segments": 40, "max_pairs": 30}, {"max_segments": 0, "max_pairs": 0}, {"max_bytes": 2000}])
def test_alignment(spark, bounds):
    texts = invented(5, 90)
    texts += texts[40:60]
    df = spark.createDataFrame([(None if i == 7 else i // 2, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, codes string, row long").repartition(6, F.rand(1))
    out = alignment.align(df, A, B, **bounds)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = Counter(tuple(r) for r in out.collect())
    want = Counter((None if i == 7 else i // 2, *w) for i, w in enumerate(plain(texts)))
    assert got == want and sum(w[1] > 0 for w in want) > 80


def test_breaks():
    tok = alignment.Tokenizers(A, B)
    assert tok.breaks[:1] and set(tok.breaks) >= set(b" \n") and b"\r"[0] not in tok.breaks  # the second vocabulary joins ';' and a carriage return
    assert alignment.safe_breaks([b"a b", b"c"], [b"x\n"], []) == b""
    assert alignment.safe_breaks([b" a"], [b"x\ty", b"\xc2\xa0 z"], ["▁\n"]) == b"\x0b\x0c\r "
    text = "a b  c  d\n e".encode()
    assert alignment.cuts(np.frombuffer(text, np.uint8), b" \n").tolist() == [1, 3, 10]


def test_long_and_empty(spark):
    texts = ["word " * 60_000 + "x" * 50_000, "日本" * 20_000, "a" * 300_000]
    got = [tuple(r)[1:] for r in alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B).orderBy("doc_id").collect()]
    assert got == plain(texts)
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
