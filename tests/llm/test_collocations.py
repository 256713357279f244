"""Collocations against a plain count of every phrase, in all ways of dealing out the work."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnflow.llm.collocations import collocations

SCHEMA = "phrase long, text string, lang string, n string"


def plain(rows, least, top):
    f, total = {}, Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] = f.get((lang, tuple(words[i : i + size])), 0) + 1
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(b >= least and m == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (m, q), b in f.items())
        if not inside:
            out.append((lang, score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    result = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[1], -o[2], o[3].encode()))[:top]
        result += [(lang, i, p, a, l, r, total[lang], score) for i, (_, score, a, p, l, r) in enumerate(mine, 1)]
    return sorted(result)


def invented(seed, n):
    draw = random.Random(seed)
    words = ["the", "of", "a", "New", "york", "Ça", "x y", "état", "to", "be", "or", "not", "z" * 90, "1", "'s"]
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "\n\n..", "", "b"), (4, "alone", "EN", "c"), (None, "to be or not to be " * 40, None, "d"), (5, "the " * 300, "en", "d"), (5, "the " * 300, "en", "d")]
    for i in range(n):
        text = "".join(draw.choice(words[: 5 + i % 11]) + draw.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\r\n", " "]) for _ in range(draw.randint(0, 60)))
        rows.append((i, text, draw.choice(["en", "en", "EN", "de", None, ""]), "same"))
    return rows


@pytest.mark.parametrize("bounds", [{}, {"share": 40}, {"max_words": 6}, {"max_words": 3, "share": 10}, {"max_words": 0}, {"max_bytes": 30, "share": 200}])
def test_collocations(spark, bounds):
    rows = invented(7, 120)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5, F.rand(3))
    got = sorted(tuple(r) for r in collocations(df, least=6, top=25, **bounds).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    want = plain(rows, 6, 25)
    assert len(want) > 60 and got == want


def test_bounds_of_languages(spark):
    rows = [(i, "one two three four five", f"l{i % 90}", "x") for i in range(360)]
    got = sorted(tuple(r) for r in collocations(spark.createDataFrame(rows, SCHEMA), least=4).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain(rows, 4, 2000) and len({r[0] for r in got}) == 90


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations(empty).collect() == []
    assert collocations(spark.createDataFrame([(1, "two words", "en", "x")], SCHEMA)).collect() == []


def test_very_long_text(spark):
    rows = [(1, "a b c d. " * 200_000, "en", "x"), (2, "w" * 3_000_000, "en", "x")]
    got = {r.phrase: r for r in collocations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {p: r.a for p, r in got.items()} == {"a b c d": 200_000} and got["a b c d"].score == 1_000_000 and got["a b c d"].n == 800_001
