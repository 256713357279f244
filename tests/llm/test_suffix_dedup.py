"""Repeated passages against brute force over all windows of 50 words."""

import random
import re

import numpy as np
import pytest

from tarnflow.llm import suffix_dedup

LEAST = suffix_dedup.LEAST


def split(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def brute(rows):
    """(doc, start, end) of what another document repeats, the later ones, and the documents met in each."""
    where = {}
    for i, t in rows:
        w = split(t)
        for a in range(len(w) - LEAST + 1) if i is not None else ():
            where.setdefault(tuple(w[a : a + LEAST]), []).append((i, a))
    marks = {}
    for places in where.values():
        ids = {i for i, _ in places}
        for i, a in places if len(ids) > 1 else ():
            marks.setdefault(i, {}).setdefault(a, set()).update(ids - {i})
    out = []
    for i, of in marks.items():
        for a in sorted(of):
            if out and out[-1][0] == i and a <= out[-1][2]:
                out[-1][2] = a + LEAST
                out[-1][3] |= of[a]
            else:
                out.append([i, a, a + LEAST, set(of[a])])
    return sorted((i, a, b, min(ids) < i, tuple(sorted(ids))) for i, a, b, ids in out)


def corpus():
    rng = random.Random(23)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 55, 58, 60, 63, 66, 67, 70, 80, 300)]
    rows = []
    for i in range(60):
        some = rng.sample(passages, 3)
        rows.append((i, " ".join(w for p in [*some, some[0]] for w in [*fresh(rng.randrange(30)), *p])))  # one passage twice
    base = fresh(400)
    for i in range(60, 90):  # near copies
        rows.append((i, " ".join(w if rng.random() > 0.02 else "edit" + w for w in base)))
    line = fresh(12)
    rows += [(i, " ".join(fresh(20) + line * 8)) for i in range(90, 96)]  # a line over and over
    rows += [(96, None), (97, ""), (98, "w " * 400), (99, " ".join(base[:49])), (None, " ".join(base)), (60, rows[60][1]), (200, " ".join(fresh(5) + passages[-1]).upper()), (200, " ".join(fresh(70) + passages[-1]))]
    return rows


@pytest.mark.parametrize("parts, hot, step", [(1, 50_000, 200_000), (2, 50_000, 1), (5, 50_000, 50), (8, 4, 200_000), (3, 0, 200_000)])
def test_passages_are_those_of_brute_force(spark, monkeypatch, parts, hot, step):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "STEP_ROWS", step)
    rows = [r for r in corpus() if r[0] != 200] + [r for r in corpus() if r[0] == 200][:1]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, head string, first int, windows int").repartition(parts)
    got = sorted((r.doc_id, r.start_word, r.end_word, r.is_later, r.partner_id) for r in suffix_dedup.repeated_passages(df).collect())
    want = brute(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want] and len(want) > 150
    assert all(g[4] == w[4][0] for g, w in zip(got, want))


def test_texts_of_one_id(spark):
    """Each text of a repeated id is read at its own places."""
    rows = corpus()
    got = {(r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 200").collect()}
    assert got == {(5, 305), (70, 370)} or got == {(5, 370)}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.repeated_passages(none).collect() == []


def test_batches_of_few_words(spark):
    """Any number of words in a batch: runs of words against a plain loop, and one document to a partition."""
    rng = np.random.default_rng(4)
    for n in range(200):
        words = rng.integers(0, 2**63, n).astype(np.uint64)
        for size in (suffix_dedup.HEAD, LEAST):
            runs = suffix_dedup.runs_of(words, size)
            assert len(runs) == max(0, n - size + 1)
            assert all(runs[i] == suffix_dedup.runs_of(words[i : i + size], size)[0] for i in range(len(runs)))
    rows = [(n, " ".join(f"w{k}" for k in range(n))) for n in range(44, 66)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(len(rows), "doc_id")
    got = sorted((r.doc_id, r.start_word, r.end_word, r.is_later, r.partner_id) for r in suffix_dedup.repeated_passages(df).collect())
    assert got == [(*w[:4], w[4][0]) for w in brute(rows)] and len(got) == 16
