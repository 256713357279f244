"""Families of near copies, with and without their original, against brute force."""

import random

import pytest

from tarnflow.llm import jaccard


def words_of(text):
    return text.lower().split()


def brute(rows):
    """(doc, shingles, least id reachable) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return sorted((i, len(sets[i]), top(i)) for i in ids)


def family(n, original, edits, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    rows = [(0, " ".join(base))] if original else []
    for i in range(1, n + 1):
        w = list(base)
        for at in rng.sample(range(200), rng.choice(edits)):
            w[at] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    passage = base[20:120]
    return rows + [(1000 + i, " ".join([f"z{rng.randrange(10**9)}" for _ in range(60 + 9 * i)] + passage)) for i in range(20)]


@pytest.mark.parametrize("original, edits, block, ids", [(True, [5], 2048, 10**6), (False, [5], 2048, 10**6), (False, [1, 2, 3, 5, 6], 40, 0), (True, [1, 4, 8, 12], 16, 0)])
def test_family(spark, monkeypatch, original, edits, block, ids):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", ids)
    rows = family(120, original, edits)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect())
    assert got == brute(rows)


def test_few_links_leave_a_task():
    import numpy as np

    rng = np.random.RandomState(3)
    core = rng.randint(0, 2**62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([core, rng.randint(0, 2**62, 10 + k % 50).astype(np.uint64)])) for k in range(400)]
    assert len(jaccard.connecting(np.arange(400), sets)) == 399
    assert jaccard.connecting(np.zeros(400), sets) == []
    n = np.array([len(s) for s in sets])
    assert jaccard.reachable(np.arange(400), n, [jaccard.profile(s) for s in sets]).all()
    assert not jaccard.reachable(np.zeros(400), n, [jaccard.profile(s) for s in sets]).any()
