"""Near-duplicate embeddings against a comparison of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.llm.embedding_dedup import Hashing, embedding_dedup, hadamard, hashing


def plain(rows, threshold=0.95):
    """(id, links, component) of rows by comparing all pairs; the pairs too."""
    good = [(k, np.array(v, float)) for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    unit = {k: (x := v / np.abs(v).max()) / np.linalg.norm(x) for k, v in good}
    links = [[] for _ in rows]
    for length in {len(v) for v in unit.values()}:
        keys = [k for k in unit if len(unit[k]) == length]
        m = np.array([unit[k] for k in keys])
        for k, row in zip(keys, m @ m.T):
            links[k] = [o for o, c in zip(keys, row) if c >= threshold and o != k]
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        out.append((i, len(links[k]), None if i is None else min(rows[s][0] for s in seen)))
    return out


def near(draw, x, cosine):
    z = draw.normal(size=len(x))
    z -= (z @ x) * x / (x @ x)
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def found(spark, rows, kind="double", **more):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "n", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, key string, node int")
    return embedding_dedup(df.repartition(4, F.rand(2)), **more)


@pytest.mark.parametrize("block", [16_384, 7])
@pytest.mark.parametrize("kind", ["double", "float"])
def test_against_all_pairs(spark, block, kind):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=24)) for i in range(300)]
    centre = draw.normal(size=24)
    rows += [(1000 + i, near(draw, centre, 0.985)) for i in range(60)]  # many pairs on both sides of the threshold
    rows += [(2000 + i, np.full(24, 2.0 ** (i % 3))) for i in range(40)]  # copies, and copies of another length
    chain = [draw.normal(size=24)]
    for i in range(12):
        chain.append(near(draw, chain[-1], 0.97))
    rows += [(3000 - i, v) for i, v in enumerate(chain)]
    rows = [(i, np.round(v, 4).astype(np.float32)) for i, v in rows]
    rows = [(i, list(map(float, v))) for i, v in rows]
    out = found(spark, rows, kind, block=block, missed=1e-9).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == sorted(plain(rows))
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_odd_rows(spark):
    big, small = [1e308, 1e308, 0.0], [5e-324, 5e-324, 0.0]
    rows = [(1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (8, [3.0]), (9, [-1.0]), (10, big), (11, small), (12, [1.0, 1.0]), (13, [1.0, 1.0]), (13, [1.0, 1.0]), (14, [0.0, 1.0]), (14, [-0.0, 2.0]), (None, [1.0, 1.0]), (None, None), (15, [1.0, 1.0, 0.0]), (13, [0.0, -1.0])]
    got = [(r.vec_id, r.n_links, r.component_id) for r in found(spark, rows).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))
    assert found(spark, []).collect() == []
    assert [tuple(r) for r in found(spark, [(5, None)]).collect()] == [(5, 0, 5, True)]


def test_recall_at_the_threshold():
    """Pairs barely above the threshold meet, at any size that the functions are chosen for."""
    draw = np.random.default_rng(9)
    x = draw.normal(size=(1500, 64))
    y = np.array([near(draw, v, 0.9501) for v in x])
    for n in (500, 50_000, 50_000_000):
        h = hashing(n, 64)
        a, b = h.buckets(x / np.linalg.norm(x, axis=1)[:, None]), h.buckets(y)
        met = np.zeros(len(x), bool)
        for t in range(h.tables):
            met |= (a[:, t, :1] == b[:, t]).any(1) | (b[:, t, :1] == a[:, t]).any(1)
        assert met.mean() > 0.99, (n, h)
    assert hashing(500, 64).functions < hashing(50_000_000, 64).functions


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose((hadamard(x) ** 2).sum(1), 64 * (x**2).sum(1))
    b = Hashing(64, 2, 3).buckets(x)
    assert b.shape == (5, 3, 3) and len(np.unique(b[0])) == 9


def test_given_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/check_h/embeddings.parquet").where("vec_id % 4 = 1").collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup(df).collect())
    want = sorted(plain([(i, list(map(float, v))) for i, v in rows]))
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want) > 1000 and sum(g != w for g, w in zip(got, want)) <= len(want) // 100
