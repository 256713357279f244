"""Near-duplicate embeddings by cross-polytope hashing.

A hash function is a pseudo-random rotation, three rounds of random signs and a
fast Hadamard transform, and then the nearest vertex of the cross-polytope: the
coordinate of the largest magnitude with its sign.  A table joins the values of
several functions to a bucket.  A vector is stored in one bucket of each table
and looks into the next nearest ones too (multiprobe); a stored vector and
another that is stored there or looks in are a candidate pair, and candidates are
compared by their cosine in double precision.

The number of functions of a table grows with the logarithm of the number of
vectors, so that buckets stay small; the number of tables follows from the
collision rate of pairs that are exactly at the threshold, measured on simulated
ones, so that such a pair is missed by all tables in one of ten thousand cases only.

Equal vectors are one class from the start, so copies meet in a count.  Only
buckets with a candidate pair get vectors, and a bucket with very many members is
cut into blocks, which are compared in pairs, each in a group of its own.  Tasks
hand on sums and spanning links, one row for each vector of a block, never pairs.
A pair that meets in several buckets counts in the first one.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tarnflow.llm.components import components
from tarnflow.llm.shared import bounded_batches, dropped, memory_returned, mix, written

THRESHOLD = 0.95
#: Share of the pairs at the threshold that all tables may miss.
MISSED = 0.0001
#: Buckets of a table for each vector, at least.
BUCKETS = 16
#: Further buckets of a table that a vector looks into.
PROBES = 2
#: Members of a bucket that meet in one group; vectors that are compared at once; members of a group of buckets on average.
BLOCK, STEP, SHARE = 16_384, 1024, 20_000
#: Coordinates that take part in the search for the next nearest buckets, in each function.
_NEXT = 3
#: Members of a bucket whose pairs are looked through together with those of others.
_SMALL = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows; their length is a power of two."""
    size, half = x.shape[1], 1
    while half < size:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), size)
        half *= 2
    return x


@dataclass(frozen=True)
class Hashing:
    """``tables`` tables of ``functions`` hash functions for vectors of one length."""

    length: int
    functions: int
    tables: int
    probes: int = PROBES

    @cached_property
    def signs(self) -> np.ndarray:
        size = 1 << max(0, self.length - 1).bit_length()
        return np.random.default_rng([20250905, self.length]).choice([-1.0, 1.0], size=(self.tables, self.functions, 3, size))

    @property
    def shape(self) -> tuple[int, int]:
        """Tables and buckets of a vector in each."""
        return self.tables, 1 + min(self.probes, min(_NEXT, 2 * self.signs.shape[-1]) ** self.functions - 1)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(vector, table, 1 + probes) buckets; the first is where a vector is stored."""
        size = self.signs.shape[-1]
        x = np.pad(x, [(0, 0), (0, size - x.shape[1])])
        near = min(_NEXT, 2 * size)
        choices = list(itertools.product(range(near), repeat=self.functions))
        out = np.zeros((len(x), *self.shape), np.uint64)
        for t in range(self.tables):
            lost, code = [], []
            for signs in self.signs[t]:
                y = x
                for s in signs:
                    y = hadamard(y * s)
                both = np.concatenate([y, -y], axis=1)  # the vertices are the coordinates and their opposites
                at = np.argpartition(-both, near - 1, axis=1)[:, :near] if near < both.shape[1] else np.tile(np.arange(near), (len(x), 1))
                value = np.take_along_axis(both, at, 1)
                order = np.argsort(-value, axis=1, kind="stable")
                at, value = np.take_along_axis(at, order, 1), np.take_along_axis(value, order, 1)
                lost.append((value[:, :1] - value) ** 2)
                code.append(at.astype(np.uint64))
            loss = np.stack([sum(lost[f][:, c] for f, c in enumerate(choice)) for choice in choices], 1)
            loss[:, 0] = -1.0
            best = np.argsort(loss, axis=1, kind="stable")[:, : out.shape[2]]
            start = mix(np.array([(self.length << 20) + t], np.uint64))  # no bucket belongs to two tables
            full = []
            for choice in choices:
                h = np.repeat(start, len(x))
                for f, c in enumerate(choice):
                    h = mix(h ^ code[f][:, c])
                full.append(h)
            out[:, t] = np.take_along_axis(np.stack(full, 1), best, 1)
        return out


def _met(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether buckets (row, 1 + probes) of one table make candidates: either is stored where the other is stored or looks in."""
    return (x[:, :1] == y).any(1) | (y[:, :1] == x).any(1)


def hashing(n: int, length: int, threshold: float = THRESHOLD, missed: float = MISSED) -> Hashing:
    """Functions from the number of vectors, tables from the simulated rate at which pairs at the threshold meet."""
    vertices = 2 << max(0, length - 1).bit_length()
    functions = max(1, min(6, math.ceil(math.log(max(BUCKETS * n, 2)) / math.log(vertices))))
    draw = np.random.default_rng(7)
    x, z = draw.normal(size=(2, 2000, length))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if length > 1:
        z -= (z * x).sum(1)[:, None] * x
        z /= np.maximum(np.linalg.norm(z, axis=1), 1e-300)[:, None]
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * z if length > 1 else x
    some = Hashing(length, functions, 4)
    a, b = some.buckets(x), some.buckets(y)
    rate = np.mean([_met(a[:, t], b[:, t]).mean() for t in range(4)]) - 0.02  # less the error of the simulation
    return Hashing(length, functions, max(1, math.ceil(math.log(missed) / math.log(max(1e-6, 1 - rate)))))


def _prepared(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, key, length, vector) of every row: the vector's numbers as bytes and their digest, null where it has no direction."""
    floats = isinstance(df.schema[vector_col].dataType, ArrayType) and isinstance(df.schema[vector_col].dataType.elementType, FloatType)
    kind = np.float32 if floats else np.float64

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(kind) + kind(0)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            some = np.concatenate([[0], np.cumsum(values != 0)])
            fine = (np.diff(bad[ends], prepend=0) == 0) & (np.diff(some[ends], prepend=0) > 0)
            data, width = values.tobytes(), values.itemsize
            vectors = [data[a * width : b * width] if ok else None for ok, a, b in zip(fine.tolist(), (ends - sizes).tolist(), ends.tolist())]
            keys = [v and hashlib.blake2b(v, digest_size=16).digest() for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes), pa.array(vectors, pa.binary())], ["vec_id", "key", "length", "vector"])

    kept = bounded_batches(df).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{'float' if floats else 'double'}>").alias("vector"))
    return kept.mapInArrow(prepared, "vec_id long, key binary, length long, vector binary")


def _matrix(vectors: pa.Array, length: int, kind: type) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(vectors.to_pylist()), kind).reshape(-1, length).astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _entries(classes: DataFrame, hashings: dict[int, Hashing], kind: type) -> DataFrame:
    """(bucket, turn, node, stored): the buckets of each vector; turn is their table."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).to_numpy()
            for length in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == length))
                found = hashings[length].buckets(_matrix(part.column(2), length, kind))
                n, tables, each = found.shape
                yield pa.RecordBatch.from_arrays([
                    pa.array(found.reshape(-1).view(np.int64)), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), each), n)),
                    pa.array(np.repeat(part.column(0).to_numpy(), tables * each)), pa.array(np.tile(np.arange(each) == 0, n * tables)),
                ], ["bucket", "turn", "node", "stored"])
        memory_returned()

    return classes.select("node", "length", "vector").mapInArrow(placed, "bucket long, turn int, node long, stored boolean")


def _spanned(met: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least node that each row and column of a block reaches by links inside it."""
    left, right = rows.copy(), cols.copy()
    most = np.iinfo(np.int64).max
    while True:
        new = np.minimum(left, np.where(met, right, most).min(1))
        other = np.minimum(right, np.where(met, new[:, None], most).min(0))
        if (new == left).all() and (other == right).all():
            return left, right
        left, right = new, other


def _compared(cell: dict[str, np.ndarray], buckets: np.ndarray, matrix: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, rows that it is linked with, a node that it reaches) of the members of one cell of a bucket."""
    bucket, turn = cell["bucket"][0], int(cell["turn"][0])
    sides = [np.flatnonzero(cell["side"] == 0), np.flatnonzero(cell["side"] == 1)]
    inside = not len(sides[1])
    first, second = sides[0], sides[0] if inside else sides[1]
    for i in range(0, len(first), STEP):
        for j in range(i if inside else 0, len(second), STEP):
            p, q = first[i : i + STEP], second[j : j + STEP]
            met = matrix[p] @ matrix[q].T >= threshold
            met &= cell["stored"][p][:, None] | cell["stored"][q][None, :]
            if inside and i == j:
                met &= np.triu(np.ones(met.shape, bool), 1)
            a, b = np.nonzero(met)
            if not len(a):
                continue
            x, y = buckets[p], buckets[q]
            fresh = np.ones(len(a), bool)
            for t in range(turn):
                fresh[fresh] = ~_met(x[a[fresh], t], y[b[fresh], t])
            u, v = x[a, turn], y[b, turn]
            least = np.minimum(np.where((u[:, :1] == v).any(1), u[:, 0], np.uint64(2**64 - 1)), np.where((v[:, :1] == u).any(1), v[:, 0], np.uint64(2**64 - 1)))
            fresh &= least == bucket
            met[a[~fresh], b[~fresh]] = False
            if not fresh.any():
                continue
            rows, cols = cell["node"][p], cell["node"][q]
            left, right = _spanned(met, rows, cols)
            for node, links, reached in ((rows, met @ cell["n"][q], left), (cols, met.T @ cell["n"][p], right)):
                some = links > 0
                yield node[some], links[some], reached[some]


def _promising(starts: np.ndarray, ends: np.ndarray, place: np.ndarray, stored: np.ndarray, matrix: np.ndarray, threshold: float) -> np.ndarray:
    """Which cells have a candidate pair over the threshold, or so many members that this is not looked at here."""
    sizes = ends - starts
    out = sizes > _SMALL
    small = np.flatnonzero(~out)
    step = max(1, STEP * STEP // 16 // (_SMALL * _SMALL // 2))
    for s in range(0, len(small), step):
        some = small[s : s + step]
        cell = np.repeat(some, sizes[some])
        row = np.arange(len(cell)) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some]) + starts[cell]
        after = ends[cell] - row - 1  # members of the cell after this one
        left = np.repeat(row, after)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
        met = (stored[left] | stored[right]) & (np.einsum("ij,ij->i", matrix[place[left]], matrix[place[right]]) >= threshold - 1e-9)
        out[np.repeat(cell, after)[met]] = True
    return out


def _links(members: DataFrame, hashings: dict[int, Hashing], kind: type, threshold: float) -> DataFrame:
    """(node, links, other): sums of links by blocks, and spanning links."""

    def linked(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bucket", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")]).combine_chunks()
        out = []
        if len(table):
            cols = {c: table[c].to_numpy() for c in ("turn", "i", "j", "side", "node", "n", "stored", "length")}
            cols["bucket"] = table["bucket"].to_numpy().view(np.uint64)
            new = np.flatnonzero(np.concatenate([[True], (np.diff(cols["bucket"]) != 0) | (np.diff(cols["i"]) != 0) | (np.diff(cols["j"]) != 0)]))
            ends = np.append(new[1:], len(table))
            vectors = table["vector"].combine_chunks()
            for length in np.unique(cols["length"]).tolist():
                own = np.flatnonzero(cols["length"][new] == length)
                rows = np.flatnonzero(cols["length"] == length)
                _, one, back = np.unique(cols["node"][rows], return_index=True, return_inverse=True)
                matrix = _matrix(vectors.take(pa.array(rows[one])), length, kind)
                place = np.full(len(table), -1)
                place[rows] = back
                own = own[_promising(new[own], ends[own], place, cols["stored"], matrix, threshold)]
                wanted = np.unique(place[np.concatenate([np.arange(a, b) for a, b in zip(new[own], ends[own])])]) if len(own) else own
                buckets = np.zeros((len(matrix), *hashings[length].shape), np.uint64)
                for s in range(0, len(wanted), 4096):
                    buckets[wanted[s : s + 4096]] = hashings[length].buckets(matrix[wanted[s : s + 4096]])
                for a, b in zip(new[own].tolist(), ends[own].tolist()):
                    at = place[a:b]
                    out += [pa.table({"node": n, "links": k.astype(np.int64), "other": o}) for n, k, o in _compared({c: v[a:b] for c, v in cols.items()}, buckets[at], matrix[at], threshold)]
        memory_returned()
        return pa.concat_tables([pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())]).empty_table(), *out])

    return members.groupBy("share").applyInArrow(linked, "node long, links long, other long")


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, missed: float = MISSED, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest id reachable by links) and kept of every row.

    Rows link when their cosine in double precision is at least ``threshold`` and
    they meet in a bucket; ``missed`` is the share of pairs at the threshold that
    may meet in none.  Vectors of different lengths link with nothing of another
    length; null, empty and zero vectors, those with null or non-finite numbers,
    and rows with a null id link with nothing at all.  Rows that share an id and
    a vector are copies of each other and count each; rows that share an id only
    are apart.  Other columns are not read; an empty table gives an empty result.
    ``block`` bounds what meets in one group and changes no result.
    """
    spark = df.sparkSession
    rows = _prepared(df, id_col, vector_col)
    kind = np.float32 if isinstance(df.schema[vector_col].dataType.elementType, FloatType) else np.float64
    classes = rows.where("vec_id IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("length").alias("length"), F.first("vector").alias("vector"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "*"))
    sizes = {r.length: r.n for r in classes.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    hashings = {length: hashing(n, length, threshold, missed) for length, n in sizes.items()}

    entries = _entries(classes, hashings, kind)
    live = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.max("stored").alias("any")).where("members > 1 AND any")
    live = written(live.select("bucket", F.ceil(F.col("members") / block).cast("int").alias("blocks"), "members"))
    members = entries.join(live, "bucket")
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    cells = members.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = cells.select("bucket", "turn", "node", "stored", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    count = live.agg(F.sum(F.col("members") * F.col("blocks"))).first()[0] or 0
    shares = max(1, -(-count // SHARE))
    cells = cells.withColumn("share", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(shares)).cast("int"))
    links = written(_links(cells.join(classes.select("node", "n", "length", "vector"), "node"), hashings, kind, threshold))

    direct = links.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    of_class = classes.select("key", "node", "n", "least").join(direct, "node", "left").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = written(of_class.join(least, "component").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.col("component_id").alias("reached")))
    dropped(links)
    dropped(live)
    joined = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(of_class, "key", "left")
    component = F.coalesce("reached", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
