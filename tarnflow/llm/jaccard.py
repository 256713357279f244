"""Exact n-gram Jaccard self-join with a token-group matrix.

Documents are sets of word shingles; two link when their Jaccard similarity
reaches the threshold.  Documents with the same set are one node.  Only
reachability is asked for, so pairs of nodes that are connected already are
never compared.

* Prefixes: a prefix holds a set's first ``n - ceil(t n) + 1`` shingles in one
  global order; sets that link share a shingle of both prefixes.  The order puts
  shingles that many documents have last.  It comes from a table of SKETCH
  counters into which the shingles of all documents fall: its size is fixed, and
  its counts decide how many groups qualify, never the result.
* Leaders: nodes with the same least shingle hash, and then nodes with the same
  prefix shingle, are compared with one leader each.  That connects most copies.
* Groups: nodes that share a shingle with something they are not connected with
  are partitioned into groups of similar ones, each with the most frequent of its
  such shingles; a large group is cut into blocks of bounded size.
* Matrix: for each group the union of its prefix shingles is stored as (shingle,
  group) rows, with the least size and the furthest reach of the sets behind it.
  A query's overlap with any member of a group is bounded by these; only where
  the bound meets the threshold, and query and group are not connected as a
  whole, does the group qualify.
* Opening: the queries that qualify for a pair of blocks meet in one task, first
  with counts of their shingles by bucket, which bound every overlap; the whole
  sets follow only of queries that may still link.  A query that shares too few
  shingles with the union of the others is closed at once; else its overlaps with
  all of them are counted from posting lists.  Only links that connect two
  components leave the task, fewer than it has rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.components import components
from tarnflow.llm.shared import SPACED, dropped, grams, id_and_text, memory_returned, mix, text_steps, written

SHINGLE_WORDS, PERCENT = 5, 75
#: Counters of shingles, in rows of CHUNK.
SKETCH, CHUNK = 1 << 22, 1 << 12
#: Sets, and shingles of them, in a block of a group.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1 << 20
#: Buckets of a profile at least and at most (a power of two each).
LEAST_BUCKETS, MOST_BUCKETS = 8, 1 << 14
#: Ids up to which a table of them is broadcast (8 MB of longs); beyond, a shuffle join.
BROADCAST_IDS = 1_000_000


def shingle_sets(batch: pa.RecordBatch, k: int = SHINGLE_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes); fewer than k words are one shingle, none are an empty set."""
    for i, j, data, ends in text_steps(batch):
        words, _, _, doc = SPACED.hashed(data, ends)
        cuts = np.searchsorted(doc, np.arange(j - i + 1))
        all_grams = grams(words, k)
        for r in range(j - i):
            a, b = cuts[r], cuts[r + 1]
            yield i + r, np.unique(all_grams[a : b - k + 1]) if b - a >= k else grams(words[a:b], b - a) if b > a else words[:0]


def _levels(docs: DataFrame) -> np.ndarray:
    """For each counter the level (eight to a doubling) of the number of shingles that fall into it, over all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for _, _, data, ends in text_steps(batch):
                words, _, _, doc = SPACED.hashed(data, ends)
                found = grams(words, SHINGLE_WORDS)[doc[: max(len(doc) - SHINGLE_WORDS + 1, 0)] == doc[SHINGLE_WORDS - 1 :]]
                np.add.at(counts, (found & np.uint64(SKETCH - 1)).astype(np.intp), np.uint32(1))
        if counts.any():
            yield _chunks(np.minimum(counts, 65_535).astype(np.uint16))
        del counts
        memory_returned()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[at] = sums.get(at, 0) + np.frombuffer(part.as_buffer(), np.uint16).astype(np.int64)
        levels = [np.minimum(8 * np.log2(1.0 + x), 255).astype(np.uint8) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([x.tobytes() for x in levels], pa.binary())], ["at", "part"])

    rows = docs.select("text").mapInArrow(counted, "at int, part binary").repartition("at").mapInArrow(summed, "at int, part binary").toArrow()  # SKETCH bytes
    out = np.zeros(SKETCH, np.uint8)
    for at, part in zip(rows["at"].to_pylist(), rows["part"].to_pylist()):
        out[at * CHUNK : (at + 1) * CHUNK] = np.frombuffer(part, np.uint8)
    return out


def _chunks(counts: np.ndarray) -> pa.RecordBatch:
    rows = counts.reshape(-1, CHUNK)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], ["at", "part"])


def in_order(s: np.ndarray, levels: np.ndarray, most: int) -> np.ndarray:
    """The first shingles of a set in the global order: by level, then by hash."""
    key = (levels[(s & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
    return s[np.argsort(key, kind="stable")[:most]]


def _first_of_copies(sets: DataFrame) -> DataFrame:
    """(sig, node): the least id of each set of shingles, written."""
    return written(sets.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("node")))


def _later(sets: DataFrame, copies: DataFrame) -> DataFrame:
    """Ids of documents that are no node: copies of a node, and such without shingles."""
    return sets.join(copies.select(F.col("node").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


def profile(s: np.ndarray) -> bytes:
    """Counts of a set's shingles by bucket; none (no bound) where a bucket has more than a byte can count."""
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (max(len(s) // 2, 1) - 1).bit_length()))
    counts = np.bincount((mix(s) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def overlap_bound(one: bytes, two: bytes) -> int:
    """No two sets of these profiles have more shingles in common."""
    if not one or not two:
        return 1 << 62
    a, b = np.frombuffer(one, np.uint8).astype(np.int64), np.frombuffer(two, np.uint8).astype(np.int64)
    size = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, size).sum(0), b.reshape(-1, size).sum(0)).sum())


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), sig (of the whole set), g1, g2 (least hashes), profile, prefix (its first shingles in the global order)."""
    sent = docs.sparkSession.sparkContext.broadcast(_levels(docs))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig, g1, g2, profiles, prefix = [], [], [], [], [], []
            for _, s in shingle_sets(batch):
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                g1.append(int(mix(s ^ np.uint64(11)).min().view(np.int64)) if len(s) else 0)
                g2.append(int(mix(s ^ np.uint64(23)).min().view(np.int64)) if len(s) else 0)
                profiles.append(profile(s))
                prefix.append(in_order(s, sent.value, len(s) - -(-PERCENT * len(s) // 100) + 1).view(np.int64) if len(s) else s.view(np.int64))
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            flat = pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(g1, pa.int64()), pa.array(g2, pa.int64()), pa.array(profiles, pa.binary()), pa.ListArray.from_arrays(pa.array(cuts), flat)], ["doc_id", "n", "sig", "g1", "g2", "profile", "prefix"])
        memory_returned()

    return written(docs.mapInArrow(described, "doc_id long, n long, sig binary, g1 long, g2 long, profile binary, prefix array<long>"))


def _may_link(n: Column, m: Column) -> Column:
    """Sizes are near enough for the threshold."""
    return (100 * n >= PERCENT * m) & (100 * m >= PERCENT * n)


def _may_reach(rest: Column, other: Column, sizes: Column) -> Column:
    """The overlap is large enough even if the first common shingle has only so many from it on in either set."""
    return (100 + PERCENT) * F.least(rest, other) >= PERCENT * sizes


def _packed(n: Column, at: Column, many: bool) -> Column:
    """Set size, place of the shingle and whether the row stands for a group, as one number (rows are many)."""
    return F.shiftleft(n, 32) + at.cast("long") * 2 + int(many)


def _unpacked(info: str) -> tuple[Column, Column]:
    """Set size and place of :func:`_packed`."""
    return F.shiftright(info, 32).alias("n"), F.shiftright(info, 1).bitwiseAND(0x7FFFFFFF).alias("at")


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of ids that may link by their profiles, written."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(100 + PERCENT) * overlap_bound(x, y) >= PERCENT * (n + m) for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    pairs = written(pairs.distinct())
    known = sets.select("doc_id", "n", "profile").join(_sent(_ends(pairs)), "doc_id", "left_semi")
    one = known.select(F.col("doc_id").alias("a"), F.col("n").alias("n1"), F.col("profile").alias("p1"))
    two = known.select(F.col("doc_id").alias("b"), F.col("n").alias("n2"), F.col("profile").alias("p2"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "n1", "n2", "p1", "p2")
    out = written(both.mapInArrow(bounded, "a long, b long").distinct())
    dropped(pairs)
    return out


def _whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, tokens) of the documents with these ids, written."""

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            rows, size, at = [], 0, 0
            for r, s in shingle_sets(batch):
                rows.append(s.tobytes())
                size += len(rows[-1])
                if size > 32 << 20 or r + 1 == len(names):
                    yield pa.RecordBatch.from_arrays([names.slice(at, len(rows)), pa.array(rows, pa.binary())], ["doc_id", "tokens"])
                    rows, size, at = [], 0, r + 1

    return written(docs.join(_sent(ids), "doc_id", "left_semi").mapInArrow(as_bytes, "doc_id long, tokens binary"))


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose documents link, by comparing the whole sets of those that may."""
    pairs = _possible(pairs, sets)
    whole = _whole_sets(docs, _ends(pairs))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2), batch.column(3)):
                s, t = (np.frombuffer(x.as_buffer(), np.uint64) for x in (s, t))
                both = np.concatenate([s, t])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= PERCENT * (len(both) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    one, two = whole.select(F.col("doc_id").alias("a"), F.col("tokens").alias("s")), whole.select(F.col("doc_id").alias("b"), F.col("tokens").alias("t"))
    near = pairs.join(one, "a").join(two, "b").where(_may_link(F.length("s"), F.length("t")))
    out = written(near.select("a", "b", "s", "t").mapInArrow(compared, "a long, b long"))
    dropped(whole)
    dropped(pairs)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    """The distinct ids of pairs."""
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()


def connecting(now: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (places in ``sets``) that connect components; ``now``: the component of each set so far."""
    _, comp = np.unique(now, return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
    many = np.diff(first, append=len(flat))
    run = np.empty(len(flat), np.int32)  # of each shingle of each set, in order
    run[order] = np.repeat(np.arange(len(first), dtype=np.int32), many)
    owners = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order]
    del flat, order
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    links = []
    for q in range(len(sets)):
        others = (comp != comp[q]) & (100 * sizes >= PERCENT * sizes[q]) & (100 * sizes[q] >= PERCENT * sizes)
        if not others.any():
            continue
        shared = run[cuts[q] : cuts[q + 1]]
        shared = shared[many[shared] > 1]
        if (100 + PERCENT) * len(shared) < PERCENT * (sizes[q] + sizes[others].min()):
            continue  # the union of all others has too few of its shingles
        size = many[shared]
        ends = np.cumsum(size)
        overlap = np.bincount(owners[np.repeat(first[shared] - (ends - size), size) + np.arange(ends[-1])], minlength=len(sets))
        for y in np.flatnonzero(others & (100 * overlap >= PERCENT * (sizes[q] + sizes - overlap))).tolist():
            if comp[y] != comp[q]:
                links.append((q, y))
                comp[comp == comp[y]] = comp[q]
    return links


def reachable(now: np.ndarray, n: np.ndarray, profiles: list[bytes]) -> np.ndarray:
    """For each set whether its overlap with some set of another component may suffice, by their profiles."""
    counts = [np.frombuffer(p, np.uint8) for p in profiles]
    width = np.array([len(c) for c in counts])
    _, comp = np.unique(now, return_inverse=True)
    out = np.zeros(len(n), bool)
    folded: dict[tuple[int, int], np.ndarray] = {}  # (width, folded to) -> a row for each set of that width
    of = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}

    def rows(w: int, to: int) -> np.ndarray:
        if (w, to) not in folded:
            folded[w, to] = np.stack([counts[i].astype(np.int16).reshape(-1, to).sum(0) for i in of[w]])
        return folded[w, to]

    for q in range(len(n)):
        able = (comp != comp[q]) & (100 * n >= PERCENT * n[q]) & (100 * n[q] >= PERCENT * n)
        for w, at in of.items():
            some = able[at]
            if out[q] or not some.any():
                continue
            if not w or not width[q]:  # a profile without a bound
                out[q] = True
                continue
            to = int(min(w, width[q]))
            own = counts[q].astype(np.int16).reshape(-1, to).sum(0)
            bound = np.minimum(rows(w, to)[some], own).sum(1)
            out[q] = bool(((100 + PERCENT) * bound >= PERCENT * (n[q] + n[at][some])).any())
    return out


def _qualified(queries: DataFrame, sets: DataFrame) -> DataFrame:
    """The queries (one, two, node, now) that may link with another set of their pair of blocks, written.

    Only profiles are sent for this, a few bytes for each shingle bucket.
    """
    names = ["one", "two", "node", "now"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []

        def kept() -> pa.RecordBatch:
            keep = reachable(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [r[3] for r in rows]) if len(rows) > 1 else [False] * len(rows)
            left = [r for r, k in zip(rows, keep) if k]
            return pa.RecordBatch.from_arrays([pa.array([unit[0]] * len(left), pa.int64()), pa.array([unit[1]] * len(left), pa.int64()), pa.array([r[0] for r in left], pa.int64()), pa.array([r[1] for r in left], pa.int64())], names)

        for batch in batches:
            for *at, node, now, n, profile in zip(*(c.to_pylist() for c in batch.columns)):
                if at != unit:
                    if rows:
                        yield kept()
                    unit, rows = at, []
                rows.append((node, now, n, profile))
        if rows:
            yield kept()

    known = sets.select(F.col("doc_id").alias("node"), "n", "profile").join(_sent(queries.select("node").distinct()), "node", "left_semi")
    met = queries.join(known, "node").select(*names, "n", "profile").repartition("one", "two").sortWithinPartitions("one", "two", "node")
    return written(met.mapInArrow(judged, "one long, two long, node long, now long").distinct())


def _opened(rows: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect what shares a prefix shingle and is still apart; ``rows``: token, node, n, at, now."""
    def fits(n: Column, at: Column) -> Column:
        """A set may link with one of those that least, most, reach, lo and hi stand for, and is not connected with all of them."""
        sizes = (100 * n >= PERCENT * F.col("least")) & (100 * F.col("most") >= PERCENT * n)
        return ((F.col("now") != F.col("lo")) | (F.col("now") != F.col("hi"))) & sizes & _may_reach(n - at, F.col("reach"), n + F.col("least"))

    bounds = [F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("at")).alias("reach"), F.min("now").alias("lo"), F.max("now").alias("hi")]
    tokens = rows.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("shingles"), *bounds)
    rows = written(rows.join(tokens, "token").where(fits(F.col("n"), F.col("at"))).select("token", "node", "n", "at", "now", "many", "shingles"))
    home = rows.groupBy("node").agg(F.max(F.struct("many", "token", "shingles")).alias("home"))
    parts = F.ceil(F.greatest(F.col("home.many") / BLOCK_SETS, F.col("home.shingles") / BLOCK_SHINGLES))
    home = home.select("node", F.xxhash64("home.token", F.pmod(F.xxhash64("node"), parts)).alias("block"))
    cells = written(rows.select("token", "node", "n", "at", "now").join(home, "node"))

    matrix = cells.groupBy("token", "block").agg(*bounds).withColumnRenamed("block", "group")
    queries = cells.join(matrix, "token").where(fits(F.col("n"), F.col("at")))
    queries = queries.select(F.least("block", "group").alias("one"), F.greatest("block", "group").alias("two"), "node", "now").distinct()
    queries = _qualified(written(queries), sets)
    whole = _whole_sets(docs, queries.select(F.col("node").alias("doc_id")).distinct())

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, node, now, sets = None, [], [], []

        def links() -> pa.RecordBatch:
            found = connecting(np.array(now), sets) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([node[x[k]] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for *at, x, y, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if at != unit:
                    if sets:
                        yield links()
                    unit, node, now, sets = at, [], [], []
                node.append(x)
                now.append(y)
                sets.append(np.frombuffer(tokens, np.uint64))
        if sets:
            yield links()
        sets = []
        memory_returned()

    met = queries.join(whole.withColumnRenamed("doc_id", "node"), "node").select("one", "two", "node", "now", "tokens")
    met = met.repartition("one", "two").sortWithinPartitions("one", "two", "node", F.length("tokens"))
    out = written(met.mapInArrow(compared, "a long, b long"))
    dropped(whole)
    dropped(queries)
    dropped(cells)
    dropped(rows)
    return out


def _sent(ids: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if a count shows that it is small."""
    ids = written(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable over links) of every row.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.
    Null and empty texts have no shingles and link with nothing.  Texts of equal
    sets link; so all copies are in one component.  Rows that share an id count
    as one document for links.  No link is lost; an empty table works.
    """
    docs = id_and_text(df, id_col, text_col)
    sets = _sets(docs)
    copies = _first_of_copies(sets)
    nodes = sets.where("n > 0").join(copies.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumnRenamed("doc_id", "node")

    # groups: each node against the leader of the nodes with the same least hash
    stars = []
    for g in ("g1", "g2"):
        leader = nodes.groupBy(g).agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
        near = nodes.select("node", "n", g).join(leader, g).where(F.col("node") != F.col("lead.node")).where(_may_link(F.col("n"), F.col("lead.n")))
        stars.append(near.select(F.col("lead.node").alias("a"), F.col("node").alias("b")))
    links = verified(stars[0].union(stars[1]), docs, sets)
    labels = written(components(links))

    # matrix: which group has which prefix shingle; a row names the group by one of its nodes
    later = _later(sets, copies)
    alone = sets.where("n > 0").join(_sent(later.union(labels.select("node")).distinct()), "doc_id", "left_anti").select(F.col("doc_id").alias("node"), "n", "prefix")
    together = written(sets.join(_sent(labels.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "n", "prefix"))
    info = _packed(F.col("n"), F.col("at"), False)
    rows = together.join(labels, "node").select("component", "node", "n", F.explode("prefix").alias("token"))
    unions = rows.groupBy("token", "component").agg(F.min(F.struct("node", "n")).alias("x")).select("token", "x.node", _packed(F.col("x.n"), F.lit(0), True).alias("info"))
    matrix = alone.select("node", "n", F.posexplode("prefix").alias("at", "token")).select("token", "node", info.alias("info")).union(unions).repartition("token")  # both uses below read this one shuffle
    first = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("groups"), F.min(F.struct("node", "info")).alias("lead")).where("groups > 1").select("token", "lead")
    shared = written(matrix.join(first, "token"))
    shared = shared.select("token", "node", *_unpacked("info"), (F.col("info") % 2 == 1).alias("many"), F.struct("lead.node", *_unpacked("lead.info")).alias("lead"))

    # one node of each group that qualifies
    ones = shared.where(F.col("node") != F.col("lead.node"))
    ones = ones.where(_may_link(F.col("n"), F.col("lead.n")) & _may_reach(F.col("n") - F.col("at"), F.col("lead.n") - F.col("lead.at"), F.col("n") + F.col("lead.n")))
    links = links.union(verified(ones.select(F.col("lead.node").alias("a"), F.col("node").alias("b")), docs, sets))
    labels = written(components(links))

    # what shares a shingle and is still apart
    by_node = labels.withColumnRenamed("component", "now")
    still = shared.join(by_node, "node", "left").withColumn("now", F.coalesce("now", "node"))
    apart = written(still.groupBy("token").agg(F.min("now").alias("x"), F.max("now").alias("y")).where("x <> y").select("token"))
    members = together.select("node", "n", F.posexplode("prefix").alias("at", "token")).select("token", "node", "n", "at")
    rows = shared.where(~F.col("many")).select("token", "node", "n", "at").union(members).join(apart, "token", "left_semi")
    rows = written(rows.join(by_node, "node", "left").select("token", "node", "n", "at", F.coalesce("now", "node").alias("now")))
    links = links.union(_opened(rows, docs, sets))

    ends = copies.join(components(links), "node", "left").select("sig", F.coalesce("component", "node").alias("component_id"))
    return sets.select("doc_id", "n", "sig").join(ends, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (with a doc_id and text) but those that link, over any path, with a document of smaller id.

    Rows with a null id stay.
    """
    found = jaccard_components(df.where("doc_id IS NOT NULL"))
    drop = _sent(found.where("component_id <> doc_id").select("doc_id").distinct())
    return df.join(drop, "doc_id", "left_anti").select(df.columns)
