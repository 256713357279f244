"""Alignment of the tokens of two tokenizers, each distinct segment of text once.

Texts are cut into segments before runs of white space.  A cut is made only at
white space that :func:`safe_breaks` has verified: no entry of either vocabulary
goes across such a place, so the tokens of a text are the tokens of its segments,
one after the other, and no group of an alignment goes across either.

Distinct segments are counted over the corpus.  The most frequent ones, in a table
of bounded size, are tokenised and aligned once for all; that table joins every
task, where a document's segments find their alignments by two 64-bit hashes.  The
segments outside it are rare, and their alignments are some ten times as long as
they are, so a shuffle of these back to the documents moves several times the
input (README has figures): a batch of documents aligns its own rare segments,
each distinct one once.  A document is put together from its segments' alignments.

How many documents hold an id pair linked is counted over the distinct pairs of
each document, which are kept with it; the counts are joined back to them, from a
table of bounded size where pairs are frequent and by a shuffle where they are not.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import BASES, bounded_batches, dropped, frequent_head, memory_returned, mix, powers, text_steps, written
from tarnflow.llm.tokens import _byte_alphabet

#: Bounds of the table of frequent segments (rows, bytes of their texts) and of the table of frequent id pairs.
MAX_SEGMENTS, MAX_BYTES, MAX_PAIRS = 1 << 18, 4 << 20, 1 << 20
#: Segments that go to the libraries at once, and their bytes.
STEP_SEGMENTS, STEP_BYTES = 20_000, 1 << 20
#: Segments of documents that are put together at once (or one document with more), and pairs that wait to be added up.
STEP_PLACES, WAITING = 150_000, 1_000_000
_ASCII_SPACE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])
_ASCII_BREAKS = b" \t\n\x0b\x0c\r"


def _after_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space of Unicode (or an ASCII separator)."""
    one = data[at - 1]
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    wide = (two == 0xC2) & np.isin(one, [0x85, 0xA0])
    wide |= (three == 0xE2) & (two == 0x80) & (((one >= 0x80) & (one <= 0x8A)) | np.isin(one, [0xA8, 0xA9, 0xAF]))
    wide |= ((three == 0xE2) & (two == 0x81) & (one == 0x9F)) | ((three == 0xE1) & (two == 0x9A) & (one == 0x80)) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
    return _ASCII_SPACE[one] | wide


def cuts(data: np.ndarray, breaks: bytes) -> np.ndarray:
    """Places (not the first) of a sequence of bytes where a segment begins."""
    at = np.flatnonzero(np.isin(data, list(breaks)))
    at = at[at > 0]
    return at[~_after_space(data, at)] if len(at) else at


def safe_breaks(a_entries: list[bytes], b_entries: list[bytes], b_pieces: list[str]) -> bytes:
    """The white space before which no entry of either vocabulary goes on.

    A sign is left out if some entry has it behind a character that is no white
    space, or if a piece of the second vocabulary joins it with the space that
    this one puts in front of a text.
    """
    signs = set(_ASCII_BREAKS)
    for entry in (*a_entries, *b_entries):
        if len(entry) > 1:
            data = np.frombuffer(entry, np.uint8)
            signs -= set(data[cuts(data, _ASCII_BREAKS)].tolist())
    for sign in set(signs) - {0x20}:
        if any(p.startswith("▁" + chr(sign)) for p in b_pieces):
            signs.discard(sign)
    return bytes(sorted(signs)) if 0x20 in signs else b""


class Tokenizers:
    """The byte-level vocabulary A and the sentence-piece vocabulary B."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has as many workers as cores
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        byte_of = {c: i for i, c in enumerate(_byte_alphabet())}
        self.a_bytes = [b""] * (max(self.a.get_vocab(with_added_tokens=True).values()) + 1)
        for entry, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        self.pairs = len(self.b_bytes)
        self.a_length, self.b_length = (np.array([len(x) for x in e], np.int64) for e in (self.a_bytes, self.b_bytes))
        self.spelled = [[f"{i}{sign}" for i in range(max(len(self.a_bytes), len(self.b_bytes)))] for sign in (",", "|", ";", "")]
        whole = json.loads(self.a.to_str())
        split = whole.get("pre_tokenizer") or {}
        known = whole.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.breaks = safe_breaks(self.a_bytes, self.b_bytes, pieces) if known else b""

    def tokens(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both vocabularies of each segment; B puts a space in front, which the segment has already or which is taken off."""
        a = [x.ids for x in self.a.encode_batch(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[:1] == " " else s for s in segments], num_threads=1)
        out = []
        for segment, ids in zip(segments, b):
            if segment == " ":
                ids = [self.space]
            elif segment[:1] != " ":
                ids = ids[1:] if ids[:1] == [self.space] else [0]
            out.append(ids)
        return a, out


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


@dataclass
class Alignments:
    """Alignments of segments, by columns; ``pairs`` and ``links`` (distinct id pairs and how many links each has) lie end to end."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    pairs: np.ndarray
    links: np.ndarray
    offsets: np.ndarray

    def columns(self) -> list[pa.Array]:
        lists = (pa.ListArray.from_arrays(pa.array(self.offsets.astype(np.int32)), pa.array(x)) for x in (self.pairs, self.links))
        return [pa.array(self.ok), *(pa.array(x) for x in (self.n_a, self.n_b, self.n_groups, self.n_links)), pa.array(self.groups, pa.string()), *lists]

    @classmethod
    def of(cls, table: pa.Table) -> Alignments:
        pairs, links = (table[c].combine_chunks() for c in ("pairs", "links"))
        offsets = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())]).astype(np.int64)
        return cls(*(table[c].to_numpy() for c in COLUMNS[:5]), table["groups"].to_pylist(), pairs.flatten().to_numpy(), links.flatten().to_numpy(), offsets)

    def then(self, more: Alignments) -> Alignments:
        """Both without ``groups``, one after the other."""
        return Alignments(*(np.concatenate([getattr(self, c), getattr(more, c)]) for c in COLUMNS[:5]), [], np.concatenate([self.pairs, more.pairs]), np.concatenate([self.links, more.links]), np.concatenate([self.offsets, self.offsets[-1] + more.offsets[1:]]))


COLUMNS = ["ok", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links"]
_KINDS = "ok boolean, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, links array<long>"
#: Links of one group that are spelled out; of larger groups the distinct ids are multiplied.
_MOST_LINKS = 4096


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes


def _per(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n).astype(np.int64) if len(at) else np.zeros(n, np.int64)


def align_segments(tok: Tokenizers, segments: list[str]) -> Alignments:
    """The alignment of each segment; not ok: the tokens' bytes are not the segment's, and it has no tokens."""
    n = len(segments)
    a_ids, b_ids = tok.tokens(segments)
    data = [s.encode("utf-8", "replace") for s in segments]
    ok = np.array([b"".join(map(tok.a_bytes.__getitem__, x)) == d == b"".join(map(tok.b_bytes.__getitem__, y)) for d, x, y in zip(data, a_ids, b_ids)], bool)
    if not ok.all():
        a_ids, b_ids = ([x if fine else [] for x, fine in zip(ids, ok.tolist())] for ids in (a_ids, b_ids))
    (a, n_a), (b, n_b) = _flat(a_ids), _flat(b_ids)
    a_end, b_end = np.cumsum(tok.a_length[a]), np.cumsum(tok.b_length[b])
    ends = np.intersect1d(a_end, b_end, assume_unique=True)
    a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
    n_ends = len(ends)
    a_size, b_size = np.bincount(a_group, minlength=n_ends), np.bincount(b_group, minlength=n_ends)
    a_first, b_first = np.cumsum(a_size) - a_size, np.cumsum(b_size) - b_size
    segment = np.repeat(np.arange(n), n_a)[a_first]
    size = a_size * b_size

    # the tokens of a group's A, then of its B, and the sign after each
    sign = np.full(len(a) + len(b), 0)
    token = np.empty(len(a) + len(b), np.int64)
    a_at, b_at = np.arange(len(a)) + b_first[a_group], np.arange(len(b)) + (a_first + a_size)[b_group]
    token[a_at], token[b_at] = a, b
    last = a_first + a_size + b_first + b_size - 1
    sign[last - b_size] = 1
    sign[last] = 2
    tokens_of = n_a + n_b
    stop = np.cumsum(tokens_of)
    sign[stop[tokens_of > 0] - 1] = 3
    spelled = [tok.spelled[s][i] for s, i in zip(sign.tolist(), token.tolist())]
    groups = ["".join(spelled[i:j]) for i, j in zip((stop - tokens_of).tolist(), stop.tolist())]

    small = np.flatnonzero(size <= _MOST_LINKS)
    each = size[small]
    of = np.repeat(small, each)
    nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    pair = a[a_first[of] + nth // b_size[of]] * tok.pairs + b[b_first[of] + nth % b_size[of]]
    where, count = segment[of], np.ones(len(of), np.int64)
    for g in np.flatnonzero(size > _MOST_LINKS).tolist():
        (x, m), (y, k) = (np.unique(v, return_counts=True) for v in (a[a_first[g] : a_first[g] + a_size[g]], b[b_first[g] : b_first[g] + b_size[g]]))
        pair = np.concatenate([pair, (x[:, None] * tok.pairs + y).ravel()])
        count = np.concatenate([count, (m[:, None] * k).ravel()])
        where = np.concatenate([where, np.full(len(x) * len(y), segment[g])])
    where, pair, count = _merged(where, pair, count)
    return Alignments(ok, n_a, n_b, np.bincount(segment, minlength=n), _per(size, segment, n), groups, pair, count, np.searchsorted(where, np.arange(n + 1)))


def _merged(row: np.ndarray, pair: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (row, pair) added up, in order."""
    order = np.lexsort((pair, row))
    row, pair, count = row[order], pair[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[new], pair[new], np.add.reduceat(count, new) if len(new) else count


def _all_aligned(tok: Tokenizers, segments: pa.Array) -> Alignments:
    """The same of any number of segments, by bounded steps."""
    parts = [align_segments(tok, segments.slice(i, j - i).to_pylist()) for i, j in _steps(segments)] or [align_segments(tok, [])]
    out = parts[0]
    for more in parts[1:]:
        out = Alignments(*(np.concatenate([getattr(out, c), getattr(more, c)]) for c in COLUMNS[:5]), out.groups + more.groups, np.concatenate([out.pairs, more.pairs]), np.concatenate([out.links, more.links]), np.concatenate([out.offsets, out.offsets[-1] + more.offsets[1:]]))
    return out


def _segments(batch: pa.RecordBatch, column: str, breaks: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, start of each segment and the end, row, both hashes) of texts with a space in front, by steps.

    Empty texts have no segments.
    """
    for i, j, data, ends in text_steps(batch, column):
        begins = np.concatenate([[0], ends[:-1]])
        some = np.flatnonzero(ends > begins)
        data = np.insert(data, begins[some], 0x20)
        first = begins[some] + np.arange(len(some))
        start = np.union1d(cuts(data, breaks), first)
        row = i + some[np.searchsorted(first, start, side="right") - 1]
        bounds = np.append(start, len(data))
        keys = []
        for value, base, key in BASES:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * powers(base, len(data), key), dtype=np.uint64)])
            raw = (total[bounds[1:]] - total[bounds[:-1]]) * powers(pow(base, -1, 1 << 64), len(data), f"{key}-down")[start] if len(start) else np.zeros(0, np.uint64)
            keys.append(mix(raw ^ np.diff(bounds).astype(np.uint64)))
        yield i, j, data, bounds, row, keys[0], keys[1]


def _distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of a row of each distinct pair of hashes, how many rows have it)."""
    order = np.lexsort((y, x))
    new = np.flatnonzero(np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])])) if len(x) else np.zeros(0, np.int64)
    return order[new], np.diff(np.append(new, len(x)))


def _segment_counts(docs: DataFrame, breaks: bytes) -> DataFrame:
    """(segment, x, y, n) of the distinct segments of the texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for _, _, data, bounds, _, x, y in _segments(batch, "text", breaks):
                parts.append((data, x, y, bounds[:-1] + size, bounds[1:] + size))
                size += len(data)
            if not parts:
                continue
            data, x, y, start, stop = (np.concatenate(c) for c in zip(*parts))
            at, n = _distinct(x, y)
            text = data.tobytes()
            spelled = pa.array([text[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist())], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([spelled, pa.array(x[at].view(np.int64)), pa.array(y[at].view(np.int64)), pa.array(n.astype(np.int64))], ["segment", "x", "y", "n"])
        memory_returned()

    return docs.select("text").mapInArrow(counted, "segment string, x long, y long, n long").groupBy("segment", "x", "y").agg(F.sum("n").alias("n"))


def _alignments(segments: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(x, y, ok, n_a, n_b, n_groups, n_links, groups, pairs, links) of each segment."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(a_path, b_path)
        for batch in batches:
            for i, j in _steps(batch.column(0)):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *align_segments(tok, part.column(0).to_pylist()).columns()], ["x", "y", *COLUMNS])
        memory_returned()

    return segments.select("segment", "x", "y").repartition("x", "y").mapInArrow(made, f"x long, y long, {_KINDS}")


def _steps(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with bounded text."""
    sizes = np.cumsum(pc.binary_length(column).to_numpy())
    i = 0
    while i < len(sizes):
        before = sizes[i - 1] if i else 0
        j = min(max(i + 1, int(np.searchsorted(sizes, before + STEP_BYTES, side="right"))), i + STEP_SEGMENTS)
        yield i, j
        i = j


class Frequent:
    """The table of frequent segments; ``number`` finds a segment's row by its hashes."""

    def __init__(self, table: pa.Table):
        x, y = (table[c].to_numpy().view(np.uint64) for c in "xy")
        self.order = np.argsort(x, kind="stable").astype(np.int64)
        self.x, self.y = x[self.order], y[self.order]
        self.rows = Alignments.of(table)

    def number(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Row of each segment, or -1 (equal first hashes of different segments are told apart by the second)."""
        out = np.full(len(x), -1, np.int64)
        if not len(self.x):
            return out
        at = np.searchsorted(self.x, x)
        todo = np.arange(len(x))
        while len(todo):
            here = np.minimum(at[todo], len(self.x) - 1)
            same = (self.x[here] == x[todo]) & (at[todo] < len(self.x))
            hit = same & (self.y[here] == y[todo])
            out[todo[hit]] = self.order[here[hit]]
            todo = todo[same & ~hit]
            at[todo] += 1
        return out


_DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>, pair long, n long"


def _composed(docs: DataFrame, head: Broadcast, a_path: str, b_path: str) -> DataFrame:
    """A row for each document with its distinct id pairs and their links, and rows (pair, n): how many documents have a pair; written."""

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known = tokenizers(a_path, b_path), head.value
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            parts, size = [], 0
            for _, _, data, bounds, row, x, y in _segments(batch, "text", tok.breaks):
                parts.append((data, row, x, y, bounds[:-1] + size, bounds[1:] + size))
                size += len(data)
            if not parts:
                continue
            data, doc, x, y, start, stop = (np.concatenate(c) for c in zip(*parts))
            code = known.number(x, y)
            rare = np.flatnonzero(code < 0)
            order = rare[np.lexsort((y[rare], x[rare]))]
            new = np.ones(len(order), bool)
            new[1:] = (x[order[1:]] != x[order[:-1]]) | (y[order[1:]] != y[order[:-1]])
            code[order] = len(known.rows.ok) + np.cumsum(new) - 1
            text = data.tobytes()
            own = _all_aligned(tok, pa.array([text[a:b] for a, b in zip(start[order[new]].tolist(), stop[order[new]].tolist())], pa.binary()).cast(pa.string()))
            both = known.rows.then(own)

            del data, x, y, start, stop, rare, order, parts
            first = np.searchsorted(doc, np.arange(len(batch) + 1))
            i = 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(first, first[i] + STEP_PLACES, side="right")) - 1)
                of, at = doc[first[i] : first[j]] - i, code[first[i] : first[j]]
                n = j - i
                good = np.bincount(of, ~both.ok[at], n) == 0
                sums = [np.where(good, _per(getattr(both, c)[at], of, n), 0) for c in COLUMNS[1:5]]
                head_groups, own_groups, n_head = known.rows.groups, own.groups, len(known.rows.ok)
                places, sha = at.tolist(), []
                for fine, a, b in zip(good.tolist(), (first[i:j] - first[i]).tolist(), (first[i + 1 : j + 1] - first[i]).tolist()):
                    spelled = ";".join([head_groups[c] if c < n_head else own_groups[c - n_head] for c in places[a:b]]) if fine else ""
                    sha.append(hashlib.sha256(spelled.encode()).hexdigest() if spelled else "")
                row, pair, links = _document_pairs(of[good[of]], at[good[of]], both)
                offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                nothing = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), *map(pa.array, sums), pa.array(sha, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(pair)), pa.ListArray.from_arrays(offsets, pa.array(links)), nothing, nothing], names)
                i = j

                waiting.append(np.unique(pair, return_counts=True))
                if sum(len(p) for p, _ in waiting) > WAITING:
                    waiting = [_added(waiting)]
                    if len(waiting[0][0]) > WAITING // 2:
                        yield _pair_rows(*waiting.pop())
        if waiting:
            yield _pair_rows(*_added(waiting))
        memory_returned()

    names = [c.split()[0] for c in _DOCUMENT.split(", ")]
    rows = docs.select("doc_id", "text").mapInArrow(composed, _DOCUMENT)
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "*"))


def _pair_rows(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    names = [c.split() for c in _DOCUMENT.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([*(pa.nulls(len(pairs), kinds[t]) for _, t in names[:-2]), pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], [c for c, _ in names])


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return pairs, _per(np.concatenate([n for _, n in parts]), at, len(pairs))


def _document_pairs(doc: np.ndarray, code: np.ndarray, rows: Alignments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links) of the distinct pairs of each document, in order."""
    doc, code, times = _merged(doc, code, np.ones(len(doc), np.int64))
    sizes = np.diff(rows.offsets)[code]
    place = np.repeat(rows.offsets[code] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return _merged(np.repeat(doc, sizes), rows.pairs[place], rows.links[place] * np.repeat(times, sizes))


class PairCounts:
    """A bounded table of id pairs: documents that have them, and whether that is the most of their A id."""

    def __init__(self, table: pa.Table):
        order = table.sort_by("pair")
        self.pair, self.n, self.best = (order[c].to_numpy() for c in ("pair", "n", "best"))


def _with_counts(documents: DataFrame, pairs: DataFrame, head: Broadcast) -> DataFrame:
    """(row, count_sum, n_best): over a document's links, their pairs' counts and how many are best."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: PairCounts = head.value
        for batch in batches:
            pair, links = (batch.column(c).flatten().to_numpy() for c in (1, 2))
            row = np.repeat(np.arange(len(batch)), batch.column(1).value_lengths().to_numpy())
            hit, count, best = np.zeros(len(pair), bool), np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
            if len(known.pair):
                at = np.minimum(np.searchsorted(known.pair, pair), len(known.pair) - 1)
                hit = known.pair[at] == pair
                count, best = np.where(hit, known.n[at], 0), np.where(hit, known.best[at], 0)
            ends = np.searchsorted(row, np.arange(1, len(batch) + 1))
            offsets = pa.array(np.searchsorted(row[~hit], np.arange(len(batch) + 1)).astype(np.int32))
            rest = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(pair[~hit]), pa.array(links[~hit])], ["pair", "m"]))
            sums = [np.diff(np.concatenate([[0], np.cumsum(x * links)])[ends], prepend=0) for x in (count, best)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), rest], ["row", "count_sum", "n_best", "rest"])

    done = documents.select("row", "pairs", "links").mapInArrow(summed, "row long, count_sum long, n_best long, rest array<struct<pair: long, m: long>>")
    rest = done.select("row", F.explode("rest").alias("r")).select("row", F.col("r.pair").alias("pair"), "r.m").join(pairs, "pair")
    rest = rest.select("row", (F.col("n") * F.col("m")).alias("count_sum"), F.when(F.col("best"), F.col("m")).otherwise(0).alias("n_best"))
    return done.drop("rest").union(rest).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", max_segments: int = MAX_SEGMENTS, max_bytes: int = MAX_BYTES, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document.

    A is a byte-level vocabulary of ``tokenizers`` and reads a space and the
    text, B one of ``sentencepiece`` and reads the text, in front of which it
    puts a space.  A group ends where tokens of both end; links are all pairs of
    an A and a B token of a group.  A pair of ids counts the documents that hold
    it linked: ``count_sum`` is the sum over a document's links, ``n_best`` says
    how many of them have the highest count of their A id.  ``groups_sha256`` is
    over ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts whose tokens do not spell them (an underline
    sign that the second vocabulary takes for a space) have zeros and an empty
    hash.  Rows with a null or repeated id are documents of their own; other
    columns are not read; an empty table gives an empty result.  The bounds change
    where the work is done, never the result.
    """
    spark = df.sparkSession
    tok = tokenizers(a_path, b_path)
    docs = bounded_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    segments = written(_segment_counts(docs, tok.breaks))
    taken, _ = frequent_head(segments, "n", F.octet_length("segment"), max_segments, max_bytes)
    head = spark.sparkContext.broadcast(Frequent(_alignments(segments.where(taken), a_path, b_path).toArrow()))
    composed = _composed(docs, head, a_path, b_path)
    dropped(segments)

    counts = composed.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n"))
    a_id = F.floor(F.col("pair") / tok.pairs)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))
    pairs = written(counts.withColumn("a", a_id).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    common, _ = frequent_head(pairs, "n", F.lit(17), max_pairs, 17 * max_pairs)
    known = spark.sparkContext.broadcast(PairCounts(pairs.where(common).toArrow()))
    documents = composed.where("pair IS NULL")
    out = documents.drop("pairs", "links", "pair", "n").join(_with_counts(documents, pairs, known), "row")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
