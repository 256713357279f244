"""Cost-balanced packing of documents into token sequences.

The cost of a piece is linear plus quadratic in its length (feed-forward and
attention work).  A document's full sequences are cut off first; what is left is
assigned, longest first, to the sequence of lowest cost that still has room.  A
piece that fits nowhere is cut over the sequences with most room, so sequences
fill up.  What does not fill a whole sequence at the end of a block goes into
sequences of a power-of-two length, which need no padding.

Each task packs the documents it reads in blocks of some hundred sequences:
nothing is shuffled, a task holds one block, and a lost task is done again by
itself.  Balance and padding do not depend on the size of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnflow.llm.shared import id_and_text
from tarnflow.llm.tokens import encoder

END_ID, CAPACITY = 2, 4096
#: Sequences of a block.
BLOCK_SEQUENCES = 256
#: Cost of n tokens: n + QUADRATIC * n * n.
QUADRATIC = 1 / 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n):
    return n + QUADRATIC * n * n


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(document, start, length, sequence) of every piece; sequences are filled in list order.

    ``lengths``: tokens of each document of a block.
    """
    pieces: list[tuple[int, int, int, int]] = []
    count, rest = 0, []
    for doc, n in enumerate(lengths.tolist()):
        for k in range(n // capacity):
            pieces.append((doc, k * capacity, capacity, count))
            count += 1
        if n % capacity:
            rest.append((n % capacity, doc, n - n % capacity))
    left = sum(n for n, _, _ in rest)
    sizes = [capacity] * (left // capacity)
    sizes += [1 << b for b in reversed(range(capacity.bit_length())) if (left % capacity) >> b & 1]
    room, spent = np.array(sizes, np.int64), np.zeros(len(sizes))
    for n, doc, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while n:
            fits = np.flatnonzero(room >= n)
            at = int(fits[np.argmin(spent[fits])]) if len(fits) else int(np.argmax(room))
            part = min(n, int(room[at]))
            pieces.append((doc, start, part, count + at))
            room[at] -= part
            spent[at] += cost(part)
            start, n = start + part, n - part
    return pieces


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keeps_space: bool = False) -> DataFrame:
    """One row for each piece: where its ids stand in the document and in which sequence they go.

    Every id of every document, the end id included, is in exactly one piece.
    Null texts are empty: one piece with the end id.  Repeated rows are packed
    each for itself.  Sequence ids are unique; they carry the task's number in
    their upper half.  An empty table gives no rows.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, first = encoder(tokenizer, keeps_space), TaskContext.get().partitionId() << 32
        docs, ids, size = [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal first
            pieces = pack_lengths(np.array([len(x) for x in ids], np.int64), capacity)
            used: dict[int, int] = {}
            rows = []
            for doc, start, length, seq in pieces:
                at = used.get(seq, 0)
                used[seq] = at + length
                rows.append((docs[doc], start, length, zlib.crc32(ids[doc][start : start + length].tobytes()), len(ids[doc]), first + seq, at))
            first += len(used)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for doc, got in zip(names, enc.stream(batch.column(1).to_pylist())):
                docs.append(doc)
                ids.append(np.append(got, end_id).astype("<u4"))
                size += len(ids[-1])
                if size >= BLOCK_SEQUENCES * capacity:
                    yield block()
                    docs, ids, size = [], [], 0
        if docs:
            yield block()
        del docs, ids
        enc.forget()

    return id_and_text(df, id_col, text_col).mapInArrow(packed, SCHEMA)
