"""Token ids of whole texts by the ``tokenizers`` library, at a corpus's speed.

Both vocabularies split a text into pieces before they merge bytes, and no
piece reaches over an ASCII space or line feed that stands alone between two
other characters.  So the ids of a text are the ids of its space-separated
chunks, one after the other.  Natural text repeats its chunks: the library
encodes each distinct chunk once for a worker and the ids are gathered by index.
A chunk that is one word, perhaps with a comma or full stop, goes to the library
already cut, which spares it the search for pieces.
Texts for which the split is not safe, such as those that hold the string of an
added token, go to the library as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from tarnflow.llm.shared import memory_returned

#: Chunks that a worker keeps; beyond it starts anew (bounds its memory).
CACHE_CHUNKS = 500_000
#: Characters of text that the library encodes at once.
LIBRARY_CHARS = 200_000
#: Characters of text that are held as ids at once.
STEP_CHARS = 1_000_000


def _byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


#: UTF-8 of Latin-1 letters: bytes that are one; for the lead bytes C2 and C3 the second bytes that make one.
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_LETTER_PAIR = np.array([[0x80 <= b < 0xC0 and chr(b + 64 * lead).isalpha() for b in range(256)] for lead in (0, 1)])


class _Index(dict):
    """Chunk -> number; a chunk that is new gets the next number and waits to be encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class Encoder:
    """``keeps_space``: spaces belong to the vocabulary's pieces (byte-level); else white space is dropped."""

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import Split

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.lib.get_added_tokens_decoder().values()]  # strings that the library finds before it cuts pieces
        self.keeps_space = keeps_space
        # the same vocabulary for words that are cut and spelt in its byte alphabet already
        self.words = Tokenizer.from_file(path)
        self.words.normalizer, self.words.pre_tokenizer = Sequence([]), Split("\n", "isolated")
        vocabulary = self.lib.get_vocab()
        self.spans = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id
        for piece, i in vocabulary.items():
            self.spans[i] = len(piece.removesuffix("</w>"))
        self.letters = {b: c for b, c in enumerate(_byte_alphabet())}
        self.point = np.zeros(256, np.uint32)  # id of a comma or full stop by its byte
        for p in ",.":
            if len(got := self.lib.encode(p, add_special_tokens=False).ids) == 1:
                self.point[ord(p)] = got[0]
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.start, self.size, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.unsafe = np.zeros(1 << 16, bool)  # chunks whose texts go to the library as a whole
        self.ids = np.zeros(1 << 18, np.uint32)
        if self.keeps_space:
            line = np.array(self.lib.encode("\n", add_special_tokens=False).ids, np.uint32)
            self._store(np.array([self.index["\n"]]), line, np.array([len(line)]))
            self.index.new.clear()

    def _library(self, texts: list[str]) -> list[list[int]]:
        out, i = [], 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j]) <= LIBRARY_CHARS):
                chars += len(texts[j])
                j += 1
            out += [e.ids for e in self.lib.encode_batch_fast(texts[i:j], add_special_tokens=False)]
            i = j
        return out

    def _spelt(self, chunks: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(number, spelling, its length, id of the point after it or 0) of the chunks that are words of Latin-1 letters.

        Such a word is one piece of either vocabulary; its spelling is in the byte alphabet.
        """
        gap = "\n " if self.keeps_space else "\n"
        lines = gap + gap.join(chunks) + "\n"
        lines = lines.replace(" \0", "") if self.keeps_space else lines.lower()
        raw = lines.encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw, np.uint8)
        breaks = np.flatnonzero(data == 10)
        start, stop = breaks[:-1] + 1, breaks[1:]
        point = self.point[data[stop - 1]]
        end = stop - (point > 0)
        first = start + (data[start] == 32) if self.keeps_space else start
        letter = _LETTER[data]
        pair = np.flatnonzero((data == 0xC2) | (data == 0xC3))
        pair = pair[_LETTER_PAIR[data[pair] & 1, data[pair + 1]]]
        letter[pair] = letter[pair + 1] = True
        others = np.concatenate([[0], np.cumsum(~letter)])
        good = (end > first) & (others[np.maximum(end, first)] == others[first])
        keep = np.zeros(len(data) + 1, np.int8)
        keep[start[good]] += 1
        keep[end[good]] -= 1
        keep = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
        keep[stop[good]] = True  # the line's end
        spelt = data[keep].tobytes().decode("latin-1").translate(self.letters).split(self.letters[10])[:-1]
        return np.flatnonzero(good), spelt, (end - start)[good], point[good]

    def _encoded(self, words: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count for each) of spelt words."""
        groups = [words[i : i + 2000] for i in range(0, len(words), 2000)]
        ids, sizes = [], []
        for k in range(0, len(groups), 8):
            for n, got in enumerate(self.words.encode_batch_fast(groups[k : k + 8], is_pretokenized=True, add_special_tokens=False), k):
                ids.append(np.array(got.ids, np.uint32))
                ends = np.searchsorted(np.cumsum(self.spans[ids[-1]]), np.cumsum(lengths[2000 * n : 2000 * (n + 1)]))
                sizes.append(np.diff(ends, prepend=-1))
        return np.concatenate(ids), np.concatenate(sizes)

    def _chunks(self, text: str) -> list[str] | None:
        """The text cut at spaces and line feeds; None if it holds the sign that marks chunks or an added token's string.

        Where spaces belong to pieces, a chunk stands for itself after a space,
        and one that follows no space is marked by a leading NUL.
        """
        if any(t[:2] in text and t in text.lower() for t in self.added):
            return None
        if not self.keeps_space:
            return text.replace("\n", " ").split(" ")
        return None if "\0" in text else ("\0" + text.replace("\n", " \n \0")).split(" ")

    def _learn(self) -> None:
        chunks, self.index.new = self.index.new, []
        n = len(self.index) - len(chunks)
        while len(self.index) > len(self.start):
            self.start, self.size, self.unsafe = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.unsafe))
        at, words, lengths, points = self._spelt(chunks)
        if words:
            flat, size = self._encoded(words, lengths)
            ends = np.cumsum(size + (points > 0))
            out, last = np.zeros(int(ends[-1]), np.uint32), (ends - 1)[points > 0]
            inner = np.ones(len(out), bool)
            inner[last] = False
            out[inner], out[last] = flat, points[points > 0]
            self._store(n + at, out, size + (points > 0))
        others = np.ones(len(chunks), bool)
        others[at] = False
        others = np.flatnonzero(others)
        if self.keeps_space and len(others):  # chunks with white space beside or inside them
            unsafe = np.array([(body := chunks[i].removeprefix("\0")).split() != [body] for i in others.tolist()])
            self.unsafe[n + others[unsafe]] = True
            others = others[~unsafe]
        if len(others):
            rest = [chunks[i] for i in others.tolist()]
            got = self._library([c[1:] if c[:1] == "\0" else f" {c}" for c in rest] if self.keeps_space else rest)
            self._store(n + others, np.fromiter((x for ids in got for x in ids), np.uint32), np.fromiter(map(len, got), np.int64, len(got)))

    def _store(self, at: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.size[at] = size
        self.start[at] = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > CACHE_CHUNKS:
            self._clear()
        found = []
        for text in texts:
            chunks = self._chunks(text)
            found.append(None if chunks is None else np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks)))
        if self.index.new:
            self._learn()
        out = []
        for text, at in zip(texts, found):
            if at is None or self.unsafe[at].any():
                out.append(np.array(self._library([text])[0], np.uint32))
                continue
            size = self.size[at]
            ends = np.cumsum(size)
            out.append(self.ids[np.repeat(self.start[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)])
        return out

    def forget(self) -> None:
        """Drop all chunks, at a task's end: a worker that is kept for other stages does not hold them."""
        self._clear()
        memory_returned()

    def stream(self, texts) -> Iterator[np.ndarray]:
        """Ids of each text, in order, with a bounded part of them in memory."""
        some, chars = [], 0
        for text in texts:
            some.append(text)
            chars += len(text)
            if chars > STEP_CHARS:
                yield from self.encode(some)
                some, chars = [], 0
        yield from self.encode(some)


@lru_cache(maxsize=4)
def encoder(path: str, keeps_space: bool) -> Encoder:
    """One for each worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    return Encoder(path, keeps_space)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
