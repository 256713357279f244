"""Words as numbers for the language models: known words as they are, all others by their shape."""

from __future__ import annotations

import numpy as np

from tarnflow.llm.shared import SPACED, mix

_LOWER, _UPPER, _DIGIT = 97, 65, 48
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _LOWER
_CLASS[65:91] = _UPPER
_CLASS[48:58] = _DIGIT
_CLASS[128:] = _LOWER
_CASE = np.uint64(0x5851F42D4C957F2D)
AGAIN = np.uint64(0xD6E8FEB86659FD93)


def shaped(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, shape hash, whether it repeats the word before, document) of each word.

    A shape has one sign for each run of lower-case letters, upper-case letters
    or digits (characters outside ASCII count as lower case); other signs stay,
    runs of them as one.
    """
    word, start, _, doc = SPACED.hashed(data, ends)
    if not len(word):
        return word, word, np.zeros(0, bool), doc
    kind = _CLASS[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[start] = True
    cuts = ends[ends < len(data)]
    keep[cuts] = True
    shape, _, _, _ = SPACED.hashed(np.where(kind == _UPPER, np.uint8(0), kind)[keep], np.cumsum(keep)[np.maximum(ends, 1) - 1] * (ends > 0))
    exact = mix(word ^ shape * _CASE)
    again = np.zeros(len(word), bool)
    again[1:] = (exact[1:] == exact[:-1]) & (doc[1:] == doc[:-1])
    return exact, shape, again, doc


def known_or_shape(word: np.ndarray, shape: np.ndarray, again: np.ndarray, known: np.ndarray) -> np.ndarray:
    """One number for each word: itself if it is in the sorted array of known ones, else its shape; a repeat is another number."""
    out = shape
    if len(known):
        at = np.minimum(np.searchsorted(known, word), len(known) - 1)
        out = np.where(known[at] == word, word, shape)
    return np.where(again, mix(out ^ AGAIN), out)
