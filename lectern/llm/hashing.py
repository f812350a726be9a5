"""64-bit hashes of words and of word sequences, vectorised."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A text's words are made in pieces of about so many bytes, which bounds memory.
PIECE = 1 << 21
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_blank = re.compile(rb"[\x20\x09-\x0d]")


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: bytes | None) -> np.ndarray:
    """A hash for each word of the text, with A-Z lower-cased."""
    if not text:
        return np.zeros(0, np.uint64)
    if len(text) <= PIECE:
        found = text.lower().split()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    parts, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            m = _blank.search(text, end)
            end = m.start() if m else len(text)
        found = text[at:end].lower().split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))
        at = end
    return np.concatenate(parts)


def runs(w: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n words in a row."""
    k = len(w) - n + 1
    out = w[:k] * _ODD[0]
    for j in range(1, n):
        out += w[j : j + k] * _ODD[j]
    return mix(out + np.uint64(n))


def shingles(w: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct n-word sequences; of fewer words, the whole sequence; of none, nothing."""
    return np.unique(runs(w, min(n, len(w)))) if len(w) else w
