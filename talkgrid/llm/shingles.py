"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix64, text_bytes, word_bounds


def constants(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingles of every text, sorted, one text after the other, and the n + 1 offsets.

    A-Z count as a-z. A text with fewer words than a shingle has its whole sequence as one shingle, one without words has none.
    """
    raw, offsets = text_bytes(texts)
    n = len(offsets) - 1
    starts, ends = word_bounds(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    letter = constants(256, 11)
    letter[65:91] = letter[97:123]
    size = ends - starts
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
        value = letter[raw[place + np.repeat(starts, size)]] * power[place]
        w = mix64(np.add.reduceat(value, np.cumsum(size) - size))
        doc = np.searchsorted(offsets, starts, "right") - 1
        count = np.bincount(doc, minlength=n)
        first = np.cumsum(count) - count
        made = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
        owner = np.repeat(np.arange(n), made)
        at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made)
        order = constants(words, 23)
        h = np.zeros(len(owner), np.uint64)
        last = first[owner] + count[owner]
        for j in range(words):
            h += np.where(at + j < last, w[np.minimum(at + j, len(w) - 1)], np.uint64(0)) * order[j]
        h = mix64(h + np.minimum(count[owner], words).astype(np.uint64))
    cuts = np.cumsum(made).tolist()
    for i, j in zip([0, *cuts], cuts):
        h[i:j].sort()
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))
    h, owner = h[new], owner[new]
    return h, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def fingerprints(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit sums per set that tell it from others; zeros for an empty set."""
    out = np.zeros((2, len(offsets) - 1), np.uint64)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        with np.errstate(over="ignore"):
            for i, c in enumerate((0x1234567, 0x7654321)):
                out[i, some] = np.add.reduceat(mix64(h ^ np.uint64(c)), offsets[some])
    return out.view(np.int64)
