"""Words and word shingles of whole columns of text as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: An odd multiplier for rolling over words, and a salt for sequences that are shorter than a shingle.
STEP = np.uint64(0x9E3779B97F4A7C15)
SHORT = np.uint64(0xD1B54A32D192ED03)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (fixed values: multipliers of the public splitmix64 generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ([^ \\t-\\r]+ after lower-casing A-Z), and the offset at which each text's begin."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = pc.dictionary_encode(parts.values)
    distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter((digest(w) for w in distinct), np.uint64, len(distinct))
    codes, offsets = found.indices.to_numpy(), parts.offsets.to_numpy().astype(np.int64)
    blank = next((i for i, w in enumerate(distinct) if not w), None)  # white space at an end leaves an empty part
    if blank is not None:
        real = codes != blank
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return table[codes], offsets


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes, sorted, of a text's n-word shingles; a shorter text is one shingle, an empty one none."""
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(hashes) - k + 1, np.uint64)
        for i in range(k):
            rolled = rolled * STEP + hashes[i : len(hashes) - k + 1 + i]
        if k < n:
            rolled = rolled + SHORT * np.uint64(k)
        return np.unique(mix(rolled))
