"""Words of UTF-8 bytes as arrays, for whole batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Which byte values lie in the ranges, both ends included."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


def runs(inside: np.ndarray, offsets: np.ndarray):
    """Start, end and row of each maximal run of ``inside`` bytes within a row."""
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    before[offsets[:-1][offsets[:-1] < len(inside)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def strings(flat: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """The runs as an Arrow array; ``inside`` marks exactly their bytes."""
    where = np.r_[0, np.cumsum(end - start)].astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(flat[inside])))


def coded(words: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """A code for each word, and the words by code."""
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
