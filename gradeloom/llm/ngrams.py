"""Hashed word n-grams of whole Arrow batches, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time; a longer document is a block of its own.
BLOCK = 1 << 18
#: An odd factor for the rolling hash (golden ratio) and the two of a 64-bit mixing step.
STEP, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Kinds of bytes: 0 white space, 1 signs, 2 letters, digits and all of longer characters.
KIND = np.array([0 if b in b" \t\n\x0b\x0c\r" else 2 if b >= 128 or chr(b).isalnum() else 1 for b in range(256)], dtype=np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse modulo 2**64, ``size`` of each."""
    out = []
    for base in (STEP, pow(STEP, -1, 1 << 64)):
        p = np.full(size, np.uint64(base), dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and document offsets of runs of rows of about BLOCK bytes (the column has no NULLs)."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def hashed(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every n-gram: words and runs of signs below 2**bits, pairs of neighbours from there to 2**(bits + 1)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = KIND[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    begin = np.flatnonzero(edge[:-1] & (kind != 0))
    end = np.flatnonzero(edge[1:] & (kind != 0)) + 1
    size = BLOCK + 1 if len(data) <= BLOCK else len(data)
    up, down = powers(size)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], dtype=np.uint64, out=sums[1:])
    word = mixed((sums[end] - sums[begin]) * down[begin])
    doc = np.searchsorted(offsets, begin, side="right") - 1
    pair = mixed(word[:-1] * np.uint64(STEP) + word[1:])
    inside = doc[:-1] == doc[1:]
    cut = np.uint64(64 - bits)
    bucket = np.concatenate((word >> cut, (pair[inside] >> cut) + np.uint64(1 << bits))).astype(np.int64)
    return bucket, np.concatenate((doc, doc[:-1][inside]))
