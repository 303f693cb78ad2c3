"""Hashes of all substrings of a buffer from one prefix sum, in numpy.

H[i] is the sum of T[b[j]] * P**j over j < i, modulo 2**64, with T a fixed random table and P odd; the hash of b[s:e] is
(H[e] - H[s]) * P**-s, mixed. Equal strings have equal hashes wherever they stand."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
TABLE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
BASE = int(_RNG.integers(2**62, 2**64, dtype=np.uint64)) | 1
INVERSE = pow(BASE, -1, 2**64)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.empty(size, np.uint64)
    out[0], n = 1, 1
    while n < size:
        m = min(n, size - n)
        out[n : n + m] = out[:m] * np.uint64(pow(base, n, 2**64))
        n += m
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1); tables grow by doubling, so few are made."""
    return _powers(base, 1 << max(12, (n - 1).bit_length()))[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(TABLE[data] * powers(BASE, len(data) + 1)[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 places where its texts begin and end; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return (data[offsets[0] : offsets[-1]] if len(offsets) else data), (offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64))
