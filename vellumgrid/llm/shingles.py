"""Sets of word shingles of whole texts as 64-bit hashes, for a column at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from vellumgrid.llm.bytehash import BLANK, buffer_of, mix, prefix_sums, span_hashes

#: Bytes of text hashed at once, unless one text is longer.
BLOCK = (1 << 18) - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, with A-Z lower-cased, and the place of each text's first word (n + 1 numbers)."""
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~BLANK[data]
    edge = inside[1:] != inside[:-1]
    first = np.zeros(len(data) + 1, bool)  # words end with their text
    first[offsets[(offsets > 0) & (offsets < len(data))]] = True
    both = first & inside[1:] & inside[:-1]
    starts = np.flatnonzero((edge | both)[:-1] & inside[1:-1]) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero((edge | both) & inside[:-1])
    return span_hashes(prefix_sums(data), starts, ends), np.searchsorted(starts, offsets)


def word_blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """word_hashes of a column, about BLOCK bytes of whole texts at a time."""
    data, offsets = buffer_of(texts)
    begin, n = 0, len(texts)
    while begin < n:
        end = min(n, max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BLOCK, "right")) - 1))
        yield word_hashes(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
        begin = end


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's runs of `size` words; of all its words if it has fewer; none without words."""
    return (s for s, _ in weighed_sets(texts, size, np.zeros(1, np.uint8)))


def weighed_sets(texts: pa.Array, size: int, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """shingle_sets, each with its sorted distinct marks: the first 56 bits of a hash below the sum of its words' weights.

    weights: a byte by the first bits of a word's hash (2**k of them), so small that `size` of them add up to a byte. Without
    weights (one byte) there are no marks. All the words of a text of fewer weigh nothing."""
    shift = np.uint64(65 - len(weights).bit_length())
    for words, places in word_blocks(texts):
        runs = words.copy()
        for k in range(1, size):
            runs[: len(words) - k] = mix(runs[: len(words) - k] * _STEP + words[k:]) if len(words) > k else runs[:0]
        marks = words[:0]
        if len(weights) > 1:
            sums = np.concatenate([[0], np.cumsum(weights[words >> shift], dtype=np.uint64)]).astype(np.uint64)
            marks = runs >> np.uint64(8)
            marks[: max(0, len(words) - size + 1)] |= (sums[size:] - sums[: max(0, len(words) - size + 1)]) << np.uint64(56)
        for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1]), np.unique(marks[a : b - size + 1])
            elif b > a:
                whole = words[a : a + 1]
                for w in words[a + 1 : b]:
                    whole = mix(whole * _STEP + w)
                whole = mix(whole + np.uint64(b - a))
                yield whole, whole >> np.uint64(8)
            else:
                yield words[:0], words[:0]
