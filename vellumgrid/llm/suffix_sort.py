"""Two-stage suffix sorting in numpy, to a depth, for a chosen set of suffixes.

Suffixes that are smaller than their successors (type B) are sorted directly, eight bytes at a time and only as far as
they tie. All others (type A) follow from them: in order of the buckets by first byte, every suffix placed puts the one
before it, if that is of type A, behind what its bucket holds already. Within a bucket type A stands before type B.
"""

from __future__ import annotations

import numpy as np


def words8(text: np.ndarray, extra: int) -> np.ndarray:
    """At each place the next eight bytes as one number, zeros behind the end; `extra` places more than the text has."""
    padded = np.concatenate([text, np.zeros(extra + 8, np.uint8)]).astype(np.uint64)
    out = padded[: len(text) + extra].copy()
    for k in range(1, 8):
        out = (out << np.uint64(8)) | padded[k : len(text) + extra + k]
    return out


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Type B by place: the suffix is smaller than the next one. The last suffix is type A."""
    n = len(text)
    out = np.zeros(n, bool)
    if n > 1:
        less, differs = text[:-1] < text[1:], text[:-1] != text[1:]
        last = np.where(differs, np.arange(n - 1), n - 1)
        nearest = np.minimum.accumulate(last[::-1])[::-1]  # the next place that differs from its successor
        ok = nearest < n - 1
        out[:-1][ok] = less[nearest[ok]]
    return out


def sort_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    order = places[np.argsort(words[places], kind="stable")]
    if len(order) < 2:
        return order
    group = np.concatenate([[0], np.cumsum(words[order[1:]] != words[order[:-1]])])
    for at in range(8, depth, 8):
        same = group[1:] == group[:-1]
        tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if not tied.any():
            break
        spots = np.flatnonzero(tied)
        own = order[spots]
        keys, groups = words[own + at], group[spots]
        by = np.lexsort((keys, groups))
        order[spots] = own[by]
        keys, groups = keys[by], groups[by]
        fresh = np.zeros(len(order), np.int64)
        fresh[spots[1:]] = (keys[1:] != keys[:-1]) & (groups[1:] == groups[:-1])
        group = group + np.cumsum(fresh)
    return order


def sort_suffixes(text: np.ndarray, wanted: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """The places where wanted holds, in the order of their suffixes' first `depth` bytes. words: words8 with depth extra."""
    n = len(text)
    b = smaller_than_successor(text)
    # an induced suffix needs its successors up to the next of type B
    next_b = np.minimum.accumulate(np.where(b, np.arange(n), n)[::-1])[::-1]
    mark = np.zeros(n + 2, np.int64)
    chosen = np.flatnonzero(wanted)
    np.add.at(mark, chosen, 1)
    np.add.at(mark, np.minimum(next_b[chosen], n - 1) + 1, -1)
    needed = np.cumsum(mark)[:n] > 0
    seeds = sort_directly(np.flatnonzero(needed & b), words, depth)
    bounds = np.searchsorted(text[seeds], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and needed[n - 1]:
        induced[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        waves = induced[c]
        i = 0
        if waves:
            waves[:] = [np.concatenate(waves)]
        while i < len(waves):  # runs of one byte
            before = waves[i] - 1
            before = before[(before >= 0)]
            before = before[needed[before] & (text[before] == c)]
            if len(before):
                waves.append(before)
            i += 1
        bucket = np.concatenate([*waves, seeds[bounds[c] : bounds[c + 1]]]) if waves else seeds[bounds[c] : bounds[c + 1]]
        out.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        before = before[needed[before] & (text[before] > c)]
        if len(before):
            heads = text[before]
            by = np.argsort(heads, kind="stable")
            before, heads = before[by], heads[by]
            for part in np.split(before, np.flatnonzero(np.diff(heads)) + 1):
                induced[text[part[0]]].append(part)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix in order shares with the one before it, `depth` at most; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, depth, 8):
        x = words[order[live] + at] ^ words[order[live - 1] + at]
        same = x == 0
        top = live[~same]
        bits = np.zeros(len(top), np.int64)
        rest = x[~same]
        for k in range(8):  # leading equal bytes
            bits += (rest >> np.uint64(8 * (7 - k))) == 0
        out[top] = np.minimum(depth, at + bits)
        live = live[same]
    out[live] = depth
    return out
