"""Token counts by byte-pair merging over a heap and a linked list; no identifiers are made.

A text is split at special strings (one token each) and by the vocabulary's pre-tokenizer pattern. The bytes of each piece
form a linked list; every adjacent pair that the vocabulary can merge waits in a heap by rank, then by place. The least is
popped, checked against the list (its symbols may have been merged away) and merged, and the new neighbours are pushed.
A piece of n bytes with m merges has n - m tokens. Pieces are remembered up to CACHE entries
for each worker: the first ones stay, as these are the common ones; a full cache starts anew after four times its size in misses.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm.common import trim_memory

#: Pieces remembered by a worker, and bytes of the longest of these.
CACHE, CACHED_BYTES = 400_000, 64
#: Byte-level pre-tokenizer: contractions, letters, numbers, other signs (each with a blank before), blanks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary's file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Pairs of symbols by rank. A symbol is a number: bytes are 0 to 255, what merge r makes is numbered by its bytes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        if model["pre_tokenizer"]["type"] != "ByteLevel" or model["normalizer"]:
            raise ValueError("a byte-level vocabulary without normalizer is needed")
        number = byte_alphabet()
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["model"]["merges"]):
            made = number.setdefault(a + b, len(number))
            self.pairs.setdefault(number[a] << 20 | number[b], (rank, made))
        self.special = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)


def count_merges(piece: bytes, pairs: dict[int, tuple[int, int]]) -> int:
    """Tokens of one piece: its bytes less the merges made."""
    n = len(piece)
    if n < 2:
        return n
    symbols = list(piece)
    heap = [(found[0], i) for i in range(n - 1) if (found := pairs.get(symbols[i] << 20 | symbols[i + 1]))]
    if not heap:
        return n
    heapify(heap)
    after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        if symbols[i] < 0 or j >= n or (found := pairs.get(symbols[i] << 20 | symbols[j])) is None or found[0] != rank:
            continue
        symbols[i], symbols[j] = found[1], -1
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if found := pairs.get(symbols[i] << 20 | symbols[k]):
                heappush(heap, (found[0], i))
        if (h := before[i]) >= 0 and (found := pairs.get(symbols[h] << 20 | symbols[i])):
            heappush(heap, (found[0], h))
    return left


class PieceCounts(dict):
    def __init__(self, pairs: dict[int, tuple[int, int]]) -> None:
        super().__init__()
        self.pairs, self.missed = pairs, 0

    def __missing__(self, piece: str) -> int:
        raw = piece.encode("utf-8")
        n = count_merges(raw, self.pairs)
        if len(raw) <= CACHED_BYTES:
            if len(self) < CACHE:
                self[piece] = n
            elif (missed := self.missed + 1) > 4 * CACHE:
                self.clear()
                self.missed = 0
            else:
                self.missed = missed
        return n


class Counter:
    def __init__(self, path: str) -> None:
        merges = Merges(path)
        self.counts, self.pieces = PieceCounts(merges.pairs), regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None

    def __call__(self, text: str) -> int:
        get, find = self.counts.__getitem__, self.pieces.findall
        if self.special is None or not self.special.search(text):
            return sum(map(get, find(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(get, find(p))) for p in parts)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of docs: id, n_bytes, n_tokens, over_limit (more than limit tokens). path: a byte-level BPE vocabulary
    (tokenizers' .json) that every executor has.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids stay; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [count(t) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])
        trim_memory()

    ids = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {ids}, n_bytes bigint, n_tokens bigint")
    return made.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
