"""BPE encoding and decoding with content-defined chunks that documents share.

A rolling hash over WINDOW bytes cuts the texts wherever it has CUT_BITS zero bits, so that passages which occur in many
documents give the same chunks. A chunk's own part runs from its first to its last blank; it is encoded once for each
worker and reused (the two halves of the cache hold CACHE_BYTES at most). The word across each join of two chunks belongs
to neither: it is encoded again as a whole, and grows over further chunks until it has a blank on both sides. There the
encoding of the parts and that of the text agree: the vocabulary's pieces never hold a blank, special strings have none,
and no normalisation reaches over one.

A chunk that is new to a worker is encoded word by word from a second cache, if all its characters are below U+0240 (there
the vocabulary's normalisation is lower case alone) and it holds no special string; else the library encodes it whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm.bytehash import BLANK, buffer_of, prefix_sums, span_hashes
from vellumgrid.llm.common import trim_memory

WINDOW, CUT_BITS, CACHE_BYTES = 16, 8, 24 << 20
#: Bytes of text that are hashed at once, unless one text is longer.
BLOCK = (1 << 18) - 1
#: Texts whose results are held at once, and bytes of theirs after which no further text is added.
ROWS, HELD_BYTES = 500, 4 << 20
#: Words remembered by a worker, and the length of the longest of these. The first ones stay, as these are the common ones;
#: a full cache starts anew after it has missed four times its size.
WORDS, WORD_BYTES = 200_000, 48
#: Pre-tokenizer pattern of the vocabulary; blanks are dropped.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What needs the library: a character from U+0240 on, U+0130 (two characters in lower case).
FOREIGN = re.compile("[\u0130\u0240-\U0010ffff]")
#: All characters of the lower case of any other text.
PLAIN = sorted({c for i in range(0x240) if i != 0x130 for c in chr(i).lower()})
Piece = tuple[int, bytes, bytes]


def members(kind: str) -> str:
    """The characters of PLAIN that a class of PATTERN has, as the inside of a set."""
    return "".join(re.escape(c) for c in PLAIN if regex.fullmatch(kind, c))


def plain_words() -> re.Pattern[str]:
    """PATTERN for texts of PLAIN alone: the same words, by sets of characters in place of properties. No letter begins a
    suffix, so letters, the most usual case, come first."""
    letter, number, blank = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    return re.compile(f"[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d|[{number}]|[^{blank}{letter}{number}]+")


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places, in order, at which the texts fall into chunks' own parts and joins; the ends of texts are among them."""
    sums = prefix_sums(data)
    ends = np.arange(WINDOW, len(data) + 1)
    hashes = span_hashes(sums, ends - WINDOW, ends) if len(data) >= WINDOW else np.zeros(0, np.uint64)
    cuts = np.flatnonzero(hashes >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    first = np.searchsorted(offsets, cuts, "right") - 1  # the text that a cut is in; cuts with a window over two texts don't count
    cuts = cuts[(cuts < len(data)) & (cuts - WINDOW >= offsets[np.minimum(first, len(offsets) - 1)])]
    blanks = np.flatnonzero(BLANK[data])
    where = np.searchsorted(blanks, cuts)
    before = np.where(where > 0, blanks[np.maximum(where - 1, 0)] + 1, 0) if len(blanks) else np.zeros(len(cuts), np.int64)
    after = np.where(where < len(blanks), blanks[np.minimum(where, len(blanks) - 1)], len(data)) if len(blanks) else np.full(len(cuts), len(data))
    text = np.searchsorted(offsets, cuts, "right") - 1
    before, after = np.maximum(before, offsets[text]), np.minimum(after, offsets[np.minimum(text + 1, len(offsets) - 1)])
    return np.unique(np.concatenate([offsets, before, after]))


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


def check_vocabulary(path: str) -> None:
    """Refuses a file for which a word's encoding could depend on what is beyond its blanks, or decoding does more than join."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    steps = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = bool(steps) and steps[0]["type"] == "Split" and steps[0]["pattern"] == {"Regex": PATTERN} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    bytewise = len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    normal = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    special = all(not a["normalized"] and not a["lstrip"] and not a["rstrip"] and not a["single_word"] and not regex.search(r"\s", a["content"]) for a in file["added_tokens"])
    if not (split and bytewise and normal and special and file["decoder"] is None and file["post_processor"] is None):
        raise ValueError(f"{path}: a lower-casing word vocabulary without decoder is needed")


class Codec:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [self.tokenizer.id_to_token(i) for i in self.tokenizer.get_added_tokens_decoder()]
        self.find = plain_words().findall
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.missed = 0
        self.tokens = [(self.tokenizer.id_to_token(i) or "").encode("utf-8") for i in range(size)]
        self.new: dict[bytes, Piece] = {}
        self.old: dict[bytes, Piece] = {}
        self.held = 0

    def encode_pieces(self, pieces: list[bytes]) -> list[Piece]:
        out: list[Piece | None] = [self.new.get(p) for p in pieces]
        missing: dict[bytes, Piece | None] = {}
        for i, p in enumerate(pieces):
            if out[i] is None:
                if found := self.old.get(p):
                    out[i] = found
                    self.keep(p, found)
                else:
                    missing[p] = None
        if missing:
            missing = dict(zip(missing, self.encode_new([k.decode("utf-8") for k in missing]), strict=True))
            for i, p in enumerate(pieces):
                if out[i] is None:
                    out[i] = missing[p]
            for k, v in missing.items():
                self.keep(k, v)
        return out

    def library(self, texts: list[str]) -> Iterator[Piece]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = e.ids
            yield len(ids), packed(ids), b" ".join([self.tokens[i] for i in ids])

    def encode_new(self, texts: list[str]) -> list[Piece]:
        plain = [not FOREIGN.search(t) and not any(s in t for s in self.special) for t in texts]
        whole = self.library([t for t, p in zip(texts, plain, strict=True) if not p])
        found = [self.find(t.lower()) if p else None for t, p in zip(texts, plain, strict=True)]
        known = self.words
        if self.missed > 4 * WORDS:
            known.clear()
            self.missed = 0
        new = list(set().union(*[ws for ws in found if ws]).difference(known))
        known.update(zip(new, [p[1:] for p in self.library(new)], strict=True))
        out = []
        for ws in found:
            if ws:
                parts = list(map(known.__getitem__, ws))
                ids = b"".join([p[0] for p in parts])
                out.append((len(ids) // 4, ids, b" ".join([p[1] for p in parts if p[0]])))
            else:
                out.append((0, b"", b"") if ws is not None else next(whole))
        for w in new:  # what is too long, or more than the cache holds, goes again
            if len(w) > WORD_BYTES or len(known) > WORDS:
                del known[w]
                self.missed += 1
        return out

    def keep(self, piece: bytes, made: Piece) -> None:
        self.held += 2 * len(piece) + len(made[1]) + len(made[2]) + 300
        if self.held > CACHE_BYTES // 2:
            self.old, self.new, self.held = self.new, {}, 0
        self.new[piece] = made

    def encode(self, texts: pa.Array) -> Iterator[Piece]:
        """Number of tokens, ids as little-endian 32-bit numbers and decoded text, of each text."""
        data, offsets = buffer_of(texts)
        begin, n = 0, len(texts)
        while begin < n:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BLOCK, "right")) - 1)
            end = min(end, n)
            own = offsets[begin : end + 1] - offsets[begin]
            block = data[offsets[begin] : offsets[end]]
            places = pieces_of(block, own)
            raw = block.tobytes()
            pieces = self.encode_pieces([raw[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)])
            at = np.searchsorted(places, own).tolist()
            for a, b in zip(at[:-1], at[1:], strict=True):
                part = [p for p in pieces[a:b] if p[0]]
                yield sum(p[0] for p in part), b"".join([p[1] for p in part]), b" ".join([p[2] for p in part])
            begin = end


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of ROWS texts, or of HELD_BYTES and one text, at most."""
    _, offsets = buffer_of(batch.column(1))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + HELD_BYTES, "right")) - 1)
        end = min(end, begin + ROWS, batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """One row a row of docs: id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit numbers) and decoded_sha256
    (decoded text in UTF-8); with full also the ids (array of int) and the decoded text. path: a tokenizers .json file
    without decoder (tokens decode to themselves, joined by blanks) that driver and executors have; a file of another kind
    is refused.

    Null and empty texts have no tokens. Repeated rows and null ids stay; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in (part for b in batches for part in parts_of(b)):
            made = list(c.encode(batch.column(1)))
            sha = lambda i: pa.array([hashlib.sha256(m[i]).hexdigest() for m in made], pa.string())  # noqa: E731, B023
            columns = [batch.column(0), pa.array([m[0] for m in made], pa.int64()), sha(1), sha(2)]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                columns += [pa.array([np.frombuffer(m[1], "<u4").astype(np.int32) for m in made], pa.list_(pa.int32())), pa.array([m[2].decode("utf-8") for m in made], pa.string())]
                names += ["ids", "decoded"]
            yield pa.record_batch(columns, names)
        trim_memory()

    check_vocabulary(path)
    ids = docs.schema[id_col].dataType.simpleString()
    schema = f"id {ids}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    made = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)
    return made.withColumnRenamed("id", id_col)
