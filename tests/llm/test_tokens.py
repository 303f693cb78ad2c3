import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import documents
from vellumgrid.llm import bpe_codec
from vellumgrid.llm.bpe_codec import encode_documents
from vellumgrid.llm.token_counts import count_tokens

PIECES = [*"ȺȾȿabc  \n\t\x1c\x1f\x85᠎​  　éßñÉÀİΣς中文字अकि१Ⅷ²½🙂👩‍👧'sdtm.,!?<|endoftext|>\x0b\x0c\x00̧́", "<|endoftext|>", "<|startoftext|>", "'re", "'ll", "  ", "hello", "world"]


def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(600))) for _ in range(150)]
    passage = "the quick brown fox jumps over the lazy dog and runs away " * 12
    return [*made, "", None, "a" * 4000, "x1" * 2000, " " * 500, passage, passage, "before " + passage, " ".join(f"w{i}" for i in range(3000))]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, list(enumerate(texts()))).withColumn("n_tokens", F.lit("x")).withColumn("id", F.lit("y"))


def test_counts_equal_the_library(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, path).collect()}
    sizes = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts())}
    assert got == {i: (len((t or "").encode()), sizes[i], sizes[i] > 1024) for i, t in enumerate(texts())}
    assert count_tokens(docs.where("doc_id < 0"), path).count() == 0


def test_codec_equals_the_library(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in encode_documents(docs, path, full=True).collect()}
    for i, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids and got[i].decoded == decoded and got[i].n_tokens == len(ids), repr(t)[:80]
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert encode_documents(docs.where("doc_id < 0"), path).count() == 0
    with pytest.raises(ValueError, match="word vocabulary"):
        encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def test_plain_words_are_those_of_the_pattern():
    plain, pattern = bpe_codec.plain_words(), regex.compile(bpe_codec.PATTERN)
    rng = random.Random(2)
    kinds = [*bpe_codec.PLAIN, *"'sredvmlt 0²½\n"] + list("'sredvmlt") * 20
    for c in bpe_codec.PLAIN:
        assert plain.findall(f"a{c}'ll{c}{c}") == pattern.findall(f"a{c}'ll{c}{c}"), repr(c)
    for _ in range(500):
        text = "".join(rng.choice(kinds) for _ in range(rng.randrange(200)))
        assert plain.findall(text) == pattern.findall(text), repr(text)


def test_parts_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe_codec, "HELD_BYTES", 100)
    texts = ["a" * n for n in (10, 10, 500, 0, 99, 1, 1)] + [None] * 3
    parts = list(bpe_codec.parts_of(pa.record_batch([pa.array(range(10)), pa.array(texts)], ["id", "text"])))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts and max(p.num_rows for p in parts) < 10
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 100 for p in parts)
