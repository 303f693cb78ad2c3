import random

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import base_counts, components, documents, prose, repeats

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    base, passage = prose(rng, 120), prose(rng, 60)
    texts = [prose(rng, rng.randrange(40, 120)) for _ in range(40)] + [base, base, base.replace("w1", "w2"), base + " more words here"]
    texts += [f"{prose(rng, 70)} {passage} {prose(rng, 70)}" for _ in range(4)] + ["short", None, "a b c " * 40]
    return documents(spark, [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)])


def stage(spark, docs, k):
    return corpus_pipeline.STAGES[k][1](spark, docs, "")


def test_every_stage_equals_brute_force(spark, docs):
    rows = {r.doc_id: r for r in docs.collect()}
    good = stage(spark, docs, 0)
    assert good.columns == COLUMNS
    kept = {r.doc_id: r.text for r in good.collect()}
    assert set(kept) == {i for i, r in rows.items() if not base_counts(r.text)[-1]}
    near = stage(spark, good, 1)
    ids = {r.doc_id for r in near.collect()}
    assert near.columns == COLUMNS and ids == {i for i, (_, c) in components(kept, 5, 80, 100).items() if i == c}
    cut = stage(spark, near, 2)
    left = {r.doc_id: r for r in cut.collect()}
    want = repeats({i: kept[i] for i in ids}, 100)
    assert cut.columns == COLUMNS and {i: len(r.text.encode()) for i, r in left.items()} == {i: w[0] - w[1] for i, w in want.items()}
    assert all(r.n_chars == len(r.text) for r in left.values())
    mixed = stage(spark, cut, 3)
    copies = [r.doc_id for r in mixed.collect()]
    assert mixed.columns == COLUMNS and set(copies) <= ids and max(copies.count(i) for i in copies) <= 3
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = stage(spark, mixed, 4).collect()
    assert sorted(r.doc_id for r in encoded) == sorted(copies)
    assert all(r.ids == library.encode(left[r.doc_id].text, add_special_tokens=False).ids for r in encoded)


def test_stages_take_empty_tables(spark, docs):
    empty = docs.where("doc_id < 0")
    for k in range(len(corpus_pipeline.STAGES)):
        assert stage(spark, empty, k).count() == 0
