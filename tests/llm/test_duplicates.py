import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import components, documents, prose, repeats
from vellumgrid.llm import ngram_join, suffix_dedup
from vellumgrid.llm.components import connected_components
from vellumgrid.llm.ngram_join import RTree, Threshold, jaccard_components
from vellumgrid.llm.suffix_dedup import remove_repeats
from vellumgrid.llm.suffix_sort import common_prefixes, smaller_than_successor, sort_suffixes, words8


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        out.append(" ".join(w))
    return out


def corpus(rng):
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(40)]
    for _ in range(4):
        texts += near_copies(rng, prose(rng, 80), 12, 8)
    texts += [texts[3]] * 5 + [texts[3].upper(), "", None, " \n\t ", "one", "ONE", "one two", "é à ü " * 30, "a" * 3000]
    rng.shuffle(texts)
    return {i * 3 + 1: t for i, t in enumerate(texts)}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 50)])
def test_components_equal_brute_force(spark, n, num):
    texts = corpus(random.Random(n))
    rows = jaccard_components(documents(spark, texts.items()), n, Threshold(num, 100)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components(texts, n, num, 100)


def test_large_cells_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 8)
    monkeypatch.setattr(ngram_join, "NEAREST", 2)
    rng = random.Random(5)
    base = prose(rng, 100)
    texts = dict(enumerate(near_copies(rng, base, 60, 14)))
    rows = jaccard_components(documents(spark, texts.items()), 3, Threshold(90, 100)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components(texts, 3, 90, 100)


def test_near_copies_meet_once_however_many_shingles_they_share(spark, monkeypatch):
    made, join, whole = [], ngram_join.cell_join, ngram_join.candidate_pairs
    monkeypatch.setattr(ngram_join, "BUCKET", 4)  # pairs are not deduplicated by chance of one bucket
    count = spark.sparkContext.accumulator(0)

    def counted(*args):
        run = join(*args)

        def wrapped(rows):
            out = run(rows)
            count.add(out.num_rows)
            return out

        return wrapped

    def first(members, comps, *rest):
        if comps is None:
            made.append(members.count())
        return whole(members, comps, *rest)

    monkeypatch.setattr(ngram_join, "cell_join", counted)
    monkeypatch.setattr(ngram_join, "candidate_pairs", first)
    rng = random.Random(9)
    texts = {}
    for k in range(20):
        words = [f"t{k}w{i}" for i in range(200)]
        texts |= {3 * k + j: " ".join([*words[: 97 + j], f"other{rng.random()}", *words[98 + j :]]) for j in range(3)}
    rows = jaccard_components(documents(spark, texts.items()), 5, Threshold(80, 100)).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: i - i % 3 for i in texts}
    assert made[0] <= 20 * 12  # about 40 shared shingles a text; sets of members: abc, ab, ac, bc
    assert count.value <= 20 * 12


def routed(monkeypatch):
    """Rows of the cells that the join's first round is given."""
    made, whole = [], ngram_join.candidate_pairs

    def first(members, comps, *rest):
        if comps is None:
            made.append(members.count())
        return whole(members, comps, *rest)

    monkeypatch.setattr(ngram_join, "candidate_pairs", first)
    return made


def test_texts_that_share_common_words_only_meet_in_no_cell(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 0)  # as if the sample had missed the shingles shared
    made, rng = routed(monkeypatch), random.Random(3)
    texts = {}
    for i in range(200):
        w = [rng.choice("abcdef") for _ in range(100)]
        w[20:80:5] = [f"own{i}x{k}" for k in range(12)]
        texts[i] = " ".join(w)
    texts[777] = texts[5] + " and more"
    rows = jaccard_components(documents(spark, texts.items()), 3, Threshold(90, 100)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components(texts, 3, 90, 100)
    assert made == [2]


def test_texts_of_sizes_that_cannot_link_meet_in_no_cell(spark, monkeypatch):
    made = routed(monkeypatch)
    texts, n = {}, 60
    for i in range(0, 60, 2):
        # each pair shares its words with all, and is a seventh longer than the pair before
        texts[i] = " ".join(f"w{k}" for k in range(n))
        texts[i + 1] = texts[i] + f" last{i}"
        n += n // 7 + 1
    rows = jaccard_components(documents(spark, texts.items()), 3, Threshold(90, 100)).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: i - i % 2 for i in texts}
    assert 60 <= made[0] <= 300


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (1, 2), (1, 1)])
def test_bands_part_only_sizes_that_cannot_link(num, den):
    t = Threshold(num, den)
    sizes = np.arange(1, 3000)
    band = np.searchsorted(t.bands(), sizes, "right") - 1
    for n in sizes.tolist():
        near = sizes[(sizes >= n) & (num * sizes <= den * n)]
        assert set((band[near - 1] - band[n - 1]).tolist()) <= {0, 1}
        same = sizes[band == band[n - 1]]
        assert num * same.max() <= den * same.min()


def test_cells_hold_all_of_a_shingle_whose_sizes_may_link(spark):
    rng, t = random.Random(4), Threshold(90, 100)
    rows = []
    for key in range(80):
        sizes = rng.sample(range(1, 40) if key % 4 == 0 else range(1, 20_000), 2 + key // 4)
        band = (np.searchsorted(t.bands(), sizes, "right") - 1) % ngram_join.BITS
        rows += [(key, 1000 * key + i, n, b) for i, (n, b) in enumerate(zip(sizes, band.tolist(), strict=True))]
    cells = {r.cls: r.key for r in ngram_join.cells_of(spark.createDataFrame(rows, "key bigint, cls bigint, n bigint, band int"), t).collect()}
    cut = 0
    for k, a, n, _ in rows:
        for j, b, m, _ in rows:
            if k == j and n < m and 90 * m <= 100 * n:
                assert cells[a] == cells[b]
            cut += k == j and a < b and cells.get(a) != cells.get(b)
    assert cut > 1000


def test_join_of_empty_and_odd_tables(spark):
    assert jaccard_components(documents(spark, [(1, "a")]).where("doc_id > 5")).count() == 0
    rows = jaccard_components(documents(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, None)]).withColumn("id", F.lit(0)).withColumn("n", F.lit(0))).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (7, 7), (7, 7), (9, 9)]


def test_rtree_rules_out_no_pair_over_the_threshold():
    rng = np.random.default_rng(1)
    points = rng.poisson(2, (300, 32))
    points[::7] = points[0]
    sizes, t = points.sum(axis=1), Threshold(80, 100)
    tree = RTree(points, sizes)
    for i in range(0, 300, 11):
        bound = np.minimum(points, points[i]).sum(axis=1)
        needed = set(np.flatnonzero(180 * bound >= 80 * (sizes + sizes[i])).tolist())
        assert needed <= set(tree.search(points[i], int(sizes[i]), t).tolist())


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 99), (99, 98), (5, 5)], "a bigint, b bigint"))
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {98: 98, 99: 98, 100: 98}


def test_suffixes_are_sorted_and_prefixes_counted():
    rng = random.Random(3)
    for _ in range(200):
        n, letters = rng.randrange(1, 300), rng.choice([1, 2, 4, 26])
        text = np.array([97 + rng.randrange(letters) for _ in range(n)], np.uint8)
        wanted = np.array([rng.random() < 0.6 for _ in range(n)])
        words = words8(text, 64)
        order = sort_suffixes(text, wanted, words, 40)
        raw = bytes(text)
        keys = [raw[i : i + 40].ljust(40, b"\0") for i in order]
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist() and keys == sorted(keys)
        shared = [0] + [next((k for k in range(40) if a[k] != b[k]), 40) for a, b in zip(keys, keys[1:])]
        assert common_prefixes(order, words, 40).tolist() == (shared if len(order) else [])
        assert smaller_than_successor(text).tolist() == [raw[i:] < raw[i + 1 :] for i in range(n)]


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(hot)
    passage, other = prose(rng, 60), prose(rng, 25)
    texts = [prose(rng, rng.randrange(1, 90)) for _ in range(20)]
    texts += [f"{prose(rng, 10)} {passage} {prose(rng, 9)}" for _ in range(8)] + [f"{prose(rng, 30)} {other}" for _ in range(5)]
    texts += [texts[2], texts[2], "ab" * 400, "é" * 150, "é" * 151, "", None, "x" * 99, "x" * 100, "x" * 101, f"{passage} {passage}"]
    texts = {i * 2: t for i, t in enumerate(texts)}
    rows = remove_repeats(documents(spark, texts.items()), kept=True, keep=["lang"]).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == repeats(texts, 100)
    assert {r.lang for r in rows} == {"en"}


def test_repeats_of_odd_tables(spark):
    assert remove_repeats(documents(spark, [(1, "a")]).where("doc_id > 5")).count() == 0
    long = "abcdefghij" * 5 + "klmnopqrst" * 20
    docs = documents(spark, [(1, long), (1, long), (2, long), (None, long), (3, long), (3, "q" * 50)]).withColumn("id", F.lit(0)).withColumn("spans", F.lit(0))
    got = sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(docs).collect())
    inner = repeats({1: long}, 100)[1][1]
    assert got == sorted([(0, 0), (1, inner), (1, inner), (2, len(long)), (3, 0), (3, 0)])


def test_repeats_beyond_16_mib_of_a_text(spark):
    rng = random.Random(9)
    passage, filler = rng.randbytes(200).hex(), rng.randbytes(9_000_000).hex()
    kept = f"{filler[:9_000_000]}|{passage}|{filler[9_000_000:17_000_000]}<>{filler[17_000_000:]}"
    long = kept.replace("<>", f"<{passage}>")
    assert long.rindex(passage) > 1 << 24
    rows = {r.doc_id: r for r in remove_repeats(documents(spark, [(1, long), (2, f"({passage})")]), kept=True).collect()}
    assert (rows[1].n_removed, rows[1].n_spans, rows[2].n_removed, rows[2].n_spans) == (400, 1, 400, 1)
    assert rows[1].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest() and rows[1].kept == kept and rows[2].kept == "()"
