import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import base_counts, documents, prose
from vellumgrid.llm.language_id import UNKNOWN, identify_language
from vellumgrid.llm.mixing import mix_sources
from vellumgrid.llm.quality import js_distance, quality_rules
from vellumgrid.llm.topk_search import top_k
from vellumgrid.llm.toxicity import Trie, quotation, score_toxicity
from vellumgrid.llm.url_filter import filter_urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def brute_url(url):
    import re

    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_urls_equal_brute_force(spark):
    rng = random.Random(1)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "xexample.com", "x.net", "NET", "a..net", "", "com.net"]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS", "a://b") for h in hosts for p in ("", "/", "/en/", "/en", "/es/x?y=/en/", "?a", "#/en/", "/es/\n")]
    urls += [None, "", "no scheme", "://", "http:/x", "http://" + "a." * 400 + "com/x"] + [f"http://h{rng.randrange(10**9)}.example.com/en/{i}" for i in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("rule", F.lit(1)).withColumns({c: F.lit("k") for c in ("key", "_best", "probe", "size", "length")})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, RULES).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)}
    assert {"_best", "probe", "length"} <= set(filter_urls(pages, RULES).columns)
    listed = spark.createDataFrame([*RULES, (None, "/", "block"), RULES[0]], "host string, path string, verdict string")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages.unionByName(pages), listed).collect()} == got
    assert {r.verdict for r in filter_urls(pages, []).collect()} == {"allow"} and filter_urls(pages.where("page_id < 0"), RULES).count() == 0


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(1, 200), rng.choice([5, 50, 500])) for _ in range(60)] + [None, "", " \t\n", "a b a b a b", "x\n\nx\n x\ny " * 9, "$$$ || <> " * 30, "é ü\x0bß\x0c" * 40, "a b c a b c a b"]
    docs = documents(spark, [(i, t, None if i % 5 == 0 else "en") for i, t in enumerate(texts)]).withColumn("n_words", F.lit("clash"))
    rows = quality_rules(docs).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == {i: base_counts(t) for i, t in enumerate(texts)}
    assert all(not (r.kept and r.base_failed) for r in rows)
    assert quality_rules(docs.where("doc_id < 0")).count() == 0


def test_divergence_rejects_what_is_unlike_its_language(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "the of and to in for that with".split() for b in ("", "ing", "er")]
    fine = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(40)]
    odd = " ".join(f"{rng.randrange(10**6)}%%%" for _ in range(150))
    rows = {r.doc_id: r for r in quality_rules(documents(spark, [*enumerate(fine), (99, odd)])).collect()}
    assert not rows[99].base_failed and not rows[99].kept and all(rows[i].kept for i in range(40))


def test_every_language_is_held_against_its_own_reference(spark):
    rng = random.Random(7)
    text = lambda stems: " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(80))
    rows = [(100 * k + i, text([f"{chr(97 + k % 26)}{x}" for x in "aeiou"]), f"l{k:02}") for k in range(34) for i in range(21)]
    rows += [(90_000 + i, text(["नम", "कर", "यह", "वह", "हम"]), "hi") for i in range(20)] + [(91_000 + i, text(["ไทย", "ภาษ", "คำก", "ดีม"]), "th") for i in range(19)]
    odd = " ".join(f"{rng.randrange(10**6)}%%%" for _ in range(150))
    got = {r.doc_id: r for r in quality_rules(documents(spark, [*rows, (99_000, odd, "hi")])).collect()}
    assert len(got) == len(rows) + 1 and all(got[i].kept for i, _, _ in rows)
    assert got[90_000].char_distance < 0.3 and got[91_000].char_distance is None and not got[99_000].kept


def test_divergence_rejects_word_salad_and_other_languages(spark):
    rng = random.Random(11)
    common = {"aa": "the of and to in for that with".split(), "bb": "le de et la un est que pour".split()}
    stems = {"aa": [f"{x}{y}" for x in "lorng stomp credl".split() for y in ("ing", "er", "able")], "bb": [f"{x}{y}" for x in "lontr estem crudl".split() for y in ("eux", "ique", "ant")]}
    text = lambda n, share, k=120: " ".join(rng.choice(common[n]) if rng.random() < share else rng.choice(stems[n]) for _ in range(k))
    rows = [(100 * j + i, text(n, 0.25), n) for j, n in enumerate(stems) for i in range(40)]
    odd = [(1000 + i, text(n, 0.0), n) for i, n in enumerate(stems)] + [(2000, text("bb", 0.25), "aa"), (2001, text("aa", 0.25), "bb")]
    free = [(3000, text("aa", 0.25), None), (3001, text("bb", 0.0), None), (3002, text("aa", 0.0, 50), "aa")]
    got = {r.doc_id: r for r in quality_rules(documents(spark, rows + odd + free)).collect()}
    assert all(got[i].kept for i, _, _ in rows) and not any(got[i].kept for i, _, _ in odd)
    assert got[3000].kept and not got[3001].kept and got[3002].kept and got[3002].word_ratio is None
    assert all(abs(got[1000 + i].word_ratio - 1) < 0.01 for i in range(2))


def test_js_distance(spark):
    r = spark.range(1).select(js_distance(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))).alias("same"), js_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("apart")).first()
    assert r.same == 0 and abs(r.apart - 1) < 1e-12


def test_language_on_held_out_texts(spark):
    rng = random.Random(3)
    stems = {"aa": "thion enda ster".split(), "bb": "euxque lamen oire".split(), "cc": "schung keit über".split()}
    rows = [(i, " ".join("".join(rng.choices(stems[n], k=2)) for _ in range(30)), n) for i, n in enumerate(rng.choices(sorted(stems), k=150))]
    odd = [(1000, None), (1001, ""), (1002, "123 !!"), (None, "thion thion thion")]
    docs = documents(spark, rows + odd).withColumn("score", F.lit("x")).withColumn("id", F.lit("y"))
    got = {r.doc_id: r for r in identify_language(docs, F.col("doc_id") % 3 != 1).collect()}
    held = [r for r in rows if r[0] % 3 == 1]
    assert np.mean([got[i].lang_pred == n for i, _, n in held]) > 0.95
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == [UNKNOWN] * 3 and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert identify_language(docs.where("doc_id < 0"), F.lit(True)).count() == 0


@pytest.mark.parametrize(("n", "d", "spread"), [(300, 8, 90), (60, 3, 2), (5, 4, 50)])
def test_top_k_equals_brute_force(spark, n, d, spread):
    rng = np.random.default_rng(n)
    values = rng.integers(-spread, spread + 1, (n, d))
    rows = [(i, [float(x) / 256 for x in v]) for i, v in enumerate(values)] + [(900, None), (950, [float("nan")] * d), (1000, [None] * d), (None, [0.5] * d)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(9)).withColumn("q", F.lit("x"))
    got = {}
    for r in top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {}
    for i in range(0, n, 50):
        scores = values @ values[i]
        want[i] = sorted(((j, int(scores[j])) for j in range(n) if j != i), key=lambda x: (-x[1], x[0]))[:5]
    assert got == {k: v for k, v in want.items() if v}


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(4)
    for most in (10**6, 10**7, 10**9, 10**17, 10**25):
        values = [[float(x) for x in rng.normal(size=6) * most] for _ in range(120)]
        rows = [*enumerate(values), (7, [float(most)] * 6)]
        whole = [(i, [min(max(int(np.floor(256 * x)), -(1 << 61)), 1 << 61) for x in v]) for i, v in rows]
        got = {}
        for r in top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        for q in (0, 50, 100):
            sums = [(sum(a * b for a, b in zip(whole[q][1], v)), i) for i, v in whole if i != q]
            assert got[q] == [(i, -s) for s, i in sorted((-min(max(s, -(1 << 63)), (1 << 63) - 1), i) for s, i in sums)[:5]], most


def test_top_k_with_blocks(spark, monkeypatch):
    from vellumgrid.llm import topk_search

    monkeypatch.setattr(topk_search, "CANDIDATES", 16)
    monkeypatch.setattr(topk_search, "QUERIES", 1)
    test_top_k_equals_brute_force(spark, 300, 8, 90)


@pytest.mark.parametrize("kind", ["even", "falling", "lengths", "copies"])
def test_top_k_takes_a_batch_of_queries_at_once(kind):
    """All pairs of 512 queries and 16,384 candidates: a hundredth of a microsecond each, where one query at a time took half of one."""
    from vellumgrid.llm.topk_search import Index

    rng = np.random.default_rng(8)
    n, d = 16_384, 64
    shape = {"falling": 0.85 ** np.arange(d), "lengths": rng.lognormal(0, 1.5, (n, 1))}.get(kind, 1.0)
    values = np.floor(rng.normal(size=(n, d)) * 60 * shape).astype(np.int64)
    if kind == "copies":
        values[rng.random(n) < 0.1] = values[0]
    ids, asks = rng.permutation(n), np.arange(0, n, n // 512)
    before = time.process_time()
    places, found, scores = Index(ids, values).search(values[asks], ids[asks], 5)
    assert time.process_time() - before < 2.5
    sums = (values[asks].astype(float) @ values.T.astype(float)).astype(np.int64)
    sums[np.arange(len(asks)), asks] = np.iinfo(np.int64).min
    top = [np.lexsort((ids, -row.astype(float)))[:5] for row in sums]
    assert places.tolist() == np.repeat(np.arange(len(asks)), 5).tolist()
    assert found.tolist() == ids[np.concatenate(top)].tolist()
    assert scores.tolist() == np.concatenate([row[x] for row, x in zip(sums, top, strict=True)]).tolist()


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(0, 60)), "en", s) for i, s in enumerate(rng.choices(["a", "b", "c", "d", "", None], weights=[20, 9, 30, 1, 3, 2], k=1500))]
    docs = documents(spark, rows).withColumn("size", F.lit("x")).withColumn("target", F.lit(0))
    got = mix_sources(docs).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mix_sources(docs.repartition(7)).collect())
    sizes, taken, targets = {}, {}, {}
    for r in got:
        s = rows[r.doc_id][3]
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
        targets[s] = r.target
        assert r.taken <= 3 * r.size and r.size == len((rows[r.doc_id][1] or "").split())
    want, free = {}, sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(free)}
    rest = sum(sizes.values())
    while True:
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * sizes[s]
            rest -= want[s]
        free = [s for s in free if s not in over]
    want |= share
    assert all(abs(targets[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - targets[s]) <= 60 for s in sizes)
    assert mix_sources(docs.where("doc_id < 0")).count() == 0


def test_mix_takes_the_documents_of_a_plain_pareto_order(spark):
    rng = random.Random(16)
    rows = [(i, prose(rng, rng.choice([0, 3, 7, 20, 20, 45, 300])), "en", s) for i, s in enumerate(rng.choices(["a", "b", "c"], weights=[60, 9, 30], k=900))]
    rows += [(900 + i, rows[5][1], "en", rows[5][3]) for i in range(40)] + [(None, "x y z", "en", "b"), (3, rows[3][1], "en", rows[3][3])]
    docs = documents(spark, rows)
    got = mix_sources(docs, keep=["source"]).collect()
    hashes = [r.h / 2**64 if r.h >= 0 else (r.h + 2**64) / 2**64 for r in docs.select(F.xxhash64(F.lit(7), "doc_id", "source", "text").alias("h")).collect()]
    want = {}
    for s in "abc":
        own = [(x[0], len((x[1] or "").split()), h) for x, h in zip(rows, hashes, strict=True) if x[3] == s]
        target = next(r.target for r in got if r.source == s)
        rate = target / sum(n for _, n, _ in own)
        due, lo, hi = (rate - int(rate)) * sum(n for _, n, _ in own), 0.0, 1.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(n * min(1, mid * n) for _, n, _ in own) < due else (lo, mid)
        extra, total = set(), 0
        ranks = [(0.0 if (p := min(1, hi * n)) >= 1 else h / (1 - h) / (p / (1 - p)), k) for k, (_, n, h) in enumerate(own) if n and due]
        order = [k for _, k in sorted(ranks)]
        while order and total + own[order[0]][1] <= due:
            total += own[order[0]][1]
            extra.add(order.pop(0))
        off, _, last = min(((abs(own[k][1] - (due - total)), j, k) for j, k in enumerate(order)), default=(due - total, 0, 0))
        if off < due - total:
            extra.add(last)
        for k, (i, n, _) in enumerate(own):
            want[i, n, s] = want.get((i, n, s), 0) + n * (int(rate) + (k in extra))
    taken = {}
    for r in got:
        taken[r.doc_id, r.size, r.source] = taken.get((r.doc_id, r.size, r.source), 0) + r.taken
    assert taken == want


def test_lexicon_finds_misspelt_terms():
    trie = Trie(["idiot", "scum", "disgusting", "slim*"])
    assert trie.find("idiot") == (0, 0) and trie.find("idoit") is None and trie.find("idi0t") == (1, 0) and trie.find("idiott") == (1, 0) and trie.find("diot") == (1, 0)
    assert trie.find("sc*m") is None or trie.find("sc*m")[1] == 1
    assert trie.find("scam") is None and trie.find("disgustin") == (1, 2) and trie.find("slimeball") == (0, 3) and trie.find("table") is None


def test_context_tells_quotation():
    words = 'he said "you idiot" and left'.split()
    assert quotation(words, 3) == 1.0 and quotation("you are an idiot and worse".split(), 3) == 0


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(8)
    bad = ["zonker", "blarfing", "gritweed"]
    rows, labels = [], []
    for i in range(400):
        w = prose(rng, 60).split()
        toxic = i % 3 == 0
        for _ in range(3 if toxic else 0):
            w[rng.randrange(60)] = rng.choice(bad) if i % 2 else rng.choice(bad)[:-1] + "x"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (None, "zonker zonker")]
    docs, marks = documents(spark, rows).withColumn("score", F.lit("x")), spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, marks, F.col("id") % 4 != 2).collect()}
    held = [x for x in labels if x[0] % 4 == 2]
    assert np.mean([got[i].predicted == y for i, _, y in held]) > 0.95
    assert got[900].predicted == got[901].predicted == 0 and got[None].predicted == 1
    none = score_toxicity(docs, marks.where("doc_id < 0"), F.lit(True)).collect()
    assert {r.score for r in none} == {0.0} and score_toxicity(docs.where("doc_id < 0"), marks, F.lit(True)).count() == 0
