import random

import pytest

from vellumgrid.operators import sequential
from vellumgrid.operators import versions as v
from vellumgrid.sources import containers


def texts(rng, n):
    return [" ".join(rng.choice("madde taraf bedel süre gün kira ödeme ve ile için sözleşme hüküm".split()) for _ in range(rng.randrange(3, 15))) + f" {rng.randrange(99)}." for _ in range(n)]


@pytest.mark.parametrize("seed", range(20))
def test_comparison_properties(seed):
    rng = random.Random(seed)
    base = texts(rng, rng.randrange(1, 9))
    assert {r["kind"] for r in v.compare_blocks(base, base)} == {"equal"}
    revised = [t for t in base if rng.random() > 0.2] + texts(rng, 1)
    rows = list(v.compare_blocks(base, revised))
    assert sorted(r["base_place"] for r in rows if r["base_place"] is not None) == list(range(len(base)))
    assert sorted(r["revised_place"] for r in rows if r["revised_place"] is not None) == list(range(len(revised)))
    back = list(v.compare_blocks(revised, base))
    count = lambda rs: sum(r["kind"] != "equal" for r in rs)
    assert abs(count(rows) - count(back)) <= 2


@pytest.mark.parametrize("seed", range(20))
def test_diff_gives_both_texts(seed):
    rng = random.Random(seed)
    a, b = texts(rng, 2)
    parts = v.word_diff(a, b)
    assert " ".join(t for k, t in parts if k != "added").split() == v.tokens(a) and " ".join(t for k, t in parts if k != "removed").split() == v.tokens(b)


def test_relocated_block_is_one_row():
    base = ["Birinci hüküm burada uzun uzun yazılıdır.", "İkinci hüküm burada uzun uzun yazılıdır.", "Üçüncü hüküm de burada yer almaktadır."]
    rows = list(v.compare_blocks(base, [base[2], base[0], base[1]]))
    assert len(rows) == 3 and {r["kind"] for r in rows} <= {"equal", "moved"}


def test_long_documents_are_compared_whole(spark, tmp_path):
    texts = {1: "\n".join(f"Madde {i} bu sözleşmenin {i * 7} sayılı hükmüdür." for i in range(95)), 2: "\n".join(["aynı satır", "öbür satır"] * 60)}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = sequential.d20_compare_versions(spark, str(tmp_path)).where("pair_id >= 1000").collect()
    for i, t in texts.items():
        n = t.count("\n") + 1
        assert sorted(r.base_place for r in rows if r.pair_id == 1000 + i and r.base_place is not None) == list(range(n))
        assert sorted(r.revised_place for r in rows if r.pair_id == 1000 + i and r.revised_place is not None) == list(range(n - n // 7))


def test_common_run_is_counted_up_to_its_limit():
    assert v.common_run("a b c d".split(), "x b c y".split()) == 2 and v.common_run(list("abcdefgh"), list("abcdefgh")) == v.RUN and v.common_run(["a"], ["b"]) == 0


def test_number_words_both_ways():
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randrange(10 ** rng.randrange(1, 18))
        assert v.words_number(v.number_words(n)) == n
    assert v.words_number("bin iki yüz elli") == 1250 and v.words_number("kalem") is None


def test_inflections():
    forms = v.inflections("kitap")
    assert len(forms) == 98 and forms["acc"] == "kitabı" and forms["plural+dat"] == "kitaplara" and v.inflections("söz")["loc"] == "sözde"
    assert v.transfer("karari", "kararı", "kararinin") == ("safe", "kararının") and v.transfer("karari", "kararı", "masa") == ("none", None)


def test_sentences_and_brackets():
    text = "Av. Ali geldi. Sonra 3. kat çıktı! A. Veli gitti."
    assert [text[a:b] for a, b in v.sentences(text)] == ["Av. Ali geldi.", "Sonra 3. kat çıktı!", "A. Veli gitti."]
    assert v.unmatched_brackets("a (b [c) d]") == [2, 7] or v.unmatched_brackets("a (b [c) d]")


def test_packages(spark):
    rows = containers.read_packages(containers.sample_packages(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path, []).append(r)
    assert [r.text for r in by["a/ornek.docx"]] == ["GİRİŞ", "Bu bu\tmetin", "hücre"] and by["a/ornek.docx"][2].kind == "table_cell"
    assert [r.text for r in by["b/belge.udf"]] == ["İlk satır", "𝒳 ikinci"]
    assert by["c/bozuk.docx"][0].error and by["d/not.txt"][0].error


def test_html_entries():
    html = "<h1>Başlık</h1><ol start=3><li>üç</li><li value=7><p>yedi</p></li></ol><ul><li>a<ul><li>b</li></ul></li></ul><table><tr><td>x</td><td></td><td>y</td></tr></table><p>son<br>söz</p><script>no</script>"
    assert containers.html_entries(html) == [("h1", 0, 0, "Başlık"), ("li", 3, 1, "üç"), ("li", 7, 1, "yedi"), ("li", 0, 1, "a"), ("li", 0, 2, "b"), ("tr", 0, 0, "x |  | y"), ("p", 0, 0, "son söz")]


def test_parts_stay_under_the_cap(spark):
    rows = sequential.e14_size_bounded_parts(spark, "", 6000).collect()
    pages = {(r.exhibit_id, r.source_page): r.bytes for r in sequential.exhibit_pages(spark).collect()}
    sums = {}
    for r in rows:
        sums.setdefault((r.exhibit_id, r.part), []).append(pages[r.exhibit_id, r.source_page])
    assert all(sum(x) <= 6000 or len(x) == 1 for x in sums.values()) and sum(map(len, sums.values())) == len(pages)


def test_stream_of_documents(spark, tmp_path):
    from vellumgrid.streaming.reaudit import audit_stream

    spark.createDataFrame([(1, "Bu kelime kelime iki kez.."), (2, "Temiz bir cümle.")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
    audit_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1}
