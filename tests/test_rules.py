"""What the rules find in the fixtures, and that clean text stays silent."""

import pytest

from vellumgrid.operators.audit import STATEMENTS, gated
from vellumgrid.plans.dialect import ENGINE, run
from vellumgrid.sources import fixtures
from vellumgrid.sources.tables import BLOCKS


def blocks(spark, rows):
    return spark.createDataFrame([(d, b, t) for d, b, t in rows], BLOCKS)


@pytest.fixture(scope="module")
def found(spark):
    out = {}
    for r in run(spark, gated(ENGINE), blocks=blocks(spark, fixtures.BLOCKS)).collect():
        out.setdefault(r.rule_id, []).append(r)
    return out


WANT = {
    "TEXT_WORD_DUPLICATION": {(-1, 0, " kelime")},
    "TEXT_PARAGRAPH_DUPLICATION": {(-1, 2, None)},
    "TYPO_DOUBLE_PUNCTUATION": {(-2, 0, ".."), (-2, 0, ",,"), (-2, 0, "!!"), (-2, 0, ";.")},
    "TYPO_MULTIPLE_SPACES": {(-2, 3, "  "), (-2, 3, "   ")},
    "TYPO_BRACKET_PADDING": {(-2, 5, " ")},
    "TYPO_REPLACEMENT_CHAR": {(-3, 0, "�")},
    "TYPO_MIXED_DASH": {(-3, 1, "-—")},
    "DRAFT_PLACEHOLDER": {(-4, 0, "[İSİM]"), (-4, 0, "........"), (-4, 0, "____"), (-4, 0, "XXXX")},
    "DRAFT_DANGLING_CONNECTOR": {(-4, 1, "ve")},
    "DRAFT_EMPTY_NUMBERED": {(-4, 2, "1.")},
    "ORTHO_USER_DICTIONARY": {(-9, 1, "karari"), (-9, 1, "Karari"), (-8, 3, "muvekkil")},
}


@pytest.mark.parametrize("rule", sorted(WANT))
def test_rule_finds_what_it_should(found, rule):
    texts = {(r.doc_id, r.block_index, r.original) for r in found[rule]}
    for d, b, original in WANT[rule]:
        assert any((d, b) == x[:2] and original in (None, x[2]) for x in texts), texts


def test_every_rule_finds_something(spark):
    source = blocks(spark, fixtures.BLOCKS)
    silent = [n for n, s in STATEMENTS.items() if run(spark, s(ENGINE), blocks=source).isEmpty()]
    assert silent in ([], ["r02_sentence_duplication"])


def test_clean_text_is_silent(spark):
    clean = [(1, 0, "Davacı vekili dilekçesinde alacağın tahsilini istemiştir."), (1, 1, "Mahkeme, Ek-3'te yer alan raporu 1.250,50 TL üzerinden değerlendirdi."), (1, 2, "Sonuç olarak dava kabul edilmiştir; karar kesindir (bkz. dosya).")]
    assert run(spark, gated(ENGINE), blocks=blocks(spark, clean)).collect() == []


def test_offsets_point_at_the_original(found):
    texts = {(d, b): t for d, b, t in fixtures.BLOCKS}
    for rule in ("TEXT_WORD_DUPLICATION", "TYPO_DOUBLE_PUNCTUATION", "TYPO_MULTIPLE_SPACES", "DRAFT_PLACEHOLDER"):
        for r in found[rule]:
            assert texts[r.doc_id, r.block_index][r.char_start : r.char_end] == r.original


def test_sequences_equal_a_walk(spark):
    """Gaps and steps back as a walk over the markers finds them: a lesser depth or a new section closes deeper lists."""
    from vellumgrid.operators.structure import markers, sequences
    from vellumgrid.plans.dialect import Statement

    source = blocks(spark, fixtures.BLOCKS)
    rows = run(spark, Statement("SELECT * FROM markers", markers(ENGINE)), blocks=source).orderBy("doc_id", "block_index").collect()
    want, state = set(), {}
    for m in rows:
        own = state.setdefault((m.doc_id, m.section), {})
        for depth in [x for x in own if x > m.depth]:
            del own[depth]
        before, own[m.depth] = own.get(m.depth), m.value
        if before is not None and m.value != before + 1:
            want.add((m.doc_id, m.block_index, before, m.value))
    got = {(r.doc_id, r.block_index, r.before, r.value) for r in run(spark, sequences(ENGINE), blocks=source).collect()}
    assert got == want and got


def test_corrected_text_audits_clean(spark):
    """Fixes leave nothing for their own rules, and text without fixes as it was."""
    from vellumgrid.operators.audit import all_findings
    from vellumgrid.operators.corrections import RULES, STATEMENTS
    from vellumgrid.plans.dialect import Statement

    source = blocks(spark, fixtures.BLOCKS)
    fixed = run(spark, STATEMENTS["k02_corrected_copy"](ENGINE), blocks=source)
    texts = {(r.doc_id, r.block_index): r.text for r in fixed.collect()}
    assert len(texts) == len(fixtures.BLOCKS) and texts[-10, 0] == fixtures.BLOCKS[[x[:2] for x in fixtures.BLOCKS].index((-10, 0))][2]
    assert texts[-2, 3] == "İki boşluk fazla var. " and texts[-2, 5] == "Parantez (içi boşluk) ve [köşeli] ile (düzgün) metin."
    again = blocks(spark, [(d, b, t) for (d, b), t in texts.items()])
    left = run(spark, Statement("SELECT * FROM findings WHERE replacement IS NOT NULL", all_findings(ENGINE, RULES)), blocks=again)
    assert left.isEmpty()


def test_blocks_that_cannot_break_a_rule_are_not_cut(spark):
    """Sieves change no finding, and stand before the text is cut."""
    from vellumgrid.plans.dialect import ORACLE, Dialect

    class Whole(Dialect):
        def sieve(self, cond):
            return "true"

    texts = ["the the", "The  tHE end", "the theory", "other the", "ab ab", "12 12 123 123", "ΣΑΣ ΣΑΣ.Α", "ΟΔΟΣ οδος", "IŞIK ışık", "İyi iyi'", "don't don't’", "a\tword word\tb", "x word\nword", "çok çok", "HERŞEY ve birŞEY", "hiçbirşey", "yadasında", "KARARI karari", "Muvekkil", "", "word " * 30]
    source = blocks(spark, [*((1, i, t) for i, t in enumerate(texts)), (2, 0, None)])
    for name in ("r01_word_duplication", "r37_separate_writing", "r38_user_dictionary"):
        got = run(spark, STATEMENTS[name](ENGINE), blocks=source).collect()
        assert got and sorted(map(repr, got)) == sorted(map(repr, run(spark, STATEMENTS[name](Whole()), blocks=source).collect()))
        assert "WHERE true" not in STATEMENTS[name](ENGINE).text() and "WHERE true" in STATEMENTS[name](ORACLE).text()
