"""Every query that has SQL equals it on the smallest tables; the others are held against plain Python elsewhere."""

import os

import pytest

from tests.compare import compare, duck
from vellumgrid.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
#: Fast ones of each family; tests/compare.py runs all.
SAMPLE = [
    "p01_tr_lower", "p05_normalize", "p24_dot_roles", "p26_safe_file_name", "p32_classify_block", "m02_roman_values", "m04_amounts", "m05_markers",
    "r01_word_duplication", "r02_sentence_duplication", "r03_paragraph_duplication", "r04_near_copies", "r05_double_punctuation", "r09_apostrophe_spacing", "r12_unbalanced_quotes", "r13_invisible_characters", "r17_placeholders", "r20_sequences", "r22_orphans", "r25_attachment_missing",
    "r32_citation_format", "r35_term_spelling", "r37_separate_writing", "r38_user_dictionary", "t02_top_k_per_rule", "a13_page_accounting", "a17_multiset_overlap", "j04_bounded_distance", "j12_planned_and_written", "u06_interval_compaction", "e17_page_ranges", "g10_interval_tiling", "m11_percentages",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, SF, catalog.queries()[name], catalog.oracle_sql()[name]) is None


def test_every_statement_parses_in_both_dialects(con):
    for name, sql in catalog.oracle_sql().items():
        con.execute(f"explain {sql}")
        assert name in catalog.queries()
