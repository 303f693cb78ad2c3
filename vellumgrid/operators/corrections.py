"""Fixes applied to blocks: stale and overlapping ones are refused, the others are spliced in by their offsets."""

from __future__ import annotations

from vellumgrid.operators.audit import all_findings
from vellumgrid.plans.dialect import Dialect, Statement

#: Rules whose fixes are mechanical and local.
RULES = ("r01_word_duplication", "r05_double_punctuation", "r06_space_before_punctuation", "r08_multiple_spaces", "r10_bracket_padding", "r13_invisible_characters")


def edits(d: Dialect) -> tuple[tuple[str, str], ...]:
    """Relation edits: valid fixes with the end of the one before (previous), and refused: the others with a reason."""
    order = "PARTITION BY doc_id, block_index ORDER BY char_start, char_end, rule_id"
    return (
        *all_findings(d, RULES),
        ("fixes", f"SELECT f.*, b.text, max(f.char_end) OVER (PARTITION BY f.doc_id, f.block_index ORDER BY f.char_start, f.char_end, f.rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM findings f JOIN blocks b ON f.doc_id = b.doc_id AND f.block_index = b.block_index WHERE f.replacement IS NOT NULL"),
        ("checked", "SELECT *, CASE WHEN substring(text, CAST(char_start + 1 AS INT), CAST(char_end - char_start AS INT)) <> original THEN 'stale' WHEN char_start < coalesce(before, 0) THEN 'overlap' ELSE 'valid' END AS state FROM fixes"),
        ("edits", f"SELECT *, coalesce(lag(char_end) OVER ({order}), 0) AS previous FROM checked WHERE state = 'valid'"),
    )


def corrected_blocks(d: Dialect) -> Statement:
    """doc_id, block_index and corrected text of the blocks that have valid fixes."""
    piece = "concat(substring(text, CAST(previous + 1 AS INT), CAST(char_start - previous AS INT)), replacement)"
    parts = (
        *edits(d),
        ("spliced", f"SELECT doc_id, block_index, {d.collect(piece, 'char_start', '')} AS head, max(char_end) AS last_end, max(text) AS text, count(*) AS fixes FROM edits GROUP BY doc_id, block_index"),
    )
    return Statement("SELECT doc_id, block_index, concat(head, substring(text, CAST(last_end + 1 AS INT))) AS corrected, fixes FROM spliced", parts)


STATEMENTS = {
    "d_apply_corrections": corrected_blocks,
    "d_apply_refused": lambda d: Statement("SELECT doc_id, block_index, rule_id, char_start, char_end, state FROM checked WHERE state <> 'valid'", edits(d)),
    "k02_corrected_copy": lambda d: Statement("SELECT b.doc_id, b.block_index, coalesce(c.corrected, b.text) AS text FROM blocks b LEFT JOIN corrected c ON b.doc_id = c.doc_id AND b.block_index = c.block_index", (*corrected_blocks(d).parts, ("corrected", corrected_blocks(d).final))),
}
