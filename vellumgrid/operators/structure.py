"""Numbering, sections, attachments and near copies: findings that look across the blocks of a document."""

from __future__ import annotations

from vellumgrid.functions import text as f
from vellumgrid.plans.dialect import Dialect, Statement

#: An opening bracket, a body of digits, one letter or a Roman numeral, its decoration, and blank or the line's end.
MARKER = r"^ *([(\[]?)([0-9]{1,3}|\p{L}|[IVXLCDM]{2,6}|[ivxlcdm]{2,6})([.)\]]|  *[-–—]|[-–—])($| +)"
SHAPES = ("digit", "upper", "lower")


def markers(d: Dialect) -> tuple[tuple[str, str], ...]:
    """Relation markers: doc_id, block_index, core, decoration, class, shape, depth (order of first appearance), section
    (unnumbered headings before it), value (under the reading of its shape) and text_start."""
    part = lambda g: d.extract("text", MARKER, g)
    heading = f"({f.words(d, 'text')} BETWEEN 1 AND 12 AND NOT {d.like('text', '[.;,] *$')} AND {d.like('text', r'\p{L}')} AND text = {f.tr_upper(d, 'text')})"
    turkish_only = d.like("core", "^[ÇĞİÖŞÜçğıöşü]$")
    one = lambda a: f.letter_value(d, "core", a)
    return (
        ("parsed", f"SELECT doc_id, block_index, text, {part(1)} AS bracket, {part(2)} AS core, trim({part(3)}) AS deco, CAST(length({part(0)}) AS BIGINT) AS text_start, {heading} AS heading FROM blocks"),
        (
            "shaped",
            "SELECT *, CASE WHEN core = '' THEN NULL WHEN bracket <> '' AND deco NOT IN (')', ']') THEN NULL WHEN bracket = '' AND deco = ']' THEN NULL "
            "WHEN bracket <> '' THEN 'bracketed' WHEN deco = '.' THEN 'dot' WHEN deco = ')' THEN 'paren' ELSE 'dash' END AS decoration, "
            f"CASE WHEN {d.like('core', '^[0-9]+$')} THEN 'digit' WHEN core = {f.tr_upper(d, 'core')} THEN 'upper' ELSE 'lower' END AS class FROM parsed",
        ),
        ("sectioned", "SELECT *, CAST(sum(CASE WHEN heading AND decoration IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS section FROM shaped"),
        ("entries", "SELECT doc_id, block_index, text, core, decoration, class, concat(class, ':', decoration) AS shape, section, text_start FROM sectioned WHERE decoration IS NOT NULL AND core <> '0'"),
        (
            "readings",
            f"SELECT doc_id, shape, min(block_index) AS first_block, max(CASE WHEN length(core) > 1 AND class <> 'digit' THEN 1 ELSE 0 END) AS roman, max(CASE WHEN {turkish_only} THEN 1 ELSE 0 END) AS turkish FROM entries GROUP BY doc_id, shape",
        ),
        ("depths", "SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY first_block) - 1 AS BIGINT) AS depth FROM readings"),
        (
            "valued",
            "SELECT e.*, p.depth, CASE WHEN class = 'digit' THEN CAST(CASE WHEN class = 'digit' THEN core ELSE '0' END AS BIGINT) "
            f"WHEN roman = 1 THEN {f.roman_value(d, 'core')} WHEN turkish = 1 THEN {one('turkish')} ELSE {one('latin')} END AS value FROM entries e JOIN depths p ON e.doc_id = p.doc_id AND e.shape = p.shape",
        ),
        ("markers", "SELECT doc_id, block_index, core, decoration, class, shape, depth, section, value, text_start FROM valued WHERE value > 0"),
    )


LEVELS = 6


def sequences(d: Dialect) -> Statement:
    """Gaps, repeats and steps back. Each marker is held against the one before it at its depth, in its section, with no
    marker of a lesser depth between: as many lesser ones stand before both."""
    running = ", ".join(f"sum(CASE WHEN depth < {k} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS less{k}" for k in range(1, LEVELS + 1))
    pick = "CASE " + " ".join(f"WHEN depth = {k} THEN less{k}" for k in range(1, LEVELS)) + f" WHEN depth >= {LEVELS} THEN less{LEVELS} ELSE 0 END"
    parts = (
        *markers(d),
        ("counted", f"SELECT *, {running} FROM markers"),
        ("runs", f"SELECT *, {pick} AS parent_run FROM counted"),
        ("steps", "SELECT *, lag(value) OVER (PARTITION BY doc_id, section, depth, parent_run ORDER BY block_index) AS before FROM runs"),
    )
    kind = "CASE WHEN value = before THEN 'SEC_SEQ_DUPLICATE' WHEN value < before THEN 'SEC_SEQ_BACKTRACK' ELSE 'SEC_SEQ_GAP' END"
    return Statement(f"SELECT doc_id, block_index, {kind} AS rule_id, before, value FROM steps WHERE before IS NOT NULL AND value <> before + 1", parts)


def orphans(d: Dialect) -> Statement:
    """Markers of a level whose parent level, by the usual ladder of shapes, has not been seen."""
    ladder = "CASE WHEN class = 'upper' AND length(core) > 1 THEN 0 WHEN class = 'upper' THEN 1 WHEN class = 'digit' AND decoration <> 'bracketed' THEN 2 WHEN class = 'lower' AND decoration <> 'bracketed' THEN 3 ELSE 4 END"
    parts = (
        *markers(d),
        ("rungs", f"SELECT doc_id, block_index, {ladder} AS rung FROM markers"),
        ("ranked", "SELECT doc_id, block_index, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY rung) - 1 AS BIGINT) AS level FROM rungs"),
        ("firsts", "SELECT doc_id, level, min(block_index) AS first_block FROM ranked GROUP BY doc_id, level"),
    )
    return Statement("SELECT r.doc_id, r.block_index, r.level FROM ranked r JOIN firsts p ON r.doc_id = p.doc_id AND p.level = r.level - 1 WHERE r.block_index < p.first_block", parts)


def empty_sections(d: Dialect) -> Statement:
    """Unnumbered headings that another heading or the end follows without text between."""
    parts = (
        *markers(d)[:3],
        ("solid", "SELECT doc_id, block_index, section, heading AND decoration IS NULL AS opens FROM sectioned WHERE trim(text) <> ''"),
        ("sections", "SELECT doc_id, section, min(block_index) AS block_index, count(*) AS n FROM solid WHERE section > 0 GROUP BY doc_id, section"),
    )
    return Statement("SELECT doc_id, block_index, section FROM sections WHERE n = 1", parts)


def attachments(d: Dialect) -> tuple[tuple[str, str], ...]:
    """Relation attachments: doc_id, block_index, number, is_definition (first in the only place of a block, no suffix)."""
    upper = f.tr_upper(d, "text")
    pattern = r"(^|[^\p{L}\p{N}])EK *[-–]? *([0-9]{1,3})"
    return (
        ("mentions", f"SELECT doc_id, block_index, text, {d.extract_all(upper, pattern, 2)} AS numbers FROM blocks WHERE {d.like(upper, pattern)}"),
        ("attached", d.explode("mentions", "doc_id, block_index, text, numbers", "numbers", "number")),
        ("attachments", f"SELECT doc_id, block_index, CAST(number AS BIGINT) AS number, ({d.size('numbers')} = 1 AND {d.like(upper, r'^ *EK *[-–]? *[0-9]{1,3}([^0-9\p{L}' + chr(39) + '’]|$)')}) AS is_definition FROM attached"),
        ("defined", "SELECT doc_id, number, max(block_index) AS block_index FROM attachments WHERE is_definition GROUP BY doc_id, number"),
    )


def attachment_gaps(d: Dialect) -> Statement:
    parts = (*attachments(d), ("steps", "SELECT *, lag(number) OVER (PARTITION BY doc_id ORDER BY number) AS before FROM defined"))
    return Statement("SELECT doc_id, block_index, before, number FROM steps WHERE number > before + 1", parts)


def attachment_missing(d: Dialect) -> Statement:
    """References to attachments that nothing defines, in documents that define any: an anti join."""
    parts = (*attachments(d), ("owners", "SELECT DISTINCT doc_id FROM defined"))
    return Statement(
        "SELECT DISTINCT a.doc_id, a.block_index, a.number FROM attachments a JOIN owners o ON a.doc_id = o.doc_id LEFT JOIN defined x ON a.doc_id = x.doc_id AND a.number = x.number WHERE NOT a.is_definition AND x.number IS NULL", parts
    )


def attachment_unused(d: Dialect) -> Statement:
    parts = (*attachments(d), ("used", "SELECT DISTINCT doc_id, number FROM attachments WHERE NOT is_definition"))
    return Statement("SELECT x.doc_id, x.block_index, x.number FROM defined x LEFT JOIN used u ON x.doc_id = u.doc_id AND x.number = u.number WHERE u.number IS NULL", parts)


def broken_sections(d: Dialect) -> Statement:
    """References to an article by number that no marker of the document has."""
    parts = (
        *markers(d),
        ("references_", d.explode("blocks", "doc_id, block_index", d.extract_all("text", r"(^|[^0-9.])([0-9]{1,3})[.] madde", 2), "core")),
        ("cores", "SELECT DISTINCT doc_id, core FROM markers"),
    )
    return Statement("SELECT DISTINCT r.doc_id, r.block_index, r.core FROM references_ r JOIN (SELECT DISTINCT doc_id FROM cores) o ON r.doc_id = o.doc_id LEFT JOIN cores c ON r.doc_id = c.doc_id AND r.core = c.core WHERE c.core IS NULL", parts)


#: Accented small letters and one byte each that lower-cased text doesn't use: edit distances count letters in any engine.
ACCENTS, BYTES = "çğıöşüâîûéèêëàáñóòíìßäúùœïôæ¿¡", "ABCDEFGHIJKLMNOPQRSTUVWXYZ^~{}"


def near_copies(d: Dialect) -> Statement:
    """Pairs of blocks of a document, twelve words or more, the first 400: lengths within 0.8, Jaccard of tokens 0.7,
    edit similarity 0.86, not equal. Cheap tests go first, the edit distance runs on what is left."""
    parts = (
        ("eligible", f"SELECT doc_id, block_index, translate({f.normalized(d, 'text')}, '{ACCENTS}', '{BYTES}') AS norm FROM blocks WHERE {f.words(d, 'text')} >= 12"),
        ("ranked", "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_index) AS rn FROM eligible"),
        ("candidates", f"SELECT doc_id, block_index, norm, CAST(length(norm) AS BIGINT) AS n, {d.distinct(f.tokens(d, 'norm'))} AS tokens FROM ranked WHERE rn <= 400"),
        ("pairs", "SELECT a.doc_id, a.block_index AS first_block, b.block_index AS second_block, a.norm AS x, b.norm AS y, a.n AS nx, b.n AS ny, a.tokens AS tx, b.tokens AS ty FROM candidates a JOIN candidates b ON a.doc_id = b.doc_id AND a.block_index < b.block_index"),
    )
    lengths = "10 * least(nx, ny) >= 8 * greatest(nx, ny) AND x <> y"
    shared = f"10 * {d.size(d.intersect('tx', 'ty'))} >= 7 * ({d.size('tx')} + {d.size('ty')} - {d.size(d.intersect('tx', 'ty'))})"
    edits = "100 * (greatest(nx, ny) - levenshtein(x, y)) >= 86 * greatest(nx, ny)"
    # one condition: separate ones are merged into the join in an order that may put the dear test first
    return Statement(f"SELECT doc_id, first_block, second_block, CAST(levenshtein(x, y) AS BIGINT) AS edits FROM pairs WHERE CASE WHEN {lengths} THEN CASE WHEN {shared} THEN {edits} ELSE false END ELSE false END", parts)


STATEMENTS = {
    "m05_markers": lambda d: Statement("SELECT * FROM markers", markers(d)),
    "r04_near_copies": near_copies,
    "r20_sequences": sequences,
    "r21_readings": lambda d: Statement("SELECT doc_id, shape, CAST(roman AS BIGINT) AS roman, CAST(turkish AS BIGINT) AS turkish, depth FROM depths", markers(d)),
    "r22_orphans": orphans,
    "r23_empty_sections": empty_sections,
    "r24_attachment_gaps": attachment_gaps,
    "r25_attachment_missing": attachment_missing,
    "r26_attachment_unused": attachment_unused,
    "r27_attachments": lambda d: Statement("SELECT * FROM attachments", attachments(d)),
    "r28_broken_sections": broken_sections,
}
