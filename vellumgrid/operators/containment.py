"""Shapes over positioned items, zones, projects and object graphs: range joins, groupings by distance, inherited values."""

from __future__ import annotations

from vellumgrid.operators.relational import EDGES, STYLES, WARNINGS, numbered, outputs, pages, sides, spans
from vellumgrid.plans.dialect import Dialect, Statement

#: Glyph items of a page: page, x, y, width (tenths of a point), text.
ITEMS = [(1, 100, 7000, 300, "Birinci"), (1, 420, 7004, 200, "satır"), (1, 100, 6850, 500, "ikinci satır"), (1, 100, 6700, 300, "üçüncü"), (1, 410, 6692, 100, "son"), (1, 100, 500, 200, "Sayfa 1"), (2, 100, 7000, 400, "yeni sayfa"), (2, 100, 6850, 300, "devam"), (2, 100, 500, 200, "Sayfa 1"), (3, 100, 6990, 400, "üçüncü sayfa"), (3, 100, 500, 200, "Sayfa 1")]
#: Objects of a file: id, parent, own width, own rotation.
OBJECTS = [(1, None, 595, None), (2, 1, None, 90), (3, 2, None, None), (4, 2, 612, None), (5, None, None, None)]
SOURCES = [(10, "a.pdf", 6), (11, "b.pdf", 3), (12, "c.pdf", 9), (13, "d.pdf", 2)]
PROJECT = [(1, 10, 0, 5), (2, 11, 0, 2), (3, 12, 0, 8), (4, 99, 0, 1), (5, 10, 4, 7)]
SIZES = [(1, 1000, 960, "lossless"), (2, 900000, 700000, "balanced"), (3, 5000, 4990, "strong"), (4, 200000, 195000, "balanced")]


def items(d: Dialect):
    return d.values("items", "page BIGINT, x BIGINT, y BIGINT, width BIGINT, text string", ITEMS)


def lines(d: Dialect):
    """Items whose heights lie within 1.5 points of the one before, from top to bottom, make a line, read by x."""
    return (
        items(d),
        ("stepped", "SELECT *, CASE WHEN coalesce(lag(y) OVER (PARTITION BY page ORDER BY y DESC, x) - y, 99999) > 15 THEN 1 ELSE 0 END AS fresh FROM items"),
        ("lined", "SELECT *, CAST(sum(fresh) OVER (PARTITION BY page ORDER BY y DESC, x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS line FROM stepped"),
        ("lines", f"SELECT page, line, {d.collect('text', 'x', ' ')} AS text, max(y) AS y, min(x) AS x, max(x + width) AS right_ FROM lined GROUP BY page, line"),
    )


def sources(d: Dialect):
    return d.values("sources", "source_id BIGINT, name string, n BIGINT", SOURCES), d.values("project", "exhibit_id BIGINT, source_id BIGINT, lo BIGINT, hi BIGINT", PROJECT)


def warnings(d: Dialect):
    return d.values("warnings", "doc_id BIGINT, code string, detail string, place BIGINT", WARNINGS)


def sizes(d: Dialect):
    return d.values("sizes", "id BIGINT, before BIGINT, after BIGINT, preset string", SIZES)


#: A paragraph ends with an end mark, a short line or a wide gap.
FILL = 0.6

STATEMENTS = {
    "s15_archive_budget": lambda d: Statement("SELECT package, count(*) AS entries, CAST(sum(size) AS BIGINT) AS total, (sum(size) <= 536870912 AND max(size) <= 134217728 AND bool_and(size <= 200 * packed) AND bool_and(name NOT LIKE '/%' AND name NOT LIKE '%..%')) AS fits FROM entries GROUP BY package", (d.values("entries", "package BIGINT, name string, size BIGINT, packed BIGINT", [(1, "word/document.xml", 90000, 9000), (1, "a.png", 5000, 5000), (2, "bomb.xml", 90000000, 1000), (3, "../x", 10, 10), (4, "big", 200000000, 190000000)]),)),
    "s19_text_lines": lambda d: Statement("SELECT page, line, text, y, x, right_ FROM lines", lines(d)),
    "s20_margin_lines": lambda d: Statement("SELECT text, count(DISTINCT page) AS pages FROM lines GROUP BY text HAVING count(DISTINCT page) >= 2 AND 10 * count(DISTINCT page) >= 6 * (SELECT count(DISTINCT page) FROM items)", lines(d)),
    "s23_visible_labels": lambda d: Statement("SELECT exhibit_id, page, CAST(row_number() OVER (PARTITION BY exhibit_id, part ORDER BY page) AS BIGINT) AS label FROM (SELECT *, CASE WHEN page <= 3 THEN 1 ELSE 2 END AS part FROM numbered) x", numbered(d)),
    "s25_page_inspection": lambda d: Statement("SELECT exhibit_id, count(*) AS pages, min(width) AS least_width, max(height) AS most_height, CAST(" + d.count_if("rotation % 180 = 90") + " AS BIGINT) AS turned FROM exhibit_pages GROUP BY exhibit_id", (pages(d),)),
    "s30_project_issues": lambda d: Statement("SELECT p.exhibit_id, p.source_id, CASE WHEN s.source_id IS NULL THEN 'unknown source' WHEN p.hi >= s.n THEN 'out of range' END AS issue FROM project p LEFT JOIN sources s ON p.source_id = s.source_id WHERE s.source_id IS NULL OR p.hi >= s.n", sources(d)),
    "k11_batch_outcome": lambda d: Statement("SELECT code, count(DISTINCT doc_id) AS files, bool_and(code <> 'W3') AS complete FROM warnings GROUP BY code", (warnings(d),)),
    "j09_interval_containment": lambda d: Statement(
        "SELECT f.doc_id, f.place, z.place AS zone FROM (SELECT doc_id, place, start_ + 2 AS offset_ FROM spans) f JOIN spans z ON f.doc_id = z.doc_id AND z.start_ <= f.offset_ AND f.offset_ < z.start_ + z.len_", spans(d)
    ),
    "j10_source_lookup": lambda d: Statement("SELECT p.exhibit_id, p.source_id, s.name FROM project p LEFT JOIN sources s ON p.source_id = s.source_id", sources(d)),
    "j11_unassigned_sources": lambda d: Statement("SELECT s.source_id, s.name FROM sources s LEFT JOIN project p ON s.source_id = p.source_id WHERE p.source_id IS NULL", sources(d)),
    "w06_ordinal_shift": lambda d: Statement("SELECT pair_id, place, other, other - place AS shift, other - place = coalesce(lag(other - place) OVER (PARTITION BY pair_id ORDER BY place), 0) AS expected FROM (SELECT b.pair_id, b.place, min(r.place) AS other FROM base b JOIN revised r ON b.pair_id = r.pair_id AND b.text = r.text GROUP BY b.pair_id, b.place) x", sides(d)),
    "d01_compare_blocks": lambda d: Statement(f"SELECT pair_id, place, trim({d.replace('text', '[ \t]+', ' ')}) AS text, CASE WHEN {d.like('text', '^Madde [0-9]+')} THEN 'heading' ELSE 'paragraph' END AS kind FROM base WHERE trim(text) <> ''", sides(d)),
    "d11_local_relocation": lambda d: Statement("SELECT pair_id, place, other FROM (SELECT b.pair_id, b.place, r.place AS other, count(*) OVER (PARTITION BY b.pair_id, b.text) AS n FROM base b JOIN revised r ON b.pair_id = r.pair_id AND b.text = r.text AND b.place <> r.place AND abs(b.place - r.place) <= 4) x WHERE n = 1", sides(d)),
    "d_verify_digests": lambda d: Statement(f"SELECT b.pair_id, b.place, {d.sha256('b.text')} = {d.sha256('r.text')} AS same FROM base b JOIN revised r ON b.pair_id = r.pair_id AND b.place = r.place", sides(d)),
    "x04_node_table": lambda d: Statement(f"SELECT page, line, x, concat(CAST(page AS {d.kind('string')}), '.', CAST(line AS {d.kind('string')})) AS parent, text FROM lined", lines(d)),
    "e05_compression_choice": lambda d: Statement("SELECT id, preset, before - after AS saved, (100 * (before - after) >= 3 * before OR (100 * (before - after) >= 2 * before AND before - after >= 102400) OR before - after >= 512000) AS worthwhile FROM sizes", (sizes(d),)),
    "e07_page_numbers": lambda d: Statement(f"SELECT exhibit_id, page, concat(CAST(page AS {d.kind('string')}), ' / ', CAST(count(*) OVER (PARTITION BY exhibit_id) AS {d.kind('string')})) AS label FROM numbered", numbered(d)),
    "e12_validation": lambda d: Statement("SELECT exhibit_id, bool_and(width > 0 AND height > 0) AS boxes, bool_and(rotation IN (0, 90, 180, 270)) AS rotations, count(DISTINCT source_page) = count(*) AS unique_pages FROM exhibit_pages GROUP BY exhibit_id", (pages(d),)),
    "e19_relinked_sources": lambda d: Statement("SELECT s.source_id, coalesce(r.name, s.name) AS name FROM sources s LEFT JOIN relinked r ON s.source_id = r.source_id", (*sources(d), d.values("relinked", "source_id BIGINT, name string", [(11, "moved/b.pdf")]))),
    "g04_attribute_resolution": lambda d: Statement("SELECT s.name, coalesce(s.size, p.size, q.size, 10) AS size FROM styles s LEFT JOIN styles p ON s.parent = p.name AND p.name <> s.name LEFT JOIN styles q ON p.parent = q.name AND q.name <> s.name", (d.values("styles", "name string, parent string, font string, size BIGINT", STYLES),)),
    "g12_inherited_pages": lambda d: Statement("SELECT o.id, coalesce(o.width, p.width, q.width) AS width, coalesce(o.rotation, p.rotation, q.rotation, 0) AS rotation FROM objects o LEFT JOIN objects p ON o.parent = p.id LEFT JOIN objects q ON p.parent = q.id", (d.values("objects", "id BIGINT, parent BIGINT, width BIGINT, rotation BIGINT", OBJECTS),)),
    "g14_graph_steps": lambda d: Statement("SELECT a.a AS root, count(DISTINCT b.b) AS second FROM edges a JOIN edges b ON a.b = b.a GROUP BY a.a", (d.values("edges", "a BIGINT, b BIGINT", EDGES),)),
    "k08_manifest": lambda d: Statement("SELECT exhibit_id, count(*) AS outputs, CAST(sum(bytes) AS BIGINT) AS bytes, max(page) AS last_page FROM written GROUP BY exhibit_id", (outputs(d),)),
}
