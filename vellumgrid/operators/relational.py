"""Joins, aggregations, windows, top-k and set operations of the audit and page model, over the corpus or small fixtures."""

from __future__ import annotations

from vellumgrid.functions import text as f
from vellumgrid.operators import audit
from vellumgrid.plans.dialect import Dialect, Statement

#: Two versions of documents: pair, side, place, text.
PAIRS = [
    (1, "base", 0, "Bu sözleşme taraflar arasında imzalandığı gün yürürlüğe girer."), (1, "base", 1, "Taraflar edimlerini zamanında ve eksiksiz olarak yerine getirir."), (1, "base", 2, "Kira bedeli her ayın beşinci gününe kadar ödenir."), (1, "base", 3, "Uyuşmazlık hâlinde İstanbul mahkemeleri yetkilidir."),
    (1, "revised", 0, "Bu sözleşme taraflar arasında imzalandığı gün yürürlüğe girer."), (1, "revised", 1, "Kira bedeli her ayın onuncu gününe kadar nakden ödenir."), (1, "revised", 2, "Taraflar edimlerini zamanında ve eksiksiz olarak yerine getirir."), (1, "revised", 3, "Uyuşmazlık hâlinde İstanbul mahkemeleri yetkilidir."), (1, "revised", 4, "Ek hüküm olarak depozito iade edilir."),
    (2, "base", 0, "Madde 1 Kapsam ve tanımlar bu belgede yer alır."), (2, "base", 1, "Madde 2 Süre bir yıldır ve kendiliğinden uzar."), (2, "base", 2, "Kısa."),
    (2, "revised", 0, "Madde 1 Kapsam ve tanımlar bu belgede yer alır."), (2, "revised", 1, "Madde 3 Süre bir yıldır ve kendiliğinden uzar."), (2, "revised", 2, "Kısa."),
    (3, "base", 0, "Aynı metin iki kez burada geçmektedir."), (3, "base", 1, "Aynı metin iki kez burada geçmektedir."), (3, "revised", 0, "Aynı metin iki kez burada geçmektedir."),
]
#: Pages of exhibits: exhibit, its order, source, page of the source, bytes, rotation, width, height.
PAGES = [(e, o, s, p, 1000 + 700 * ((e * 7 + p * 3) % 5), 90 * ((e + p) % 4), 595 + (e % 2) * 17, 842 - (e % 2) * 50) for e, o, s, n in ((1, 1, 10, 6), (2, 2, 11, 3), (3, 3, 12, 9), (4, 4, 10, 1)) for p in range(n)]
#: What was really written: exhibit, page of it, bytes.
OUTPUTS = [(e, p, 1000 + p) for e, n in ((1, 5), (2, 3), (3, 10)) for p in range(n)] + [(2, 1, 7)]
#: Runs of formatted text: document, block, run, text, font, size, bold, heading level (0: body), numbered.
RUNS = [(1, b, r, "x" * (3 + (b * r) % 7), "Times" if (b + r) % 9 else "Arial", 12.0 if b % 6 else 11.0, b % 4 == 0, 1 if b % 4 == 0 else 0, b % 8 == 0) for b in range(24) for r in range(1, 4)] + [(2, b, 1, "metin gövdesi", "Times", 12.0 + (b == 3), False, 0, False) for b in range(6)]
#: Spans of a text buffer: document, place, start, length.
SPANS = [(1, 0, 0, 5), (1, 1, 5, 7), (1, 2, 12, 1), (2, 0, 0, 4), (2, 1, 3, 6), (2, 2, 10, 2), (3, 0, 1, 4), (3, 1, 5, 5)]
SPAN_SIZES = [(1, 13), (2, 12), (3, 10)]
STYLES = [("body", None, "Times", 12), ("quote", "body", None, 11), ("block", "quote", None, None), ("title", None, None, 16), ("loop_a", "loop_b", None, None), ("loop_b", "loop_a", "Mono", None)]
WARNINGS = [(1, "W1", "font", 3), (1, "W1", "font", 9), (1, "W2", "image", 2), (2, "W1", "font", 1), (2, "W3", "table", None)]
EDGES = [(1, 2), (2, 3), (3, 1), (4, 5), (6, 7)]


def pairs(d: Dialect):
    return d.values("pairs", "pair_id BIGINT, side string, place BIGINT, text string", PAIRS)


def sides(d: Dialect):
    return pairs(d), ("base", "SELECT pair_id, place, text FROM pairs WHERE side = 'base'"), ("revised", "SELECT pair_id, place, text FROM pairs WHERE side = 'revised'")


def pages(d: Dialect):
    return d.values("exhibit_pages", "exhibit_id BIGINT, ord BIGINT, source_id BIGINT, source_page BIGINT, bytes BIGINT, rotation BIGINT, width BIGINT, height BIGINT", PAGES)


def numbered(d: Dialect):
    return pages(d), ("numbered", "SELECT *, CAST(row_number() OVER (PARTITION BY exhibit_id ORDER BY source_page) AS BIGINT) AS page FROM exhibit_pages")


def outputs(d: Dialect):
    return d.values("written", "exhibit_id BIGINT, page BIGINT, bytes BIGINT", OUTPUTS)


def runs(d: Dialect):
    return d.values("runs", "doc_id BIGINT, block_index BIGINT, run BIGINT, text string, font string, size DOUBLE, bold BOOLEAN, level BIGINT, numbered BOOLEAN", RUNS)


def spans(d: Dialect):
    return d.values("spans", "doc_id BIGINT, place BIGINT, start_ BIGINT, len_ BIGINT", SPANS), d.values("buffers", "doc_id BIGINT, total BIGINT", SPAN_SIZES)


def weighted_fonts(d: Dialect):
    """Font of a block by the length of its runs; ties to the first by name."""
    return (
        runs(d),
        ("weights", "SELECT doc_id, block_index, font, sum(CAST(length(text) AS BIGINT)) AS weight, max(CASE WHEN bold THEN 1 ELSE 0 END) AS bold, min(level) AS level, min(size) AS size FROM runs GROUP BY doc_id, block_index, font"),
        ("ordered", "SELECT *, row_number() OVER (PARTITION BY doc_id, block_index ORDER BY weight DESC, font) AS rn FROM weights"),
        ("dominant", "SELECT doc_id, block_index, font, bold, level, size FROM ordered WHERE rn = 1"),
    )


def mode(d: Dialect, level: str, least: int):
    """Value that 0.7 of a group of `least` blocks or more share."""
    return (
        ("counted", f"SELECT doc_id, font, count(*) AS n, min(block_index) AS first_block FROM dominant WHERE {level} GROUP BY doc_id, font"),
        ("shares", "SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_block) AS rn FROM counted"),
        ("modes", f"SELECT doc_id, font, n, CAST(total AS BIGINT) AS total FROM shares WHERE rn = 1 AND total >= {least} AND 10 * n >= 7 * total"),
    )


def style_outliers(d: Dialect, level: str, least: int) -> Statement:
    return Statement(f"SELECT b.doc_id, b.block_index, b.font, m.font AS expected FROM dominant b JOIN modes m ON b.doc_id = m.doc_id WHERE {level} AND b.font <> m.font", (*weighted_fonts(d), *mode(d, level, least)))


def ranges(d: Dialect) -> Statement:
    """1,2,3,7 as 1-3, 7: neighbours have one difference between number and rank."""
    parts = (
        d.values("kept", "id BIGINT, page BIGINT", [(1, p) for p in (1, 2, 3, 7, 9, 10, 15)] + [(2, p) for p in (4, 5, 6)]),
        ("islands", "SELECT id, page, page - row_number() OVER (PARTITION BY id ORDER BY page) AS island FROM kept"),
        ("spans_", "SELECT id, min(page) AS lo, max(page) AS hi FROM islands GROUP BY id, island"),
    )
    k = d.kind("string")
    text = f"CASE WHEN lo = hi THEN CAST(lo AS {k}) ELSE concat(CAST(lo AS {k}), '-', CAST(hi AS {k})) END"
    return Statement(f"SELECT id, {d.collect(text, 'lo', ', ')} AS ranges FROM spans_ GROUP BY id", parts)


def page_expression(d: Dialect) -> Statement:
    """2-4, 7 as pages."""
    parts = (
        d.values("asked", "id BIGINT, x string", [(1, "2-4, 7"), (2, "1"), (3, "5-5,9-10"), (4, "x, 3")]),
        ("items", d.explode("asked", "id", d.split("replace(x, ' ', '')", ","), "item")),
        ("bounds", f"SELECT id, item, CAST({d.extract('item', '^([0-9]+)', 1)} AS BIGINT) AS lo, CAST({d.extract('item', '([0-9]+)$', 1)} AS BIGINT) AS hi FROM items WHERE {d.like('item', '^[0-9]+(-[0-9]+)?$')}"),
    )
    return Statement(d.explode("bounds", "id, item", d.between("lo", "hi"), "page"), parts)


def count_words(d: Dialect):
    return ("sized", f"SELECT doc_id, block_index, text, {f.words(d, 'text')} AS words, CAST(length(text) AS BIGINT) AS chars FROM blocks")


def token_counts(d: Dialect):
    return (("toks", d.explode("blocks", "doc_id, block_index", f.tokens(d, f.normalized(d, "text")), "token")), ("bags", "SELECT doc_id, block_index, token, count(*) AS n FROM toks GROUP BY doc_id, block_index, token"))


def k(name: str, *parts_of):
    return name, parts_of


STATEMENTS = {
    # joins
    "j01_exact_anchors": lambda d: Statement("SELECT b.pair_id, b.place AS base_place, r.place AS revised_place FROM (SELECT pair_id, text, min(place) AS place FROM base WHERE length(text) >= 24 GROUP BY pair_id, text HAVING count(*) = 1) b JOIN (SELECT pair_id, text, min(place) AS place FROM revised GROUP BY pair_id, text HAVING count(*) = 1) r ON b.pair_id = r.pair_id AND b.text = r.text", sides(d)),
    "j02_article_titles": lambda d: Statement(
        "SELECT b.pair_id, b.number AS base_number, r.number AS revised_number, b.title FROM titled_base b JOIN titled_revised r ON b.pair_id = r.pair_id AND b.title = r.title WHERE b.number <> r.number",
        (*sides(d), *((f"titled_{s}", f"SELECT pair_id, {d.extract('text', '^Madde ([0-9]+)', 1)} AS number, {d.extract('text', '^Madde [0-9]+ (.*)$', 1)} AS title FROM {s} WHERE {d.like('text', '^Madde [0-9]+ ')}") for s in ("base", "revised"))),
    ),
    "j03_title_overlap": lambda d: Statement(
        f"SELECT b.pair_id, b.place AS base_place, r.place AS revised_place FROM base b JOIN revised r ON b.pair_id = r.pair_id AND 100 * {d.size(d.intersect(f.token_set(d, 'b.text'), f.token_set(d, 'r.text')))} >= 24 * {d.size(d.union(f.token_set(d, 'b.text'), f.token_set(d, 'r.text')))} AND 2 * {d.size(d.intersect(f.token_set(d, 'b.text'), f.token_set(d, 'r.text')))} >= least({d.size(f.token_set(d, 'b.text'))}, {d.size(f.token_set(d, 'r.text'))})",
        sides(d),
    ),
    "j04_bounded_distance": lambda d: Statement(
        "SELECT pair_id, base_place, revised_place FROM (SELECT *, count(*) OVER (PARTITION BY pair_id, base_place) AS nb, count(*) OVER (PARTITION BY pair_id, revised_place) AS nr FROM near) x WHERE nb = 1 AND nr = 1",
        (*sides(d), ("near", "SELECT b.pair_id, b.place AS base_place, r.place AS revised_place FROM base b JOIN revised r ON b.pair_id = r.pair_id AND b.text = r.text AND abs(b.place - r.place) <= 4")),
    ),
    "j07_semi_marked_folds": lambda d: Statement(
        f"SELECT DISTINCT t.doc_id, t.word FROM words_ t WHERE EXISTS (SELECT 1 FROM marked m WHERE m.doc_id = t.doc_id AND m.fold = t.fold)",
        (("toks", d.explode("blocks", "doc_id", f.tokens(d, "text"), "token")), ("words_", f"SELECT DISTINCT doc_id, {f.tr_lower(d, 'token')} AS word, {f.ascii_fold(d, 'token')} AS fold FROM toks WHERE length(token) >= 5"), ("marked", "SELECT DISTINCT doc_id, fold FROM words_ WHERE word <> fold")),
    ),
    "j08_dictionary_lookup": lambda d: Statement(
        "SELECT t.doc_id, c.wrong, c.right_, count(*) AS n FROM words_ t JOIN corrections c ON t.word = c.wrong GROUP BY t.doc_id, c.wrong, c.right_",
        (d.values("corrections", "wrong string, right_ string", [("the", "The"), ("karari", "kararı"), ("und", "and")]), ("toks", d.explode("blocks", "doc_id", f.tokens(d, "text"), "token")), ("words_", f"SELECT doc_id, {f.tr_lower(d, 'token')} AS word FROM toks")),
    ),
    "j12_planned_and_written": lambda d: Statement(
        "SELECT coalesce(n.exhibit_id, w.exhibit_id) AS exhibit_id, coalesce(n.page, w.page) AS page, CASE WHEN n.page IS NULL THEN 'extra' WHEN w.page IS NULL THEN 'missing' ELSE 'differs' END AS state FROM numbered n FULL OUTER JOIN (SELECT exhibit_id, page + 1 AS page, min(bytes) AS bytes FROM written GROUP BY exhibit_id, page) w ON n.exhibit_id = w.exhibit_id AND n.page = w.page WHERE n.page IS NULL OR w.page IS NULL OR n.bytes <> w.bytes",
        (*numbered(d), outputs(d)),
    ),
    "j13_lost_text": lambda d: Statement("SELECT b.pair_id, b.place FROM base b LEFT JOIN revised r ON b.pair_id = r.pair_id AND b.text = r.text WHERE r.text IS NULL", sides(d)),
    # aggregations
    "a01_document_counts": lambda d: Statement("SELECT doc_id, count(*) AS blocks, CAST(sum(words) AS BIGINT) AS words, CAST(sum(chars) AS BIGINT) AS chars FROM sized GROUP BY doc_id", (count_words(d),)),
    "a04_dominant_value": lambda d: Statement("SELECT * FROM modes", (*weighted_fonts(d), *mode(d, "level = 0", 4))),
    "a05_weighted_mode": lambda d: Statement("SELECT doc_id, block_index, font FROM dominant", weighted_fonts(d)),
    "a06_distinct_per_document": lambda d: Statement("SELECT doc_id, count(DISTINCT kind) AS kinds FROM kinds GROUP BY doc_id HAVING count(DISTINCT kind) > 1", (("kinds", f"SELECT doc_id, CASE WHEN {d.like('text', '^ *[0-9]')} THEN 'n' WHEN trim(text) = '' THEN 'b' ELSE 't' END AS kind FROM blocks"),)),
    "a07_first_hit": lambda d: Statement(f"SELECT doc_id, min(block_index) AS block_index, {d.min_by('words', 'block_index')} AS words FROM sized WHERE words >= 12 GROUP BY doc_id", (count_words(d),)),
    "a08_surface_sites": lambda d: Statement("SELECT doc_id, fold, count(*) AS forms, min(first_block) AS first_block FROM (SELECT doc_id, fold, word, min(block_index) AS first_block FROM spelt GROUP BY doc_id, fold, word) x GROUP BY doc_id, fold HAVING count(*) > 1", (("toks", d.explode("blocks", "doc_id, block_index", f.tokens(d, "text"), "token")), ("spelt", f"SELECT doc_id, block_index, token AS word, {f.ascii_fold(d, 'token')} AS fold FROM toks WHERE length(token) >= 7"))),
    "a09_bold_share": lambda d: Statement("SELECT doc_id, CAST(sum(CASE WHEN bold THEN 1 ELSE 0 END) AS BIGINT) AS bold, count(*) AS runs, avg(CASE WHEN bold THEN 1.0E0 ELSE 0.0E0 END) AS share FROM runs GROUP BY doc_id", (runs(d),)),
    "a10_change_summary": lambda d: Statement("SELECT pair_id, state, count(*) AS n FROM (SELECT coalesce(b.pair_id, r.pair_id) AS pair_id, CASE WHEN b.text IS NULL THEN 'added' WHEN r.text IS NULL THEN 'removed' WHEN b.place <> r.place THEN 'moved' ELSE 'equal' END AS state FROM base b FULL OUTER JOIN revised r ON b.pair_id = r.pair_id AND b.text = r.text) x GROUP BY pair_id, state", sides(d)),
    "a11_coalesced_warnings": lambda d: Statement("SELECT code, detail, count(*) AS n, CASE WHEN count(*) = 1 THEN min(place) END AS place FROM warnings GROUP BY code, detail", (d.values("warnings", "doc_id BIGINT, code string, detail string, place BIGINT", WARNINGS),)),
    "a12_batch_status": lambda d: Statement("SELECT doc_id, max(CASE code WHEN 'W3' THEN 2 WHEN 'W2' THEN 1 ELSE 0 END) AS worst, count(*) AS n FROM warnings GROUP BY doc_id", (d.values("warnings", "doc_id BIGINT, code string, detail string, place BIGINT", WARNINGS),)),
    "a13_page_accounting": lambda d: Statement(
        "SELECT n.exhibit_id, count(*) AS planned, CAST(sum(CASE WHEN w.n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN w.n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated FROM numbered n LEFT JOIN (SELECT exhibit_id, page + 1 AS page, count(*) AS n FROM written GROUP BY exhibit_id, page) w ON n.exhibit_id = w.exhibit_id AND n.page = w.page GROUP BY n.exhibit_id",
        (*numbered(d), outputs(d)),
    ),
    "a14_exhibit_totals": lambda d: Statement("SELECT exhibit_id, count(*) AS pages, CAST(sum(bytes) AS BIGINT) AS bytes FROM exhibit_pages GROUP BY exhibit_id", (pages(d),)),
    "a15_repeated_lines": lambda d: Statement("SELECT l.doc_id, l.norm, l.n FROM lines l JOIN totals t ON l.doc_id = t.doc_id WHERE l.n >= 2 AND 10 * l.n >= t.blocks", (("lines", f"SELECT doc_id, {f.normalized(d, 'text')} AS norm, count(DISTINCT block_index) AS n FROM blocks WHERE trim(text) <> '' GROUP BY doc_id, {f.normalized(d, 'text')}"), ("totals", "SELECT doc_id, count(*) AS blocks FROM blocks GROUP BY doc_id"))),
    "a16_dominant_pitch": lambda d: Statement("SELECT doc_id, pitch, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pitch) AS rn FROM (SELECT doc_id, CAST(length(text) AS BIGINT) AS pitch, count(*) AS n FROM blocks GROUP BY doc_id, length(text)) g) x WHERE rn = 1"),
    "a17_multiset_overlap": lambda d: Statement("SELECT a.doc_id, a.block_index, CAST(sum(least(a.n, b.n)) AS BIGINT) AS shared FROM bags a JOIN bags b ON a.doc_id = b.doc_id AND b.block_index = a.block_index + 1 AND a.token = b.token GROUP BY a.doc_id, a.block_index", token_counts(d)),
    "a18_text_statistics": lambda d: Statement("SELECT doc_id, kind, count(*) AS n FROM kinds GROUP BY doc_id, kind", (("kinds", f"SELECT doc_id, CASE WHEN trim(text) = '' THEN 'blank' WHEN {d.like('text', ' [|] ')} THEN 'table' ELSE 'paragraph' END AS kind FROM blocks"),)),
    # windows
    "w01_adjacent_pairs": lambda d: Statement("SELECT doc_id, block_index, lead(words) OVER (PARTITION BY doc_id ORDER BY block_index) - words AS change FROM sized", (count_words(d),)),
    "w02_last_by_depth": lambda d: Statement("SELECT doc_id, block_index, max(CASE WHEN words >= 12 THEN block_index END) OVER (PARTITION BY doc_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_long FROM sized", (count_words(d),)),
    "w03_first_appearance": lambda d: Statement("SELECT doc_id, words, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY first_block) AS BIGINT) AS rank FROM (SELECT doc_id, words, min(block_index) AS first_block FROM sized GROUP BY doc_id, words) x", (count_words(d),)),
    "w04_carried_context": lambda d: Statement("SELECT doc_id, block_index, max(CASE WHEN words <= 6 THEN block_index END) OVER (PARTITION BY doc_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM sized", (count_words(d),)),
    "w05_running_offset": lambda d: Statement("SELECT doc_id, block_index, CAST(coalesce(sum(chars + 1) OVER (PARTITION BY doc_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM sized", (count_words(d),)),
    "w07_page_ordinals": lambda d: Statement("SELECT exhibit_id, source_page, page FROM numbered", numbered(d)),
    "w08_recent_cap": lambda d: Statement("SELECT doc_id, block_index FROM (SELECT doc_id, block_index, row_number() OVER (PARTITION BY doc_id ORDER BY block_index DESC) AS rn FROM blocks) x WHERE rn <= 5"),
    "t03_top_hunks": lambda d: Statement("SELECT doc_id, block_index, score FROM (SELECT doc_id, block_index, 3 * words + chars AS score, row_number() OVER (PARTITION BY doc_id ORDER BY 3 * words + chars DESC, block_index) AS rn FROM sized) x WHERE rn <= 3", (count_words(d),)),
    "t04_first_candidates": lambda d: Statement("SELECT doc_id, block_index FROM (SELECT doc_id, block_index, row_number() OVER (PARTITION BY doc_id ORDER BY block_index) AS rn FROM sized WHERE words >= 12) x WHERE rn <= 400", (count_words(d),)),
    "t05_stable_move": lambda d: Statement("SELECT exhibit_id, page, CAST(row_number() OVER (PARTITION BY exhibit_id ORDER BY CASE WHEN page IN (2, 4) THEN 0 ELSE 1 END, page) AS BIGINT) AS new_page FROM numbered", numbered(d)),
    # sets
    "u03_token_sets": lambda d: Statement(f"SELECT doc_id, block_index, {d.size(d.intersect(f.token_set(d, 'text'), d.array(d.lit('the'), d.lit('and'), d.lit('de'), d.lit('ve'))))} AS common, {d.size(d.union(f.token_set(d, 'text'), d.array(d.lit('the'))))} AS joined FROM blocks"),
    "u04_uncovered_pages": lambda d: Statement("SELECT exhibit_id, page FROM numbered EXCEPT SELECT exhibit_id, page + 1 AS page FROM written", (*numbered(d), outputs(d))),
    "u05_union_first_wins": lambda d: Statement("SELECT path, origin FROM (SELECT path, origin, row_number() OVER (PARTITION BY path ORDER BY origin) AS rn FROM (SELECT concat('/s', CAST(source_id AS " + d.kind("string") + ")) AS path, 1 AS origin FROM exhibit_pages UNION ALL SELECT concat('/s', CAST(exhibit_id + 9 AS " + d.kind("string") + ")), 2 FROM exhibit_pages) x) y WHERE rn = 1", (pages(d),)),
    "u06_interval_compaction": ranges,
    # similarity of neighbours
    "p09_jaccard": lambda d: Statement(f"SELECT doc_id, block_index, {d.size(d.intersect('x', 'y'))} AS shared, {d.size(d.union('x', 'y'))} AS joined FROM next_", (("toks", f"SELECT doc_id, block_index, {f.token_set(d, 'text')} AS x FROM blocks"), ("next_", "SELECT a.doc_id, a.block_index, a.x, b.x AS y FROM toks a JOIN toks b ON a.doc_id = b.doc_id AND b.block_index = a.block_index + 1"))),
    "p10_edit_similarity": lambda d: Statement("SELECT b.pair_id, b.place, r.place AS other, " + f.edit_similarity(d, "b.x", "r.x") + " AS similarity FROM fb b JOIN fr r ON b.pair_id = r.pair_id", (*sides(d), *((f"f{s[0]}", f"SELECT pair_id, place, {f.ascii_fold(d, 'text')} AS x FROM {s}") for s in ("base", "revised")))),
    "p11_levenshtein": lambda d: Statement("SELECT b.pair_id, b.place, r.place AS other, CAST(levenshtein(b.x, r.x) AS BIGINT) AS edits FROM fb b JOIN fr r ON b.pair_id = r.pair_id", (*sides(d), *((f"f{s[0]}", f"SELECT pair_id, place, {f.ascii_fold(d, 'text')} AS x FROM {s}") for s in ("base", "revised")))),
    "p16_plain_text": lambda d: Statement(f"SELECT pair_id, {d.collect('text', 'place', chr(10))} AS text FROM base GROUP BY pair_id", sides(d)),
    # blocks, zones
    "s06_blocks": lambda d: Statement("SELECT doc_id, block_index, text FROM blocks"),
    "s10_finalized_blocks": lambda d: Statement(f"SELECT doc_id, block_index, concat('p', CAST(block_index AS {d.kind('string')})) AS block_id, {f.normalized(d, 'text')} AS normalized, words FROM sized", (count_words(d),)),
    "s11_run_offsets": lambda d: Statement("SELECT doc_id, block_index, run, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id, block_index ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM runs", (runs(d),)),
    "x01_quote_zones": lambda d: Statement("SELECT doc_id, block_index, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS BIGINT) AS opens_inside FROM (SELECT doc_id, block_index, " + d.count("text", '"') + " AS n FROM blocks) q"),
    "x02_profiles": lambda d: Statement("SELECT doc_id, level, count(*) AS blocks, min(size) AS least_size, max(size) AS most_size, CAST(sum(bold) AS BIGINT) AS bold FROM dominant GROUP BY doc_id, level", weighted_fonts(d)),
    "x03_petition_spacing": lambda d: Statement("SELECT doc_id, block_index, size, size * 1.5E0 AS line FROM dominant WHERE level = 0", weighted_fonts(d)),
    "x03a_column_edges": lambda d: Statement("SELECT exhibit_id, page, CAST(sum(width) OVER (PARTITION BY exhibit_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS edge FROM numbered", numbered(d)),
    "x03b_typed_labels": lambda d: Statement(f"SELECT doc_id, block_index, {d.extract('text', r'^ *([^:]{1,40}):  +', 1)} AS label FROM blocks WHERE {d.like('text', r'^ *[^:]{1,40}:  +[^ ]')}"),
    # style rules
    "r29_heading_outliers": lambda d: style_outliers(d, "level = 1", 3),
    "r30_body_outliers": lambda d: style_outliers(d, "level = 0", 4),
    "r31_profile_deviation": lambda d: Statement("SELECT b.doc_id, b.block_index, b.size, p.size AS expected FROM dominant b JOIN profile p ON b.level = p.level WHERE abs(b.size - p.size) > 0.26 OR b.font <> p.font", (*weighted_fonts(d), d.values("profile", "level BIGINT, font string, size DOUBLE", [(0, "Times", 12.0), (1, "Times", 12.0)]))),
    # pages
    "e01_select_pages": lambda d: Statement("SELECT n.exhibit_id, a.new_page, n.source_page FROM numbered n JOIN asked a ON n.exhibit_id = a.exhibit_id AND n.page = a.page", (*numbered(d), d.values("asked", "exhibit_id BIGINT, page BIGINT, new_page BIGINT", [(1, 3, 1), (1, 1, 2), (3, 9, 1), (3, 10, 2)]))),
    "e02_rotate": lambda d: Statement("SELECT exhibit_id, page, (rotation + 270) % 360 AS rotation FROM numbered", numbered(d)),
    "e03_merge": lambda d: Statement("SELECT exhibit_id, page, CAST(row_number() OVER (ORDER BY ord, page) AS BIGINT) AS merged_page FROM numbered", numbered(d)),
    "e04_extract_range": lambda d: Statement("SELECT exhibit_id, page - 1 AS new_page, source_page FROM numbered WHERE page BETWEEN 2 AND 4", numbered(d)),
    "e06_crop": lambda d: Statement("SELECT exhibit_id, page, greatest(1, width - 72) AS width, greatest(1, height - 72) AS height FROM numbered", numbered(d)),
    "e08_stamp_labels": lambda d: Statement(f"SELECT exhibit_id, page, concat('Ek-', CAST(exhibit_id AS {d.kind('string')}), ' / p. ', CAST(page AS {d.kind('string')})) AS label FROM numbered", numbered(d)),
    "e15_plan_fingerprint": lambda d: Statement(f"SELECT {d.sha256(d.collect(f"concat(CAST(exhibit_id AS {d.kind('string')}), ':', CAST(page AS {d.kind('string')}), ':', CAST(bytes AS {d.kind('string')}))", 'exhibit_id * 1000 + page', ';'))} AS fingerprint FROM numbered", numbered(d)),
    "e16_split_exhibit": lambda d: Statement("SELECT exhibit_id, CASE WHEN page <= 4 THEN 1 ELSE 2 END AS part, CASE WHEN page <= 4 THEN page ELSE page - 4 END AS page FROM numbered WHERE exhibit_id = 3", numbered(d)),
    "e17_page_ranges": page_expression,
    "e18_distribute": lambda d: Statement("SELECT s.source_id, CAST(row_number() OVER (ORDER BY s.source_id) AS BIGINT) AS exhibit FROM (SELECT DISTINCT exhibit_id + 20 AS source_id FROM exhibit_pages) s LEFT JOIN (SELECT DISTINCT source_id FROM exhibit_pages) a ON s.source_id = a.source_id WHERE a.source_id IS NULL", (pages(d),)),
    "e20_source_integrity": lambda d: Statement(f"SELECT pair_id, place, {d.sha256('text')} AS digest FROM base", sides(d)),
    "f13_project_structure": lambda d: Statement("SELECT exhibit_id, 'gap' AS problem FROM (SELECT exhibit_id, ord, lag(ord) OVER (ORDER BY ord) AS before FROM (SELECT DISTINCT exhibit_id, ord FROM exhibit_pages) x) y WHERE ord <> coalesce(before, 0) + 1", (pages(d),)),
    "f14_package_report": lambda d: Statement("SELECT exhibit_id, bool_and(bytes < 3500) AS sizes_fit, bool_and(rotation % 90 = 0) AS rotations_fit FROM exhibit_pages GROUP BY exhibit_id", (pages(d),)),
    "k09_exhibit_list": lambda d: Statement(f"SELECT {d.collect(f"concat(CAST(exhibit_id AS {d.kind('string')}), '. ', CAST(n AS {d.kind('string')}), ' p.')", 'exhibit_id', chr(10))} AS list_ FROM (SELECT exhibit_id, count(*) AS n FROM exhibit_pages GROUP BY exhibit_id) x", (pages(d),)),
    # converters
    "g01_contextual_spacing": lambda d: Statement("SELECT doc_id, block_index, coalesce(lead(font) OVER (PARTITION BY doc_id ORDER BY block_index) = font, false) AS drop_after FROM dominant", weighted_fonts(d)),
    "g02_style_inheritance": lambda d: Statement(
        "SELECT s.name, coalesce(s.font, p.font, q.font) AS font, coalesce(s.size, p.size, q.size) AS size FROM styles s LEFT JOIN styles p ON s.parent = p.name LEFT JOIN styles q ON p.parent = q.name", (d.values("styles", "name string, parent string, font string, size BIGINT", STYLES),)
    ),
    "g05_span_overlaps": lambda d: Statement("SELECT doc_id, place FROM (SELECT *, max(start_ + len_) OVER (PARTITION BY doc_id ORDER BY start_, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans) x WHERE start_ < before", spans(d)),
    "g06_visible_ink": lambda d: Statement(f"SELECT doc_id, CAST(sum(length({d.replace('text', r'[ \t\r\n]')})) AS BIGINT) AS ink FROM blocks GROUP BY doc_id"),
    "g08_grid_snap": lambda d: Statement("SELECT exhibit_id, page, CAST(floor((edge + 150) / 300) AS BIGINT) AS column_ FROM (SELECT exhibit_id, page, sum(width) OVER (PARTITION BY exhibit_id ORDER BY page) AS edge FROM numbered) x", numbered(d)),
    "g09_span_widths": lambda d: Statement("SELECT exhibit_id, CAST(sum(width) AS BIGINT) AS width FROM numbered WHERE page BETWEEN 1 AND 3 GROUP BY exhibit_id", numbered(d)),
    "g10_interval_tiling": lambda d: Statement(
        "SELECT b.doc_id, (coalesce(max(CASE WHEN s.start_ <> s.before THEN 1 ELSE 0 END), 0) = 0 AND sum(s.len_) = max(b.total)) AS tiles FROM buffers b JOIN (SELECT *, coalesce(lag(start_ + len_) OVER (PARTITION BY doc_id ORDER BY place), 0) AS before FROM spans) s ON b.doc_id = s.doc_id GROUP BY b.doc_id", spans(d)
    ),
    "g13_dangling_references": lambda d: Statement("SELECT e.a, e.b FROM edges e LEFT JOIN (SELECT DISTINCT a FROM edges) n ON e.b = n.a WHERE n.a IS NULL", (d.values("edges", "a BIGINT, b BIGINT", EDGES),)),
    # document and dictionary counts
    "m11_percentages": lambda d: Statement(
        "SELECT doc_id, kind, CASE WHEN rn <= 100 - floors THEN whole + 1 ELSE whole END AS percent FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rest DESC, kind) AS rn, sum(whole) OVER (PARTITION BY doc_id) AS floors FROM shares) x",
        (("kinds", f"SELECT doc_id, CASE WHEN trim(text) = '' THEN 'blank' WHEN {d.like('text', ' [|] ')} THEN 'table' ELSE 'paragraph' END AS kind FROM blocks"), ("counts", "SELECT doc_id, kind, count(*) AS n FROM kinds GROUP BY doc_id, kind"), ("totals", "SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM counts"), ("shares", "SELECT doc_id, kind, CAST(floor(100 * n / total) AS BIGINT) AS whole, (100 * n) % total AS rest FROM totals")),
    ),
    "f03_licensed_repeats": lambda d: Statement("SELECT t.doc_id, t.token, count(*) AS n FROM toks t LEFT JOIN stop_words s ON t.token = s.word WHERE s.word IS NULL AND length(t.token) > 2 GROUP BY t.doc_id, t.token HAVING count(*) > 5", (d.values("stop_words", "word string", [("the",), ("and",), ("les",), ("und",)]), ("toks", d.explode("blocks", "doc_id", f.tokens(d, f.normalized(d, "text")), "token")))),
    "f10_change_filter": lambda d: Statement("SELECT b.pair_id, b.place FROM base b LEFT JOIN revised r ON b.pair_id = r.pair_id AND b.place = r.place WHERE r.text IS NOT NULL AND r.text <> b.text", sides(d)),
    "f04_accepted_words": lambda d: Statement("SELECT doc_id, block_index, original FROM hits WHERE " + f.tr_lower(d, "original") + " NOT IN ('hiçbirşey', 'the')", (("hits", "SELECT * FROM (" + audit.separate_writing(d).text() + ") h"),)),
    "d_apply_overlaps": lambda d: Statement("SELECT doc_id, rule_id, block_index, char_start, char_end FROM (SELECT *, max(char_end) OVER (PARTITION BY doc_id, block_index ORDER BY char_start, char_end, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM findings WHERE replacement IS NOT NULL) x WHERE char_start < before", audit.all_findings(d, ("r01_word_duplication", "r05_double_punctuation", "r06_space_before_punctuation", "r08_multiple_spaces"))),
    "d_shift_offsets": lambda d: Statement("SELECT doc_id, block_index, char_start, CAST(char_start + coalesce(sum(length(replacement) - (char_end - char_start)) OVER (PARTITION BY doc_id, block_index ORDER BY char_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_start FROM findings", audit.all_findings(d, ("r08_multiple_spaces",))),
    "d19_grouped_changes": lambda d: Statement("SELECT pair_id, min(place) AS first_place, count(*) AS n FROM (SELECT b.pair_id, b.place, b.place - row_number() OVER (PARTITION BY b.pair_id ORDER BY b.place) AS island FROM base b LEFT JOIN revised r ON b.pair_id = r.pair_id AND b.text = r.text WHERE r.text IS NULL) x GROUP BY pair_id, island", sides(d)),
}
