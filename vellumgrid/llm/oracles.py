"""SQL of the queries that SQL can express, in the dialect of the comparison."""

from __future__ import annotations

from vellumgrid.llm.quality import CLASSES, COMMON, LEAST_TEXTS, WORD_LENGTH, Limits

BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SPLIT = r"'[\x20\x09-\x0D]+'"
WORDS = f"CASE WHEN trim(coalesce(text, ''), {BLANKS}) = '' THEN [] ELSE regexp_split_to_array(trim(text, {BLANKS}), {SPLIT}) END"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def ngram_join(size: int, num: int, den: int) -> str:
    words = WORDS.replace("trim(text,", f"trim({LOWER},")
    runs = ", chr(32), ".join(f"ws[p + {k}]" for k in range(size))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words} AS ws FROM documents),
w AS (SELECT doc_id, ws, CASE WHEN len(ws) >= {size} THEN len(ws) - {size - 1} WHEN len(ws) > 0 THEN 1 ELSE 0 END AS n FROM d),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= {size} THEN concat({runs}) ELSE array_to_string(ws, ' ') || chr(0) END AS g FROM (SELECT doc_id, ws, unnest(range(1, n + 1)) AS p FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE {den} * k >= {num} * (x.n + y.n - k)),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
comp AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM reach GROUP BY a),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS c FROM (SELECT doc_id, string_agg(g, chr(1) ORDER BY g) AS sig FROM s GROUP BY doc_id))
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(comp.c, doc_id) AS component_id, coalesce(classes.c, doc_id) AS class_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN comp USING (doc_id) LEFT JOIN classes USING (doc_id)"""


def top_k(k: int, scale: int) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""


def suffix_dedup(length: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, unnest(range(1, octet_length(b) - {length - 2})) AS s, b FROM d WHERE octet_length(b) >= {length}),
k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY b[s:s + {length - 1}] ORDER BY doc_id, s) AS rn FROM w),
r AS (SELECT doc_id, s, coalesce(s > max(s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {length}, true) AS fresh FROM k WHERE rn > 1),
g AS (SELECT doc_id, s, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS grp FROM r),
spans AS (SELECT doc_id, grp, min(s) AS lo, max(s) + {length - 1} AS hi FROM g GROUP BY doc_id, grp),
parts AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM spans),
cut AS (SELECT doc_id, sum(hi - lo + 1) AS removed, count(*) AS n, string_agg(hex(b[before + 1:lo - 1]), '' ORDER BY lo) AS head, max(hi) AS last FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(CASE WHEN removed IS NULL THEN b ELSE unhex(head || hex(b[last + 1:octet_length(b)])) END) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""


def quality_rules(limits: Limits = Limits()) -> str:
    dropped = [f"length(t) - length(regexp_replace(t, '{c}', '', 'g'))" for c in CLASSES]
    jsd = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: 0.5 * (CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END)))))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
langs AS (SELECT lang, count(*) AS n FROM d WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {LEAST_TEXTS}),
wd AS (SELECT rid, lang, unnest(ws) AS w FROM d),
cw AS (SELECT lang, lower(w) AS w, count(*) AS n FROM wd WHERE length(w) <= {WORD_LENGTH} AND regexp_matches(w, '^\\p{{L}}+$') AND lang IS NOT NULL GROUP BY ALL),
tops AS (SELECT DISTINCT w FROM (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS r FROM cw) WHERE r <= {COMMON} AND lang IN (SELECT lang FROM langs)),
slots AS (SELECT w, row_number() OVER (ORDER BY w) AS slot FROM tops),
grid AS (SELECT rid, slot FROM d, slots),
hits AS (SELECT rid, slot, count(*) AS n FROM wd JOIN slots ON lower(wd.w) = slots.w WHERE length(wd.w) <= {WORD_LENGTH} GROUP BY ALL),
hist AS (SELECT g.rid, list(coalesce(n, 0) ORDER BY g.slot) AS c FROM grid g LEFT JOIN hits h ON g.rid = h.rid AND g.slot = h.slot GROUP BY g.rid),
win AS (SELECT rid, p, concat(ws[p], chr(32), ws[p + 1], chr(32), ws[p + 2]) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS p FROM d WHERE len(ws) >= 3)),
rep AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS k FROM win) WHERE k > 1) GROUP BY rid),
b AS (SELECT rid, doc_id, lang, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
        (SELECT count(*) - count(DISTINCT x) FROM (SELECT unnest(string_split(t, chr(10))) AS x) WHERE trim(x, {BLANKS}) <> '') AS n_dup_lines,
        [{", ".join(dropped)}] AS c0, length(t) AS chars, ws FROM d),
f AS (SELECT b.*, coalesce(rep.n, 0) AS n_repeat_words, list_concat(list_concat(c0, [chars - word_chars]), [chars - list_sum(c0) - (chars - word_chars)]) AS cc,
        list_concat(coalesce(hist.c, []), [n_words - coalesce(list_sum(hist.c), 0)]) AS wc FROM b LEFT JOIN rep USING (rid) LEFT JOIN hist USING (rid)),
ref AS (SELECT lang, list(cn ORDER BY i) AS cr, any_value(wr) AS wr FROM (
          SELECT lang, i, sum(cc[i]) / sum(chars) AS cn FROM f, range(1, {len(CLASSES) + 3}) r(i) WHERE lang IN (SELECT lang FROM langs) GROUP BY lang, i) x
        JOIN (SELECT lang AS wl, list(wn ORDER BY i) AS wr FROM (SELECT lang, i, sum(wc[i]) / sum(n_words) AS wn FROM f, range(1, (SELECT count(*) FROM slots) + 2) r(i) WHERE lang IN (SELECT lang FROM langs) GROUP BY lang, i) GROUP BY lang) y ON x.lang = y.wl GROUP BY lang),
pq AS (SELECT *, list_transform(cc, lambda x: CASE WHEN chars > 0 THEN x / chars ELSE 0 END) AS p, list_transform(wc, lambda x: CASE WHEN n_words > 0 THEN x / n_words ELSE 0 END) AS q FROM f),
dist AS (SELECT pz.rid, min({jsd('p', 'cr')}) AS cd, min(CASE WHEN n_words * (1 - wr[len(wr)]) >= {limits.guard_common} THEN {jsd('q', 'wr')} / nullif({jsd('none', 'wr')}, 0) END) AS ratio FROM (SELECT *, list_transform(q, lambda x, i: CASE WHEN i = len(q) THEN 1.0 ELSE 0.0 END) AS none FROM pq) pz JOIN ref ON pz.lang = ref.lang OR pz.lang IS NULL GROUP BY pz.rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < {limits.least_words} OR 100 * n_repeat_words > {limits.most_repeat_percent} * n_words) AS base_failed,
       NOT (n_words < {limits.least_words} OR 100 * n_repeat_words > {limits.most_repeat_percent} * n_words)
         AND NOT coalesce(chars >= {limits.guard_chars} AND cd > {limits.char_distance}, false) AND NOT coalesce(ratio > {limits.word_ratio}, false) AS kept
FROM pq LEFT JOIN dist USING (rid)"""
