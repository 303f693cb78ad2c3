"""Audit rules: findings from blocks (doc_id, block_index, text).

A rule of one block works inside the row: the text is cut into pieces that add up to it, the places that break the rule
are filtered out of the array, and only they become rows. Nothing is shuffled. Rules of a whole document group or window
by doc_id. Every rule gives doc_id, rule_id, severity_rank, confidence, block_index, char_start, char_end, original and
replacement (null: no fix)."""

from __future__ import annotations

from vellumgrid.functions import text as f
from vellumgrid.functions.language import TURKISH, LanguagePack
from vellumgrid.plans.dialect import Dialect, Statement

COLUMNS = "doc_id, rule_id, severity_rank, confidence, block_index, char_start, char_end, original, replacement"
ERROR, WARNING, REVIEW = 0, 1, 2
#: Rule: id, severity, confidence (fixed values of the rule table).
RULES = {
    "r01_word_duplication": ("TEXT_WORD_DUPLICATION", ERROR, 0.97),
    "r02_sentence_duplication": ("TEXT_SENTENCE_DUPLICATION", ERROR, 0.96),
    "r03_paragraph_duplication": ("TEXT_PARAGRAPH_DUPLICATION", ERROR, 0.95),
    "r05_double_punctuation": ("TYPO_DOUBLE_PUNCTUATION", ERROR, 0.97),
    "r06_space_before_punctuation": ("TYPO_SPACE_BEFORE_PUNCTUATION", ERROR, 0.95),
    "r07_missing_space_after": ("TYPO_MISSING_SPACE_AFTER_PUNCTUATION", ERROR, 0.90),
    "r08_multiple_spaces": ("TYPO_MULTIPLE_SPACES", ERROR, 0.92),
    "r09_apostrophe_spacing": ("TYPO_APOSTROPHE_SPACING", ERROR, 0.90),
    "r10_bracket_padding": ("TYPO_BRACKET_PADDING", WARNING, 0.85),
    "r11_unclosed_brackets": ("TYPO_UNCLOSED_PAIR", ERROR, 0.90),
    "r12_unbalanced_quotes": ("TYPO_UNCLOSED_PAIR", ERROR, 0.85),
    "r13_invisible_characters": ("TYPO_INVISIBLE_CHAR", WARNING, 0.90),
    "r14_replacement_characters": ("TYPO_REPLACEMENT_CHAR", ERROR, 0.99),
    "r15_mixed_dashes": ("TYPO_MIXED_DASH", REVIEW, 0.60),
    "r16_tabs_in_text": ("TYPO_TAB_IN_TEXT", WARNING, 0.70),
    "r17_placeholders": ("DRAFT_PLACEHOLDER", ERROR, 0.95),
    "r18_dangling_connectors": ("DRAFT_DANGLING_CONNECTOR", WARNING, 0.75),
    "r19_empty_numbered": ("DRAFT_EMPTY_NUMBERED", WARNING, 0.90),
    "r32_citation_format": ("CONSISTENCY_CITATION_FORMAT", REVIEW, 0.60),
    "r33_date_format": ("CONSISTENCY_DATE_FORMAT", REVIEW, 0.60),
    "r34_amount_format": ("CONSISTENCY_AMOUNT_FORMAT", REVIEW, 0.60),
    "r35_term_spelling": ("CONSISTENCY_TERM_SPELLING", REVIEW, 0.60),
    "r37_separate_writing": ("ORTHO_SEPARATE_WRITING", ERROR, 0.95),
    "r38_user_dictionary": ("ORTHO_USER_DICTIONARY", WARNING, 0.90),
}


def head(name: str) -> str:
    rule, severity, confidence = RULES[name]
    return f"'{rule}' AS rule_id, CAST({severity} AS BIGINT) AS severity_rank, CAST({confidence} AS DOUBLE) AS confidence"


def in_block(name: str, d: Dialect, pattern: str, cond, span: int = 1, replacement="NULL", lead: int = 0, where: str = "true") -> Statement:
    """Findings where cond(at) holds for a piece; at(k) is the k-th piece from it. The finding spans `span` pieces from the
    `lead`-th on. replacement: an expression over b, e (first and last place) and pieces, or NULL."""
    at = lambda k: d.at("pieces", f"(i + {k})" if k >= 0 else f"(i - {-k})")
    places = d.filter(d.upto(d.size("pieces")), "i", cond(at))
    first = f"(i + {lead})" if lead >= 0 else f"(i - {-lead})"
    last = f"(i + {lead + span - 1})"
    parts = (
        ("cut", f"SELECT doc_id, block_index, text, {d.extract_all('text', pattern)} AS pieces FROM blocks WHERE {where}"),
        ("found", d.explode("cut", "doc_id, block_index, text, pieces", places, "i")),
        ("placed", f"SELECT doc_id, block_index, text, pieces, i, CAST(length({d.join(d.head('pieces', f'{first} - 1'))}) AS BIGINT) AS char_start, CAST({d.length_to('pieces', first, last, span)} AS BIGINT) AS char_end FROM found"),
    )
    fix = replacement(at) if callable(replacement) else replacement
    kind = d.kind("string")
    final = f"SELECT doc_id, {head(name)}, block_index, char_start, char_end, substring(text, CAST(char_start + 1 AS INT), CAST(char_end - char_start AS INT)) AS original, CAST({fix} AS {kind}) AS replacement FROM placed"
    return Statement(final, parts)


def plain(name: str, d: Dialect, relation: str, start: str, end: str, original: str, replacement: str = "NULL", where: str = "true") -> str:
    return f"SELECT doc_id, {head(name)}, block_index, CAST({start} AS BIGINT) AS char_start, CAST({end} AS BIGINT) AS char_end, {original} AS original, CAST({replacement} AS {d.kind('string')}) AS replacement FROM {relation} WHERE {where}"


def word_duplication(d: Dialect, pack: LanguagePack = TURKISH) -> Statement:
    """A word directly after itself, blanks between; not numbers, one or two letters, or words of the pack."""
    low = lambda e: f.tr_lower(d, e)
    cond = lambda at: f"({d.like(at(0), '^' + f.WORD)} AND {d.like(at(1), '^ +$')} AND {low(at(0))} = {low(at(2))} AND length({at(0)}) > 2 AND NOT {d.like(at(0), '^[0-9]+$')} AND {low(at(0))} NOT IN ({d.strings(pack.repeatable)}))"
    # small letters of a whole text end words with either sigma
    twice = d.like(f"replace({low('text')}, 'ς', 'σ')", f"(?:^|[^{f.WORD[1:]})({f.WORD}{{3,}}+) +\\1(?!{f.WORD})")
    return in_block("r01_word_duplication", d, f.PIECES, cond, span=2, lead=1, replacement="''", where=d.sieve(twice))


#: Sentences and what lies between: a sentence ends with . ! or ? before a blank or the end.
SENTENCE = r"[^.!?]+[.!?]+[”\"')]*"


def sentence_duplication(d: Dialect, pack: LanguagePack = TURKISH) -> Statement:
    """A sentence of three words or more directly after itself, when normalized."""
    norm = lambda e: f.normalized(d, e)
    cond = lambda at: f"({at(1)} IS NOT NULL AND {norm(at(0))} = {norm(at(1))} AND {f.words(d, norm(at(0)))} >= 3)"
    return in_block("r02_sentence_duplication", d, SENTENCE + r"|[.!?]+|[^.!?]+$", cond, span=1, lead=1, replacement="''", where=d.like("text", "[.!?]"))


def paragraph_duplication(d: Dialect) -> Statement:
    """A block of six words or more that an earlier block of the document equals when normalized."""
    parts = (
        ("eligible", f"SELECT doc_id, block_index, text, {f.normalized(d, 'text')} AS norm FROM blocks WHERE {f.words(d, 'text')} >= 6"),
        ("ranked", "SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY block_index) AS rn FROM eligible"),
    )
    return Statement(plain("r03_paragraph_duplication", d, "ranked", "0", "length(text)", "text", where="rn > 1"), parts)


def double_punctuation(d: Dialect) -> Statement:
    """Two or more signs in a row, but for an ellipsis, ?! and !?, an anonymised initial and dots of numbers."""
    cond = lambda at: f"({d.like(at(0), '^[.,;:!?]{2,}$')} AND {at(0)} NOT IN ('...', '?!', '!?') AND NOT ({at(0)} = '..' AND {d.like(at(-1), r'(^|[^\p{L}\p{N}])\p{Lu}$')}) AND NOT ({d.like(at(-1), '[0-9]$')} AND {d.like(at(1), '^[0-9]')}))"
    uniform = lambda at: f"CASE WHEN replace({at(0)}, substring({at(0)}, 1, 1), '') = '' THEN substring({at(0)}, 1, 1) END"
    return in_block("r05_double_punctuation", d, "[.,;:!?]+|[^.,;:!?]+", cond, replacement=uniform, where=d.like("text", "[.,;:!?]{2}"))


def space_before_punctuation(d: Dialect) -> Statement:
    cond = lambda at: f"({d.like(at(0), '^ +$')} AND {d.like(at(1), '^[.,;:!?]')} AND {d.like(at(-1), f.WORD + '$')})"
    return in_block("r06_space_before_punctuation", d, " +|[^ ]+", cond, replacement="''", where=d.like("text", " [.,;:!?]"))


def missing_space_after(d: Dialect) -> Statement:
    """A comma, semicolon, colon, ! or ? between a word and a letter."""
    cond = lambda at: f"({d.like(at(0), '^[,;:!?]$')} AND {at(-1)} IS NOT NULL AND {d.like(at(1), r'^\p{L}')})"
    return in_block("r07_missing_space_after", d, f.PIECES, cond, replacement=lambda at: f"concat({at(0)}, ' ')", where=d.like("text", r"[,;:!?]\p{L}"))


def multiple_spaces(d: Dialect) -> Statement:
    cond = lambda at: f"({d.like(at(0), '^ {2,}$')} AND {at(-1)} IS NOT NULL AND {at(1)} IS NOT NULL AND NOT {d.like(at(-1), '\t$')} AND NOT {d.like(at(1), '^\t')})"
    return in_block("r08_multiple_spaces", d, " +|[^ ]+", cond, replacement="' '", where=d.like("text", " {2}"))


def apostrophe_spacing(d: Dialect) -> Statement:
    """An apostrophe kept from its suffix of one to four small letters, or from its word, by blanks."""
    suffix = lambda e: d.like(e, r"^\p{Ll}{1,4}$")
    word = lambda e: d.like(e, r"^[\p{L}\p{N}]")
    cond = lambda at: f"({d.like(at(0), '^ +$')} AND (({at(-1)} IN ('''', '’') AND {word(at(-2))} AND {suffix(at(1))}) OR ({at(1)} IN ('''', '’') AND {word(at(-1))} AND {suffix(at(2))})))"
    return in_block("r09_apostrophe_spacing", d, r"['’]|[\p{L}\p{N}]+| +|[^\p{L}\p{N} '’]+", lambda at: cond(at).replace("''''", d.lit("'")), replacement="''", where=d.like("text", "['’] | ['’]"))


def bracket_padding(d: Dialect) -> Statement:
    cond = lambda at: f"({d.like(at(0), '^ +$')} AND ({at(-1)} IN ('(', '[') OR {at(1)} IN (')', ']')))"
    return in_block("r10_bracket_padding", d, r"[()\[\]]| +|[^()\[\] ]+", cond, replacement="''", where=d.like("text", r"[(\[] | [)\]]"))


def unclosed_brackets(d: Dialect) -> Statement:
    """Brackets of a block that no partner closes: matched pairs are taken away from inside until none is left."""
    depth = d.replace("text", r"^ *[(]?[\p{L}\p{N}]{1,6}[)] ")
    bare = d.replace(depth, r"[^()\[\]]+")
    for _ in range(6):
        bare = f"replace(replace({bare}, '()', ''), '[]', '')"
    return Statement(plain("r11_unclosed_brackets", d, "open", "0", "length(text)", "rest", where="rest <> ''"), (("open", f"SELECT doc_id, block_index, text, {bare} AS rest FROM blocks WHERE {d.like('text', r'[()\[\]]')}"),))


def unbalanced_quotes(d: Dialect) -> Statement:
    """Documents whose opening and closing quotation marks differ in number, or with an odd number of straight ones."""
    marks = d.count("text", "“"), d.count("text", "”"), d.count("text", '"')
    parts = (
        ("counted", f"SELECT doc_id, block_index, {marks[0]} AS o, {marks[1]} AS c, {marks[2]} AS s FROM blocks"),
        ("totals", "SELECT doc_id, CAST(sum(o) AS BIGINT) AS o, CAST(sum(c) AS BIGINT) AS c, CAST(sum(s) AS BIGINT) AS s, max(CASE WHEN o > 0 OR c > 0 OR s > 0 THEN block_index END) AS block_index FROM counted GROUP BY doc_id"),
    )
    kind = d.kind("string")
    original = f"concat(CAST(o AS {kind}), '/', CAST(c AS {kind}), '/', CAST(s AS {kind}))"
    return Statement(plain("r12_unbalanced_quotes", d, "totals", "0", "0", original, where="o <> c OR s % 2 = 1"), parts)


#: Code points without a sign: zero-width, soft hyphen, byte order mark, special blanks, controls (fixed values).
INVISIBLE = r"\x{200B}\x{200C}\x{200D}\x{FEFF}\x{2060}\x{00AD}\x{180E}\x{00A0}\x{2007}\x{202F}\x{2009}\x{2002}\x{2003}\x00-\x08\x0B\x0C\x0E-\x1F"
SPACE_LIKE = r"[\x{00A0}\x{2007}\x{202F}\x{2009}\x{2002}\x{2003}]"


def invisible_characters(d: Dialect) -> Statement:
    cond = lambda at: d.like(at(0), f"^[{INVISIBLE}]")
    return in_block("r13_invisible_characters", d, f"[{INVISIBLE}]|[^{INVISIBLE}]+", cond, replacement=lambda at: f"CASE WHEN {d.like(at(0), SPACE_LIKE)} THEN ' ' ELSE '' END", where=d.like("text", f"[{INVISIBLE}]"))


def replacement_characters(d: Dialect) -> Statement:
    return in_block("r14_replacement_characters", d, r"\x{FFFD}|[^\x{FFFD}]+", lambda at: d.like(at(0), r"^\x{FFFD}"), where=d.like("text", r"\x{FFFD}"))


def mixed_dashes(d: Dialect) -> Statement:
    """Documents with more than one kind of dash between blanks."""
    parts = (
        ("dashes", d.explode("blocks", "doc_id, block_index", d.extract_all("text", " ([-–—]) ", 1), "dash")),
        ("kinds", f"SELECT doc_id, count(DISTINCT dash) AS n, min(block_index) AS block_index, min(dash) AS least, max(dash) AS most FROM dashes GROUP BY doc_id"),
    )
    return Statement(plain("r15_mixed_dashes", d, "kinds", "0", "0", "concat(least, most)", where="n > 1"), parts)


def tabs_in_text(d: Dialect) -> Statement:
    cond = lambda at: f"({d.like(at(0), '^\t')} AND {d.like(at(-1), '[^ ]')} AND {at(1)} IS NOT NULL)"
    return in_block("r16_tabs_in_text", d, "\t+|[^\t]+", cond, replacement="' '", where=d.like("text", "\t"))


def placeholders(d: Dialect) -> Statement:
    """Dots or lines to be filled in, runs of X, and slots in square brackets."""
    cond = lambda at: d.like(at(0), r"^([.]{4,}|_{3,}|X{3,}|\[[\p{Lu} /]{2,40}\])$")
    return in_block("r17_placeholders", d, r"[.]{4,}|_{3,}|X{3,}|\[[\p{Lu} /]{2,40}\]|[^._X\[]+|.", cond, where=d.like("text", r"[.]{4,}|_{3,}|X{3,}|\[[\p{Lu} /]{2,40}\]"))


def dangling_connectors(d: Dialect, pack: LanguagePack = TURKISH) -> Statement:
    last = f.tr_lower(d, d.extract("text", f"({f.WORD}+)[,;]? *$", 1))
    return Statement(plain("r18_dangling_connectors", d, "blocks", "length(text)", "length(text)", last, where=f"{last} IN ({d.strings(pack.connectors)}) AND {f.words(d, 'text')} >= 2"))


def empty_numbered(d: Dialect) -> Statement:
    return Statement(plain("r19_empty_numbered", d, "blocks", "0", "length(text)", "text", where=d.like("text", r"^ *[(]?([0-9]{1,3}|\p{L})[.)] *$")))


def first_of_styles(name: str, d: Dialect, styles: list[tuple[str, str]]) -> Statement:
    """Documents that write one thing in more than one style: the first block that has one."""
    hits = " UNION ALL ".join(f"SELECT doc_id, block_index, '{style}' AS style FROM blocks WHERE {d.like('text', pattern)}" for style, pattern in styles)
    parts = (("hits", hits), ("kinds", "SELECT doc_id, count(DISTINCT style) AS n, min(block_index) AS block_index, min(style) AS least, max(style) AS most FROM hits GROUP BY doc_id"))
    return Statement(plain(name, d, "kinds", "0", "0", "concat(least, ',', most)", where="n > 1"), parts)


def date_format(d: Dialect, pack: LanguagePack = TURKISH) -> Statement:
    return first_of_styles("r33_date_format", d, [("dots", r"(^|[^0-9])[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}([^0-9]|$)"), ("slashes", r"(^|[^0-9])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}([^0-9]|$)"), ("iso", r"(^|[^0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}([^0-9]|$)"), ("words", "(?i)[0-9]{1,2} (" + "|".join(pack.months) + ") [0-9]{4}")])


def amount_format(d: Dialect, pack: LanguagePack = TURKISH) -> Statement:
    return first_of_styles("r34_amount_format", d, [(f"c{i}", f"[0-9] {c}([^\\p{{L}}]|$)") for i, c in enumerate(pack.currencies)])


def citation_format(d: Dialect) -> Statement:
    """An article of a code cited in several forms: each form after the first, where it first stands."""
    forms = [r"(\p{Lu}{2,5} m[.] [0-9]+)", r"(\p{Lu}{2,5} md[.] [0-9]+)", r"(\p{Lu}{2,5} [0-9]+[.] madde)", r"(\p{Lu}{2,5} madde [0-9]+)"]
    hits = " UNION ALL ".join(d.explode("blocks", f"doc_id, block_index, {i} AS form", d.extract_all("text", p, 1), "surface") for i, p in enumerate(forms))
    parts = (
        ("hits", hits),
        ("cited", f"SELECT doc_id, block_index, form, surface, {d.extract('surface', r'^(\p{Lu}{2,5})', 1)} AS code, {d.extract('surface', '([0-9]+)', 1)} AS article FROM hits"),
        ("forms", "SELECT doc_id, code, article, form, min(block_index) AS block_index, min(surface) AS surface FROM cited GROUP BY doc_id, code, article, form"),
        ("ranked", "SELECT *, row_number() OVER (PARTITION BY doc_id, code, article ORDER BY surface) AS rn FROM forms"),
    )
    return Statement(plain("r32_citation_format", d, "ranked", "0", "length(surface)", "surface", where="rn > 1"), parts)


def term_spelling(d: Dialect) -> Statement:
    """Words of five letters or more that a document also spells with other diacritics. The spelling with most of them,
    then the more frequent, is the reference; on a tie there is no fix. Only foldings seen with diacritics count."""
    low = f.tr_lower(d, "token")
    parts = (
        ("terms", d.explode("blocks", "doc_id, block_index", f.tokens(d, "text"), "token")),
        ("spelt", f"SELECT doc_id, block_index, {low} AS word FROM terms WHERE length(token) >= 5"),
        ("grouped", f"SELECT doc_id, {f.folded(d, 'word')} AS fold, word, {d.count('word', '[' + f.FOLD[:9] + ']')} AS marks, count(*) AS n, min(block_index) AS block_index FROM spelt GROUP BY doc_id, word"),
        ("several", "SELECT doc_id, fold, max(marks) AS most FROM grouped GROUP BY doc_id, fold HAVING count(*) > 1 AND max(marks) > 0"),
        ("ranked", "SELECT g.*, s.most, row_number() OVER (PARTITION BY g.doc_id, g.fold ORDER BY g.marks DESC, g.n DESC, g.word) AS rn, count(*) OVER (PARTITION BY g.doc_id, g.fold, g.marks, g.n) AS ties FROM grouped g JOIN several s ON g.doc_id = s.doc_id AND g.fold = s.fold"),
        ("best", "SELECT doc_id, fold, word AS reference, ties FROM ranked WHERE rn = 1"),
        ("joined", "SELECT r.doc_id, r.block_index, r.word, CASE WHEN b.ties = 1 THEN b.reference END AS fix FROM ranked r JOIN best b ON r.doc_id = b.doc_id AND r.fold = b.fold WHERE r.rn > 1"),
    )
    return Statement(plain("r35_term_spelling", d, "joined", "0", "length(word)", "word", "fix"), parts)


def separate_writing(d: Dialect, pack: LanguagePack = TURKISH) -> Statement:
    """Compounds written as one word, with a suffix of six letters at most, but for accepted words."""
    low = lambda e: f.tr_lower(d, e)
    match = lambda e: " OR ".join(f"({low(e)} LIKE {d.lit(c + '%')} AND length({e}) <= {len(c) + 6})" for c, _ in pack.compounds)
    fixes = lambda at: "CASE " + " ".join(f"WHEN {low(at(0))} LIKE {d.lit(c + '%')} THEN concat({d.lit(to)}, substring({low(at(0))}, {len(c) + 1}))" for c, to in sorted(pack.compounds, key=lambda x: -len(x[0]))) + " END"
    return in_block("r37_separate_writing", d, f.PIECES, lambda at: f"(({match(at(0))}) AND {low(at(0))} NOT IN ({d.strings(pack.accepted)}))", replacement=fixes, where=d.sieve(d.holds_any(low("text"), [c for c, _ in pack.compounds])))


def user_dictionary(d: Dialect, pack: LanguagePack = TURKISH) -> Statement:
    low = lambda e: f.tr_lower(d, e)
    fix = lambda at: "CASE " + " ".join(f"WHEN {low(at(0))} = {d.lit(a)} THEN {f.carry_case(d, at(0), d.lit(b))}" for a, b in pack.corrections) + " END"
    return in_block("r38_user_dictionary", d, f.PIECES, lambda at: f"({low(at(0))} IN ({d.strings(a for a, _ in pack.corrections)}))", replacement=fix, where=d.sieve(d.holds_any(low("text"), [a for a, _ in pack.corrections])))


STATEMENTS = {
    "r01_word_duplication": word_duplication,
    "r02_sentence_duplication": sentence_duplication,
    "r03_paragraph_duplication": paragraph_duplication,
    "r05_double_punctuation": double_punctuation,
    "r06_space_before_punctuation": space_before_punctuation,
    "r07_missing_space_after": missing_space_after,
    "r08_multiple_spaces": multiple_spaces,
    "r09_apostrophe_spacing": apostrophe_spacing,
    "r10_bracket_padding": bracket_padding,
    "r11_unclosed_brackets": unclosed_brackets,
    "r12_unbalanced_quotes": unbalanced_quotes,
    "r13_invisible_characters": invisible_characters,
    "r14_replacement_characters": replacement_characters,
    "r15_mixed_dashes": mixed_dashes,
    "r16_tabs_in_text": tabs_in_text,
    "r17_placeholders": placeholders,
    "r18_dangling_connectors": dangling_connectors,
    "r19_empty_numbered": empty_numbered,
    "r32_citation_format": citation_format,
    "r33_date_format": date_format,
    "r34_amount_format": amount_format,
    "r35_term_spelling": term_spelling,
    "r37_separate_writing": separate_writing,
    "r38_user_dictionary": user_dictionary,
}


def all_findings(d: Dialect, names=tuple(STATEMENTS)) -> tuple[tuple[str, str], ...]:
    """One relation, findings: the union of rules."""
    return (("findings", " UNION ALL ".join(f"SELECT {COLUMNS} FROM ({STATEMENTS[n](d).text()}) AS f_{n}" for n in names)),)


def gated(d: Dialect, floor: float = 0.55, cap: int = 50, review: bool = True, disabled: tuple[str, ...] = ()) -> Statement:
    """Findings over the floor, of rules that are on, without direct repeats, `cap` of each rule and document at most."""
    off = f"AND rule_id NOT IN ({d.strings(disabled)})" if disabled else ""
    order = "severity_rank, block_index, char_start, rule_id, char_end, original"
    parts = (
        *all_findings(d),
        ("gate", f"SELECT * FROM findings WHERE confidence >= {floor} {off} {'' if review else f'AND severity_rank < {REVIEW}'}"),
        ("fresh", f"SELECT *, lag(concat(rule_id, ':', CAST(block_index AS {d.kind('string')}), ':', CAST(char_start AS {d.kind('string')}), ':', CAST(char_end AS {d.kind('string')}))) OVER (PARTITION BY doc_id ORDER BY {order}) AS before FROM gate"),
        ("kept", f"SELECT * FROM fresh WHERE before IS NULL OR before <> concat(rule_id, ':', CAST(block_index AS {d.kind('string')}), ':', CAST(char_start AS {d.kind('string')}), ':', CAST(char_end AS {d.kind('string')}))"),
        ("ranked", f"SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY {order}) AS BIGINT) AS place FROM kept"),
    )
    return Statement(f"SELECT {COLUMNS}, place FROM ranked WHERE place <= {cap}", parts)


def from_gate(d: Dialect, final: str, *more: tuple[str, str], cap: int = 50) -> Statement:
    g = gated(d, cap=cap)
    return Statement(final, (*g.parts, ("capped", g.final), *more))


GATE = {
    "f01_gated_findings": lambda d: from_gate(d, "SELECT doc_id, rule_id, confidence, block_index, char_start, char_end FROM kept WHERE confidence >= 0.7 AND severity_rank < 2"),
    "t02_top_k_per_rule": lambda d: gated(d, cap=3),
    "t01_sorted_findings": lambda d: from_gate(d, "SELECT doc_id, rule_id, block_index, char_start, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY severity_rank, block_index, char_start, rule_id, char_end, original) AS BIGINT) AS rank FROM kept"),
    "a02_severity_counts": lambda d: from_gate(d, f"SELECT doc_id, CAST({d.count_if('severity_rank = 0')} AS BIGINT) AS errors, CAST({d.count_if('severity_rank = 1')} AS BIGINT) AS warnings, CAST({d.count_if('severity_rank = 2')} AS BIGINT) AS reviews FROM kept GROUP BY doc_id"),
    "a03_truncated_rules": lambda d: from_gate(d, "SELECT doc_id, rule_id, count(*) AS total FROM kept GROUP BY doc_id, rule_id HAVING count(*) > 3"),
    "u01_union_of_rules": lambda d: Statement(f"SELECT {COLUMNS} FROM findings", all_findings(d)),
    "u02_consecutive_distinct": lambda d: from_gate(d, "SELECT rule_id, count(*) AS n FROM kept GROUP BY rule_id"),
}
