"""Text functions as SQL expressions of a Dialect: folding, tokens, similarity, file names, numbers, units."""

from __future__ import annotations

from vellumgrid.plans.dialect import Dialect

WORD = r"[\p{L}\p{N}'’]"
TOKENS = WORD + "+"
#: Words and what lies between them, so that a text is the sum of its pieces.
PIECES = r"[\p{L}\p{N}'’]+|[^\p{L}\p{N}'’]+"
QUOTES, QUOTES_TO = "’‘‛“”„«»–—−‑", "'''\"\"\"\"\"----"
SPACES = r"[ \t\n\x0b\f\r\x{A0}\x{2007}\x{202F}]+"
#: Letters that folding to ASCII replaces, pairwise.
FOLD, FOLD_TO = "çğıöşüâîûÇĞİÖŞÜÂÎÛ", "cgiosuaiuCGIOSUAIU"


def tr_lower(d: Dialect, c: str) -> str:
    return f"lower(translate({c}, 'Iİ', 'ıi'))"


def tr_upper(d: Dialect, c: str) -> str:
    return f"upper(translate({c}, 'iı', 'İI'))"


def canonical(d: Dialect, c: str) -> str:
    return f"translate({c}, {d.lit(QUOTES)}, {d.lit(QUOTES_TO)})"


def normalized(d: Dialect, c: str) -> str:
    return f"trim({d.replace(canonical(d, tr_lower(d, c)), SPACES, ' ')})"


def tokens(d: Dialect, c: str) -> str:
    return d.extract_all(c, TOKENS)


def folded(d: Dialect, c: str) -> str:
    return f"translate({c}, '{FOLD}', '{FOLD_TO}')"


def ascii_fold(d: Dialect, c: str) -> str:
    return folded(d, tr_lower(d, c))


def token_set(d: Dialect, c: str) -> str:
    return d.distinct(tokens(d, normalized(d, c)))


def jaccard(d: Dialect, a: str, b: str) -> str:
    """Of two arrays of distinct tokens; 1 for two empty ones."""
    return f"(CASE WHEN {d.size(a)} + {d.size(b)} = 0 THEN 1.0 ELSE CAST({d.size(d.intersect(a, b))} AS DOUBLE) / CAST({d.size(d.union(a, b))} AS DOUBLE) END)"


def edit_similarity(d: Dialect, a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1.0 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})) END)"


def words(d: Dialect, c: str) -> str:
    """Words between blanks; a blank text has none."""
    return d.count(c, r"[^ \t\n\x0b\f\r]+")


def carry_case(d: Dialect, model: str, word: str) -> str:
    """word in the case of model: all capitals, first capital, or as it is."""
    up = tr_upper(d, word)
    first = f"concat({tr_upper(d, f'substring({word}, 1, 1)')}, substring({word}, 2))"
    return f"(CASE WHEN length({model}) > 1 AND {model} = {tr_upper(d, model)} AND {model} <> {tr_lower(d, model)} THEN {up} WHEN substring({model}, 1, 1) <> {tr_lower(d, f'substring({model}, 1, 1)')} THEN {first} ELSE {word} END)"


def extension(d: Dialect, c: str) -> str:
    return f"lower({d.extract(c, r'[.]([^.]+)$', 1)})"


def base_name(d: Dialect, c: str) -> str:
    return d.extract(c, r"([^/\\]*)$", 1)


def stem(d: Dialect, c: str) -> str:
    return d.replace(base_name(d, c), r"[.][^.]*$")


def safe_name(d: Dialect, c: str) -> str:
    """A file name of ASCII letters, digits, dots and dashes, 96 at most, no device name of old systems."""
    plain = d.replace(d.replace(folded(d, c), r"[^A-Za-z0-9._-]+", "_"), r"^[_.]+|[_.]+$")
    cut = f"substring({plain}, 1, 96)"
    return f"(CASE WHEN {cut} = '' THEN 'file' WHEN {d.like(f'lower({cut})', '^(con|prn|aux|nul|com[1-9]|lpt[1-9])([.]|$)')} THEN concat('_', {cut}) ELSE {cut} END)"


def escape_xml(d: Dialect, c: str) -> str:
    return f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def escape_markdown(d: Dialect, c: str) -> str:
    out = c
    for sign in ("\\", "*", "_", "[", "]", "`"):
        out = f"replace({out}, {d.lit(sign)}, {d.lit(chr(92) + sign)})"
    return out


def human_size(d: Dialect, n: str) -> str:
    return f"(CASE WHEN {n} < 1024 THEN concat(CAST({n} AS string), ' B') WHEN {n} < 1048576 THEN concat(CAST(CAST(floor(({n} * 10 + 512) / 1024) AS BIGINT) / 10.0 AS string), ' KB') ELSE concat(CAST(CAST(floor(({n} * 10 + 524288) / 1048576) AS BIGINT) / 10.0 AS string), ' MB') END)"


def redacted(d: Dialect, c: str) -> str:
    """Paths and file names replaced."""
    return d.replace(d.replace(c, r"([A-Za-z]:)?([/\\][^/\\ ]+)+", "<path>"), r"[^ <>]+[.](docx|udf|pdf|DOCX|UDF|PDF)", "<file>")


def digits_grouped(d: Dialect, n: str) -> str:
    """Whole numbers with dots between thousands."""
    s = f"CAST({n} AS {d.kind('string')})"
    return f"(CASE WHEN {n} < 1000 THEN {s} WHEN {n} < 1000000 THEN concat(substring({s}, 1, length({s}) - 3), '.', right({s}, 3)) ELSE concat(substring({s}, 1, length({s}) - 6), '.', substring({s}, length({s}) - 5, 3), '.', right({s}, 3)) END)"


def sniff(d: Dialect, h: str) -> str:
    """Container by its first bytes, given as lower-case hex digits."""
    return (
        f"(CASE WHEN {h} LIKE '504b0304%' THEN 'zip' WHEN {h} LIKE '25504446%' THEN 'pdf' WHEN {h} LIKE 'ffd8ff%' THEN 'jpeg' WHEN {h} LIKE '89504e470d0a1a0a%' THEN 'png' "
        f"WHEN {h} LIKE '49492a00%' OR {h} LIKE '4d4d002a%' THEN 'tiff' WHEN {h} LIKE 'd0cf11e0a1b11ae1%' THEN 'ole' WHEN substring({h}, 9, 8) = '66747970' THEN 'heic' WHEN {h} LIKE '3c3f786d6c%' OR {h} LIKE 'efbbbf3c3f786d6c%' THEN 'xml' ELSE 'unknown' END)"
    )


ROMAN = r"^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
ALPHABET = {"latin": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "turkish": "ABCÇDEFGĞHIİJKLMNOÖPRSŞTUÜVYZ"}


def roman_value(d: Dialect, c: str) -> str:
    """Value of a Roman numeral of either case, read leniently: a sign before a greater one counts less. 0 for other texts."""
    u = tr_upper(d, f"translate({c}, 'ıi', 'II')")
    one = lambda i: f"(CASE substring({u}, CAST({i} AS INT), 1) WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 ELSE 0 END)"
    terms = " + ".join(f"(CASE WHEN {one(i)} < {one(i + 1)} THEN -{one(i)} ELSE {one(i)} END)" for i in range(1, 16))
    return f"CAST(CASE WHEN {d.like(u, '^[IVXLCDM]+$')} AND length({u}) <= 15 THEN {terms} ELSE 0 END AS BIGINT)"


def roman_numeral(d: Dialect, n: str) -> str:
    """Numeral of 1 to 3999; null beyond."""
    digit = lambda e, a, b, c: f"(CASE CAST(floor({n} / {e}) AS BIGINT) % 10 WHEN 1 THEN '{a}' WHEN 2 THEN '{a}{a}' WHEN 3 THEN '{a}{a}{a}' WHEN 4 THEN '{a}{b}' WHEN 5 THEN '{b}' WHEN 6 THEN '{b}{a}' WHEN 7 THEN '{b}{a}{a}' WHEN 8 THEN '{b}{a}{a}{a}' WHEN 9 THEN '{a}{c}' ELSE '' END)"
    return f"(CASE WHEN {n} BETWEEN 1 AND 3999 THEN concat({digit(1000, 'M', '', '')}, {digit(100, 'C', 'D', 'M')}, {digit(10, 'X', 'L', 'C')}, {digit(1, 'I', 'V', 'X')}) END)"


def letter_value(d: Dialect, c: str, alphabet: str) -> str:
    """Place of a single letter, from 1; 0 for others."""
    return f"CAST(CASE WHEN length({c}) = 1 THEN instr('{ALPHABET[alphabet]}', {tr_upper(d, c) if alphabet == 'turkish' else f'upper({c})'}) ELSE 0 END AS BIGINT)"


def value_letter(d: Dialect, n: str, alphabet: str) -> str:
    return f"(CASE WHEN {n} BETWEEN 1 AND {len(ALPHABET[alphabet])} THEN substring('{ALPHABET[alphabet]}', CAST({n} AS INT), 1) END)"


def amount(d: Dialect, c: str) -> str:
    """1.234,56 as hundredths; null for other texts."""
    whole = d.extract(c, r"^([0-9]{1,3}([.][0-9]{3})*|[0-9]+)(,[0-9]{1,2})?$", 1)
    part = d.extract(c, r"^([0-9]{1,3}([.][0-9]{3})*|[0-9]+)(,[0-9]{1,2})?$", 3)
    return f"(CASE WHEN {whole} <> '' THEN CAST(replace({whole}, '.', '') AS BIGINT) * 100 + CAST(rpad(replace(concat({part}, ''), ',', ''), 2, '0') AS BIGINT) END)"
