"""Comparison of two versions of a text: blocks are aligned, pairs are diffed by words, and what changed is summarised.

One pair of versions is one group of one call, so pairs run in parallel and their blocks are shuffled once. Inside a pair
the order of steps is sequential by nature: exact anchors, a longest increasing run of them, a global alignment of what
lies between, relocation of equal blocks that were left over, then word diffs."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions.language import TURKISH

#: Fixed values of the alignment: gap, score of a pair from its similarity, cells of a word diff, length of an anchor.
GAP, SLOPE, OFFSET, MOST_CELLS, ANCHOR = np.float32(-0.42), np.float32(1.65), np.float32(-0.62), 160_000, 24
TOKEN = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+|\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)?|[^\s\w]|_")
LOWER = str.maketrans("Iİ", "ıi")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text)


def form(text: str) -> str:
    """Case and blanks set aside."""
    return " ".join(text.replace("I", "ı").replace("İ", "i").lower().split())


#: A common run counts up to this length.
RUN = 6


def common_run(a: Sequence[str], b: Sequence[str], most: int = RUN) -> int:
    """Length of the longest common run of tokens, `most` for longer ones; linear in the tokens."""
    runs = lambda ts, k: set(zip(*(ts[i:] for i in range(k)), strict=False))
    return next((k for k in range(most, 0, -1) if not runs(a, k).isdisjoint(runs(b, k))), 0)


@dataclass(frozen=True)
class Signals:
    jaccard: float
    coverage: float
    length: float
    run: int

    @property
    def score(self) -> float:
        return 0.45 * self.jaccard + 0.35 * self.coverage + 0.1 * self.length + 0.1 * min(1.0, self.run / RUN)


def signals(a: str, b: str) -> Signals:
    x, y = tokens(form(a)), tokens(form(b))
    if not x or not y:
        return Signals(float(not x and not y), float(not x and not y), float(not x and not y), 0)
    cx, cy = Counter(x), Counter(y)
    shared = sum((cx & cy).values())
    return Signals(len(cx.keys() & cy.keys()) / len(cx.keys() | cy.keys()), shared / min(len(x), len(y)), min(len(x), len(y)) / max(len(x), len(y)), common_run(x, y))


def similarity(a: str, b: str) -> float:
    return 1.0 if form(a) == form(b) else min(0.999, signals(a, b).score)


def align(base: Sequence[str], revised: Sequence[str]) -> list[tuple[int | None, int | None]]:
    """Pairs of places in order, None for a block without partner: the global alignment of greatest score.

    Similarities are taken once for each pair of different texts: long parts without anchors are mostly repeated lines."""
    n, m = len(base), len(revised)
    rows, columns = ({t: k for k, t in enumerate(dict.fromkeys(ts))} for ts in (base, revised))
    alike = np.array([[similarity(a, b) for b in columns] for a in rows], np.float32).reshape(len(rows), len(columns))
    pair = SLOPE * alike
    row, column = [rows[t] for t in base], [columns[t] for t in revised]
    scores = np.zeros((n + 1, m + 1), np.float32)
    scores[1:, 0] = GAP * np.arange(1, n + 1, dtype=np.float32)
    scores[0, 1:] = GAP * np.arange(1, m + 1, dtype=np.float32)
    move = np.zeros((n + 1, m + 1), np.int8)
    move[1:, 0], move[0, 1:] = 1, 2
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            options = (scores[i - 1, j - 1] + pair[row[i - 1], column[j - 1]] + OFFSET, scores[i - 1, j] + GAP, scores[i, j - 1] + GAP)
            move[i, j] = int(np.argmax(options))
            scores[i, j] = options[move[i, j]]
    out, i, j = [], n, m
    while i or j:
        if move[i, j] == 0 and i and j:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif (move[i, j] == 1 and i) or not j:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that rises in both places; pairs come in the order of the first."""
    ends: list[int] = []  # of the run of each length, its least end and that end's pair
    last: list[int] = []
    before: list[int | None] = []
    for n, (_, q) in enumerate(pairs):
        k = bisect_left(ends, q)
        before.append(last[k - 1] if k else None)
        ends[k : k + 1], last[k : k + 1] = [q], [n]
    out, at = [], last[-1] if last else None
    while at is not None:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def align_with_anchors(base: Sequence[str], revised: Sequence[str]) -> list[tuple[int | None, int | None]]:
    """Equal long blocks that stand once on each side are anchors; the parts between them are aligned."""
    once = lambda xs: {t: i for i, t in enumerate(xs) if counts[t] == 1}
    x, y = [form(t) for t in base], [form(t) for t in revised]
    counts = Counter(x)
    left = once(x)
    counts = Counter(y)
    right = once(y)
    anchors = increasing([(i, right[t]) for t, i in sorted(left.items(), key=lambda e: e[1]) if len(t) >= ANCHOR and t in right])
    out, i, j = [], 0, 0
    for a, b in [*anchors, (len(base), len(revised))]:
        out += [(None if p is None else p + i, None if q is None else q + j) for p, q in align(base[i:a], revised[j:b])]
        if a < len(base) or b < len(revised):
            out.append((a, b))
        i, j = a + 1, b + 1
    return relocated(out, x, y)


def relocated(pairs: list[tuple[int | None, int | None]], x: list[str], y: list[str]) -> list[tuple[int | None, int | None]]:
    """Blocks without partner that are equal and the only such ones become pairs, at the revised place."""
    lost, new = [p for p, q in pairs if q is None], [q for p, q in pairs if p is None]
    stay, come, where = Counter(x[p] for p in lost), Counter(y[q] for q in new), {x[p]: p for p in lost}
    joined = {q: where[y[q]] for q in new if stay[y[q]] == 1 and come[y[q]] == 1}
    taken = set(joined.values())
    return [(joined.get(q), q) if p is None else (p, q) for p, q in pairs if not (q is None and p in taken)]


def word_diff(a: str, b: str) -> list[tuple[str, str]]:
    """Fragments (equal, removed or added; text): a longest common subsequence of words between common ends; everything is
    replaced where the middle has more than MOST_CELLS cells."""
    x, y = tokens(a), tokens(b)
    lo = 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < min(len(x), len(y)) - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    p, q = x[lo : len(x) - hi], y[lo : len(y) - hi]
    steps: list[tuple[str, str]] = [("equal", t) for t in x[:lo]]
    if len(p) * len(q) > MOST_CELLS:
        steps += [("removed", t) for t in p] + [("added", t) for t in q]
    else:
        best = np.zeros((len(p) + 1, len(q) + 1), np.int32)
        for i in range(len(p) - 1, -1, -1):
            for j in range(len(q) - 1, -1, -1):
                best[i, j] = best[i + 1, j + 1] + 1 if p[i] == q[j] else max(best[i + 1, j], best[i, j + 1])
        i = j = 0
        while i < len(p) or j < len(q):
            if i < len(p) and j < len(q) and p[i] == q[j]:
                steps.append(("equal", p[i]))
                i, j = i + 1, j + 1
            elif j == len(q) or (i < len(p) and best[i + 1, j] >= best[i, j + 1]):
                steps.append(("removed", p[i]))
                i += 1
            else:
                steps.append(("added", q[j]))
                j += 1
    steps += [("equal", t) for t in x[len(x) - hi :]]
    out: list[tuple[str, list[str]]] = []
    for kind, t in steps:
        if out and out[-1][0] == kind:
            out[-1][1].append(t)
        else:
            out.append((kind, [t]))
    return [(kind, " ".join(ts)) for kind, ts in out]


AMOUNT, DATE = re.compile(r"\d{1,3}(?:\.\d{3})*(?:,\d+)?\s*(?:TL|TRY|₺|€|\$|EUR|USD)"), re.compile(r"\b\d{1,2}[./]\d{1,2}[./]\d{4}\b")
DURATION = re.compile(r"\b\d+\s+(?:gün|hafta|ay|yıl|saat|days?|weeks?|months?|years?)\b")
NUMBER = re.compile(r"\d+(?:[.,]\d+)*")


def typed_changes(a: str, b: str, most: int = 3) -> list[tuple[str, str, str]]:
    """Kind, before and after of dates, amounts, durations and numbers that changed, pair by pair in order."""
    out = []
    for kind, pattern in (("date", DATE), ("amount", AMOUNT), ("duration", DURATION), ("number", NUMBER)):
        x, y = pattern.findall(a), pattern.findall(b)
        if len(x) == len(y):
            out += [(kind, p, q) for p, q in zip(x, y, strict=True) if p != q]
        if out:
            break
    return out[:most]


def compare_blocks(base: Sequence[str], revised: Sequence[str]) -> Iterator[dict]:
    """Rows of a comparison: kind (equal, modified, moved, added, removed), places, fragments, similarity."""
    last = -1
    for row, (p, q) in enumerate(align_with_anchors(base, revised)):
        a, b = (None if p is None else base[p]), (None if q is None else revised[q])
        if a is None or b is None:
            kind, fragments, score = ("added", [("added", b)], 0.0) if a is None else ("removed", [("removed", a)], 0.0)
        else:
            moved, last = p < last, max(last, p)
            score = similarity(a, b)
            kind = "moved" if moved else "equal" if form(a) == form(b) else "modified"
            fragments = word_diff(a, b)
        yield {"row_index": row, "kind": kind, "base_place": p, "revised_place": q, "similarity": round(score, 6), "fragments": "".join(f"[{k}:{t}]" for k, t in fragments if t), "typed": "; ".join(f"{k} {x} > {y}" for k, x, y in typed_changes(a, b)) if kind == "modified" else ""}


ROWS = "pair_id bigint, row_index bigint, kind string, base_place bigint, revised_place bigint, similarity double, fragments string, typed string"


def compare_versions(base: DataFrame, revised: DataFrame) -> DataFrame:
    """Comparison rows of every pair_id. Both sides: pair_id, place, text."""

    def one(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
        texts = lambda side: both[both["side"] == side].sort_values("place")["text"].fillna("").tolist()
        rows = list(compare_blocks(texts(0), texts(1)))
        names = [c.split()[0] for c in ROWS.split(", ")]
        out = pd.DataFrame([{"pair_id": key[0], **r} for r in rows], columns=names)
        return out.astype({"base_place": "Int64", "revised_place": "Int64"})

    side = lambda df, k: df.select("pair_id", "place", "text", F.lit(k).alias("side"))
    return side(base, 0).unionByName(side(revised, 1)).groupBy("pair_id").applyInPandas(one, ROWS)


#: Units, tens and powers of Turkish number words (fixed values).
UNITS = ["", "bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz"]
TENS = ["", "on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan"]
POWERS = ["", "bin", "milyon", "milyar", "trilyon", "katrilyon"]


def number_words(n: int) -> str:
    """A whole number of up to 18 digits in words, written together."""
    if n == 0:
        return "sıfır"
    out = []
    for k in range(len(POWERS) - 1, -1, -1):
        part = n // 1000**k % 1000
        if part:
            hundreds = ("" if part // 100 == 1 else UNITS[part // 100]) + "yüz" if part >= 100 else ""
            words = hundreds + TENS[part // 10 % 10] + UNITS[part % 10]
            out.append(("" if k == 1 and part == 1 else words) + POWERS[k])
    return "".join(out)


_VALUES = sorted([*((w, i, "unit") for i, w in enumerate(UNITS) if w), *((w, 10 * i, "ten") for i, w in enumerate(TENS) if w), ("yüz", 100, "hundred"), *((w, 1000**i, "power") for i, w in enumerate(POWERS) if w), ("sıfır", 0, "unit")], key=lambda x: -len(x[0]))


def words_number(text: str) -> int | None:
    """The whole number that words say, longest match first; None for anything else."""
    rest, total, part, seen = re.sub(r"[\s-]+", "", text.translate(LOWER).lower()), 0, 0, False
    while rest:
        found = next((v for v in _VALUES if rest.startswith(v[0])), None)
        if found is None:
            return None
        word, value, kind = found
        rest, seen = rest[len(word) :], True
        if kind == "hundred":
            part = max(1, part) * 100
        elif kind == "power":
            total, part = total + max(1, part) * value, 0
        else:
            part += value
    return total + part if seen else None


AMOUNT_WORDS = re.compile(r"(\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?|\d+(?:,\d{1,2})?)\s*(?:TL|TRY|₺)?\s*\(\s*([^)]{3,160}?)\s*\)")
_MONEY = re.compile("|".join(map(re.escape, ("türk lirası", "lira", "tl"))))


def amount_mismatches(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, digits and words of amounts whose digits and words disagree."""
    for m in AMOUNT_WORDS.finditer(text):
        said = words_number(_MONEY.sub("", m[2].translate(LOWER).lower()))
        if said is not None and said != int(m[1].split(",")[0].replace(".", "")):
            yield m.start(), m.end(), m[1], m[2]


VOWELS, BACK, ROUND = "aeıioöuü", "aıou", "oöuü"
SOFT = {"p": "b", "ç": "c", "t": "d", "k": "ğ"}


def harmony(stem: str) -> tuple[str, str]:
    """The low and the high vowel that a suffix takes after a stem."""
    last = next((c for c in reversed(stem) if c in VOWELS), "a")
    return ("a" if last in BACK else "e"), {(True, False): "ı", (False, False): "i", (True, True): "u", (False, True): "ü"}[(last in BACK, last in ROUND)]


def inflections(stem: str) -> dict[str, str]:
    """Forms of a noun by feature: number, possession and case with vowel harmony and softening."""
    out = {}
    for number in ("", "plural"):
        s1 = stem + ("l" + harmony(stem)[0] + "r" if number else "")
        for owner, (after_c, after_v) in {"": ("", ""), "1": ("Im", "m"), "2": ("In", "n"), "3": ("I", "sI"), "1p": ("ImIz", "mIz"), "2p": ("InIz", "nIz"), "3p": ("lArI", "lArI")}.items():
            if owner == "3p" and number:
                after_c = after_v = "I"
            s2 = attach(s1, after_v if s1[-1] in VOWELS else after_c)
            inner = "n" if owner in ("3", "3p") else ""
            for case, (c, v) in {"nom": ("", ""), "acc": ("I", "yI"), "dat": ("A", "yA"), "loc": ("DA", "DA"), "abl": ("DAn", "DAn"), "gen": ("In", "nIn"), "ins": ("lA", "ylA")}.items():
                suffix = v if s2[-1] in VOWELS else c
                if inner and case != "nom" and case != "ins":
                    suffix = inner + {"acc": "I", "dat": "A", "loc": "DA", "abl": "DAn", "gen": "In"}[case]
                out["+".join(x for x in (number, owner, case) if x)] = attach(s2, suffix)
    return out


def attach(stem: str, suffix: str) -> str:
    if suffix and suffix[0] in "IA" and stem[-1] in SOFT and len(stem) > 3:
        stem = stem[:-1] + SOFT[stem[-1]]
    for c in suffix:
        low, high = harmony(stem)
        stem += {"I": high, "A": low, "D": "t" if stem[-1] in "çfhkpsşt" else "d"}.get(c, c)
    return stem


def transfer(wrong: str, right: str, word: str) -> tuple[str, str | None]:
    """safe, ambiguous or none, and the form of right that word is of wrong."""
    forms = {k for k, v in inflections(wrong).items() if v == word}
    made = {inflections(right)[k] for k in forms}
    return ("none", None) if not made else ("safe", made.pop()) if len(made) == 1 else ("ambiguous", None)


SENTENCE_END = re.compile(r"[.!?]+[”\"')\]]*(?=\s|$)")


def sentences(text: str, abbreviations: Sequence[str] = TURKISH.abbreviations) -> list[tuple[int, int]]:
    """Spans of sentences. Dots of abbreviations, single capitals and ordinals end none; closing marks belong to the sentence."""
    out, start = [], 0
    for m in SENTENCE_END.finditer(text):
        word = re.search(r"[^\W_]+$", text[: m.start()])
        w = word[0] if word else ""
        follows = text[m.end() :].lstrip()[:1]
        if m[0].startswith(".") and len(m[0]) == 1 and (w.lower() in abbreviations or (len(w) == 1 and w.isupper()) or (w.isdigit() and follows.islower())):
            continue
        if text[start : m.end()].strip():
            begin = start + len(text[start : m.end()]) - len(text[start : m.end()].lstrip())
            out.append((begin, m.end()))
        start = m.end()
    if text[start:].strip():
        out.append((start + len(text[start:]) - len(text[start:].lstrip()), len(text.rstrip())))
    return out


OPENING, CLOSING = "([{", ")]}"


def unmatched_brackets(text: str) -> list[int]:
    """Places of brackets without partner, by a stack."""
    stack, out = [], []
    for i, c in enumerate(text):
        if c in OPENING:
            stack.append((c, i))
        elif c in CLOSING:
            if stack and OPENING.index(stack[-1][0]) == CLOSING.index(c):
                stack.pop()
            else:
                out.append(i)
    return sorted(out + [i for _, i in stack])
