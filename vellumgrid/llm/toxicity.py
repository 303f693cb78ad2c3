"""Toxicity scores from a learned lexicon whose terms are also found misspelt, and from the context of each find.

Learning takes a bounded sample of labelled rows (at most SAMPLE toxic and SAMPLE clean ones, by a hash of their id). A
lower-cased word becomes a term if its share of toxic texts is at least RATIO times its share of clean ones, in LEAST_SHARE
of the toxic texts or more; so do stems, the first STEMS letters of longer words, which find inflected forms
(at twice the ratio, in STEM_SHARE of the toxic texts and STEM_TEXTS of them). The terms form a trie. Every other word of a text is compared with all terms at once: the
states of the word's Levenshtein automaton (EDITS edits, for terms of FUZZY_LENGTH letters or more) are stepped along the
trie, so a branch is left as soon as no state survives. Signs inside a word ("sc*m") stand for any letter.

A find is scored by its window of WINDOW words on each side: quotation marks that open before and close after it, and
words of report, make it a quotation. A text's features are its finds as abuse, as quotation and by misspelling, in number
and rate; a logistic regression over the sample turns them into a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm.common import materialize, scratch

#: Labelled rows of each label to learn from; terms of the lexicon, at most.
SAMPLE, TERMS = 10_000, 4_000
RATIO, LEAST_SHARE, LEAST_TEXTS = 20.0, 0.01, 3
#: Lengths of stems; a stem is written with STEM behind it.
STEMS, STEM = (4, 5, 6), "*"
STEM_SHARE, STEM_TEXTS = 0.02, 8
EDITS, FUZZY_LENGTH, WINDOW = 1, 5, 6
#: Words remembered by a worker, and the length of the longest of these.
CACHE, CACHED_LENGTH = 300_000, 40
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’‚‹›…–—¿¡"
OPEN, CLOSE = frozenset("\"'«“„‘‚‹"), frozenset("\"'»”“’‘›«")
#: Words that report speech.
REPORT = frozenset("said says say wrote writes called calls quote quoted quotes word term slur insult dit écrit mot sagte schrieb wort dijo escribió palabra".split())
FEATURES = 6


class Trie:
    def __init__(self, terms: list[str]) -> None:
        self.root: dict = {}
        self.stems = {t[:-1]: i for i, t in enumerate(terms) if t[-1] == STEM}
        self.stem_sizes = sorted({len(t) for t in self.stems}, reverse=True)
        for i, term in enumerate(terms):
            if term[-1] == STEM:
                continue
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = i
        self.exact = {t: i for i, t in enumerate(terms)}
        fuzzy = [t for t in terms if len(t) >= FUZZY_LENGTH and t[-1] != STEM]
        # One edit leaves the first or the second half of a term intact, at its end of the word.
        self.heads, self.tails = {t[: len(t) // 2] for t in fuzzy}, {t[len(t) // 2 :] for t in fuzzy}
        self.head_sizes, self.tail_sizes = sorted({len(h) for h in self.heads}), sorted({len(t) for t in self.tails})
        self.least = min(map(len, fuzzy), default=1 << 30) - EDITS

    def find(self, word: str) -> tuple[int, int] | None:
        """The least (edits, term) of the terms that a word matches."""
        if (i := self.exact.get(word)) is not None:
            return 0, i
        for n in self.stem_sizes:
            if len(word) > n and (i := self.stems.get(word[:n])) is not None:
                return 0, i
        if word.isalpha():
            if len(word) < self.least or not (any(word[:n] in self.heads for n in self.head_sizes) or any(word[-n:] in self.tails for n in self.tail_sizes)):
                return None
        elif not any(map(str.isalpha, word)):
            return None
        return self.intersect(word, EDITS)

    def intersect(self, word: str, edits: int) -> tuple[int, int] | None:
        """Steps the automaton of word along the trie. A state (i, e): i characters of the word read, e edits made."""
        n, best = len(word), None

        def closed(states: dict[int, int]) -> dict[int, int]:
            for i in range(n):  # an extra character in the word
                if (e := states.get(i)) is not None and e < edits and states.get(i + 1, edits + 1) > e + 1:
                    states[i + 1] = e + 1
            return states

        stack = [(self.root, closed({0: 0}), 0)]
        while stack:
            node, states, depth = stack.pop()
            if "" in node and (e := states.get(n)) is not None:
                found = (max(e, 1), node[""])
                if (depth >= FUZZY_LENGTH or e == 0) and (best is None or found < best):
                    best = found
            for c, child in node.items():
                if c == "":
                    continue
                step: dict[int, int] = {}
                for i, e in states.items():
                    if i < n and (word[i] == c or not word[i].isalnum()):
                        if step.get(i + 1, edits + 1) > e:
                            step[i + 1] = e
                    elif e < edits:
                        if i < n and step.get(i + 1, edits + 1) > e + 1:  # another letter
                            step[i + 1] = e + 1
                    if e < edits and step.get(i, edits + 1) > e + 1:  # a letter of the term left out
                        step[i] = e + 1
                if step:
                    stack.append((child, closed(step), depth + 1))
        return best


class Scanner(dict):
    """Word to its match, or 0; made on first sight."""

    def __init__(self, terms: tuple[str, ...]) -> None:
        super().__init__()
        self.trie, self.missed = Trie(list(terms)), 0

    def __missing__(self, raw: str) -> tuple[int, int] | int:
        found = self.trie.find(raw.strip(EDGES)) or 0
        if len(raw) <= CACHED_LENGTH:
            if len(self) < CACHE:
                self[raw] = found
            elif self.missed < 4 * CACHE:
                self.missed += 1
            else:
                self.clear()
                self.missed = 0
        return found

    def features(self, text: str, weights: np.ndarray) -> list[float]:
        words = text.lower().split()
        hits = [(i, h) for i, h in enumerate(map(self.__getitem__, words)) if h]
        if not hits:
            return [0.0] * FEATURES
        abuse = quoted = fuzzy = 0.0
        terms = set()
        for i, (edits, term) in hits:
            w = float(weights[term])
            q = quotation(words, i)
            if edits:
                fuzzy += w * (1 - q)
            else:
                abuse += w * (1 - q)
            quoted += w * q
            terms.add(term)
        per = 100.0 / max(20, len(words))
        return [math.log1p(abuse), math.log1p(quoted), math.log1p(fuzzy), abuse * per, fuzzy * per, math.log1p(len(terms))]


def quotation(words: list[str], i: int) -> float:
    """0 to 1: how far the window around word i quotes it."""
    before, after = words[max(0, i - WINDOW) : i + 1], words[i : i + WINDOW + 1]
    opened = any(w[0] in OPEN for w in before)
    closed = any(w.rstrip(".,;:!?")[-1:] in CLOSE for w in after)
    report = any(w.strip(EDGES) in REPORT for w in before[:-1] + after[1:])
    return 0.75 * (opened and closed) + 0.25 * report


@lru_cache(maxsize=2)
def scanner(terms: tuple[str, ...]) -> Scanner:
    return Scanner(terms)


def labelled_sample(docs: DataFrame, labels: DataFrame, train_rows: Column, text: str, id_col: str, label: str) -> DataFrame:
    """y and text of the rows to learn from, one an id (the least text of those that share it): 2 * SAMPLE rows at most, which
    is also the bound of the labels' side, and so broadcast."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(train_rows & F.col("id").isNotNull() & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit(5), "id")
    picked = own.where("y = 1").orderBy(order, "id").limit(SAMPLE).unionByName(own.where("y = 0").orderBy(order, "id").limit(SAMPLE))
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(picked), "id").groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text")).select("y", "text")


def learn_lexicon(sample: DataFrame, totals: dict[int, int]) -> tuple[tuple[str, ...], np.ndarray]:
    """Terms and their log ratios."""

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, ws = [], []
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {w for raw in set(t.lower().split()) if 3 <= len(w := raw.strip(EDGES)) <= CACHED_LENGTH and w.isalpha()}
                own |= {w[:n] + STEM for w in own for n in STEMS if len(w) > n}
                ys += [y] * len(own)
                ws += own
            yield pa.record_batch([pa.array(ys, pa.int32()), pa.array(ws, pa.string())], ["y", "w"])

    least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * totals[1]))
    counts = sample.mapInArrow(words_of, "y int, w string").groupBy("w").agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0")).where(F.col("n1") >= least)
    ratio = ((F.col("n1") + 0.5) / (totals[1] + 1)) / ((F.col("n0") + 0.5) / (totals[0] + 1))
    floor = min(RATIO, 0.5 * (totals[0] + 1) / (totals[1] + 1) * 2 * LEAST_TEXTS)  # few clean texts can't show a larger ratio
    stem = F.col("w").endswith(STEM)
    good = (~stem & (F.col("r") >= floor)) | (stem & (F.col("r") >= 2 * RATIO) & (F.col("n1") >= max(STEM_TEXTS, math.ceil(STEM_SHARE * totals[1]))))
    rows = counts.withColumn("r", ratio).where(good).orderBy(F.desc("n1"), "w").limit(TERMS).collect()
    rows.sort(key=lambda r: r["w"])
    return tuple(r["w"] for r in rows), np.array([math.log(r["r"]) for r in rows])


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights and intercept by Newton steps, both labels with half of the weight."""
    x = np.hstack([x, np.ones((len(x), 1))])
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (each * (p - y)) + ridge * w / 100
        hessian = (x * (each * p * (1 - p))[:, None]).T @ x + ridge / 100 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: Column, threshold: float = 0.3, text: str = "text", id_col: str = "doc_id", label: str = "toxic") -> DataFrame:
    """One row a row of docs: id, score (0 to 1) and predicted (1 if score >= threshold).

    train_rows: which ids (column id) may be learned from. Null and blank texts score as a text without finds. Without
    labels of both kinds nothing is learned and all score 0. A row labelled more than once has its greatest label.
    Repeated rows and null ids stay; an empty table gives an empty result."""
    with scratch(docs.sparkSession):
        terms, ratios, fitted = learn(materialize(labelled_sample(docs, labels, train_rows, text, id_col, label), "sample"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(terms)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            if fitted is not None and batch.num_rows:
                x = np.array([s.features(t or "", ratios) for t in batch.column(1).to_pylist()])
                scores = 1 / (1 + np.exp(-np.clip(x @ fitted[:-1] + fitted[-1], -30, 30)))
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    ids = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {ids}, score double")
    return made.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def learn(sample: DataFrame) -> tuple[tuple[str, ...], np.ndarray, np.ndarray | None]:
    """Terms, their log ratios, and the regression's weights (None without labels of both kinds)."""
    totals = {0: 0, 1: 0} | {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    terms, ratios, fitted = (), np.zeros(0), None
    if totals[0] and totals[1]:
        terms, ratios = learn_lexicon(sample, totals)

        def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = scanner(terms)
            for batch in batches:
                yield pa.record_batch([batch.column(0), pa.array([s.features(t, ratios) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["y", "x"])

        rows = sample.mapInArrow(featured, "y int, x array<double>").collect()
        rows.sort(key=lambda r: (r["y"], r["x"]))
        fitted = fit_logistic(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]))
    return terms, ratios, fitted
