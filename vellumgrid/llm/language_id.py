"""Language identification with hyperdimensional profiles.

Every letter has a random vector of DIMS signs. A trigram's vector binds (multiplies) its letters' vectors, the first
rotated twice, the second once; a text's vector bundles (adds) those of its trigrams, word boundaries included. The
prototype of a language bundles the trigrams of a sample of its texts. A text gets the language whose prototype has the
greatest cosine with the text's vector, the first by name on a tie.

Letters are lower-cased; what is no letter is a boundary. Letters are kept apart by SYMBOLS classes of their code points,
so alphabets beyond that share vectors. The sample takes texts by a hash of their id, about SAMPLE of each language.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs of a vector; letter classes; texts sampled for each language, about.
DIMS, SYMBOLS, SAMPLE = 1024, 509, 1500
#: Trigrams whose vectors are made at once.
STEP = 4096
UNKNOWN = "und"


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Of each code point, the class of the lower-cased letter, from 1; 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint16)
    for i in range(sys.maxunicode + 1):
        if (c := chr(i)).isalpha():
            out[i] = 1 + ord(c.lower()[0]) % SYMBOLS
    return out


@lru_cache(maxsize=1)
def letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors rotated twice, once and not at all; the boundary is letter 0."""
    base = np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (SYMBOLS + 1, DIMS))
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct trigrams, as numbers to base SYMBOLS + 1, and their counts; None for a text without a letter."""
    codes = symbol_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letters = codes > 0
    if not letters.any():
        return None
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # one boundary after each run of letters
    codes = np.concatenate([[0], codes[keep], [0]]).astype(np.int64)
    n = SYMBOLS + 1
    return np.unique(codes[:-2] * n * n + codes[1:-1] * n + codes[2:], return_counts=True)


def bundle(trigrams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the trigrams' vectors, counted."""
    first, second, third = letter_vectors()
    n = SYMBOLS + 1
    out = np.zeros(DIMS, np.float64)
    for i in range(0, len(trigrams), STEP):
        t = trigrams[i : i + STEP]
        bound = first[t // (n * n)] * second[t // n % n] * third[t % n]
        out += counts[i : i + STEP].astype(np.float32) @ bound.astype(np.float32)
    return out


class Vectors:
    """Vectors of trigrams, made once and kept in one table that starts anew when it is full."""

    FULL = 12_000

    def __init__(self) -> None:
        self.table = np.empty((self.FULL, DIMS), np.float32)
        self.slot: dict[int, int] = {}

    def bundle(self, trigrams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if len(trigrams) > self.FULL // 4:
            return bundle(trigrams, counts)
        keys = trigrams.tolist()
        slots = [self.slot.get(k, -1) for k in keys]
        if -1 in slots:
            new = [k for k, s in zip(keys, slots, strict=True) if s < 0]
            if len(self.slot) + len(new) > self.FULL:
                self.slot.clear()
                new = keys
            first, second, third = letter_vectors()
            n, at, t = SYMBOLS + 1, len(self.slot), np.array(new)
            self.table[at : at + len(new)] = first[t // (n * n)] * second[t // n % n] * third[t % n]
            self.slot.update(zip(new, range(at, at + len(new)), strict=True))
            slots = [self.slot[k] for k in keys]
        return counts.astype(np.float32) @ self.table[slots]


@lru_cache(maxsize=1)
def vectors() -> Vectors:
    return Vectors()


def learn_prototypes(train: DataFrame, text: str, lang: str, id_col: str) -> dict[str, np.ndarray]:
    """Unit vectors by language, from the rows of train; DIMS numbers for each value of lang come to the driver."""
    train = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = train.groupBy(F.col(lang).alias("lang")).count().orderBy("lang").collect()
    if not sizes:
        return {}
    rate = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, SAMPLE / r["count"])))])
    draw = F.pmod(F.xxhash64(F.lit(11), F.col(id_col), F.length(text)), F.lit(1 << 20)) / float(1 << 20)
    sample = train.where(draw < F.try_element_at(rate, F.col(lang))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if made := trigram_counts(t):
                    v = vectors().bundle(*made)
                    found[name] = found.get(name, 0) + v / max(1e-9, np.linalg.norm(v))
        if found:
            yield pa.record_batch([pa.array(list(found)), pa.array([v.tolist() for v in found.values()])], ["lang", "v"])

    parts = sample.mapInArrow(sums, "lang string, v array<double>")
    total = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    out = {}
    for r in total.collect():
        v = np.array([p["x"] for p in r["v"]])
        out[r["lang"]] = v / max(1e-9, np.linalg.norm(v))
    return out


def identify_language(docs: DataFrame, train_rows: Column, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """One row a row of docs: id, lang_pred and score (the cosine with the prototype, 0 at least).

    Learns from the rows of docs for which train_rows holds. Null texts and texts without a letter are "und" with score 0,
    and so are all texts if there is nothing to learn from. Repeated rows and null ids stay; an empty table gives an empty result."""
    learned = learn_prototypes(docs.where(train_rows), text, lang, id_col)
    names = sorted(learned)
    matrix = np.array([learned[n] for n in names], np.float32).reshape(len(names), DIMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores = [], []
            for t in batch.column(1).to_pylist():
                made = trigram_counts(t) if t and names else None
                if made is None:
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                v = vectors().bundle(*made)
                cosines = matrix @ v.astype(np.float32) / max(1e-9, float(np.linalg.norm(v)))
                best = int(np.argmax(cosines))
                preds.append(names[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.record_batch([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    ids = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {ids}, lang_pred string, score double")
    return made.withColumnRenamed("id", id_col)
