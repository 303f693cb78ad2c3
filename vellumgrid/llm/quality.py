"""Quality rules: base counts of a text, and how far its character classes and common words diverge from its language.

Every text gets two histograms: shares of its characters by class, and shares of its words over the common words of all
languages (one more bin takes the rest). The same histograms summed over all texts of a language are the language's
references. A text is rejected if it fails a base rule, if the Jensen-Shannon distance of its character histogram from its
language's is above a limit, or if that of its words is: the limit for words is a share of the distance that a text without
any common word has from the reference (so word salad, and a text in another language, is above it, however large or small
the share of common words in the language is). Short texts have noisy histograms: one with fewer than the guard's characters,
or of a length at which the language has fewer than the guard's common words, rejects nothing. Every language with LEAST_TEXTS texts or more has references; texts of a language with
fewer are judged by the base rules only. A text without a language is held against every reference and judged by the
nearest; without any reference only the base rules judge.

All of it is per-row expressions over one array of words: texts are never shuffled nor written to intermediate tables.
Two passes read them for the references (short words by language, characters by language; both aggregated before the
shuffle), one judges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.llm.common import WS, WS_CHARS, materialize, retain, scratch, words

#: Common words taken from each language, of this length at most; texts that a language with references has, at least.
COMMON, WORD_LENGTH, LEAST_TEXTS = 12, 4, 20
#: Character classes, none of which shares a character with another; what is in none of them is the last bin.
CLASSES = (r"\p{Ll}+", r"\p{Lu}+", r"\p{Nd}+", r"[#*$%&|<>]+")
CHAR_BINS = len(CLASSES) + 2
#: Bins of the symbols and of the blanks.
SYMBOLS, BLANKS = 3, 4
#: A common word's slot in a text is written as one character from here on.
SLOT = 0x4E00


def slot_char(i: int) -> str:
    """The character of a slot; surrogates are left out."""
    return chr(SLOT + i + (0x800 if SLOT + i >= 0xD800 else 0))


@dataclass(frozen=True)
class Limits:
    least_words: int = 50
    most_repeat_percent: int = 50
    char_distance: float = 0.30
    #: Share of the distance that a text without common words has.
    word_ratio: float = 0.80
    guard_chars: int = 200
    #: Common words that a text of its length has by the reference, at least.
    guard_common: float = 13.0


def repeat_words(n: str, h: str) -> list[dict[str, str]]:
    """Stages of SQL for the words covered by three-word windows that occur twice or more; h is the array of window hashes.

    Each stage is used more than once by the next, which keeps the optimizer from evaluating it for every element."""
    return [
        {"_s": f"CASE WHEN size({h}) = size(array_distinct({h})) THEN NULL ELSE sort_array(transform({h}, (x, i) -> struct(x AS h, i AS p))) END"},
        {
            "_p": "CASE WHEN _s IS NULL THEN NULL ELSE sort_array(transform(filter(sequence(0, size(_s) - 1), j -> "
            "(j > 0 AND _s[greatest(j - 1, 0)].h = _s[j].h) OR (j < size(_s) - 1 AND _s[least(j + 1, size(_s) - 1)].h = _s[j].h)), j -> _s[j].p)) END"
        },
        {"n_repeat_words": "CASE WHEN _p IS NULL THEN 0L ELSE aggregate(sequence(0, size(_p) - 1), 0L, (a, j) -> a + CASE WHEN j = 0 THEN 3 ELSE least(3, _p[j] - _p[greatest(j - 1, 0)]) END) END"},
    ]


def split_words(df: DataFrame) -> DataFrame:
    """Adds _t (the text, never null) and _w (its words)."""
    return df.withColumn("_w", words(F.col("_text"))).withColumn("_t", F.coalesce(F.col("_text"), F.lit("")))


def base_counts(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to what split_words and char_classes add."""
    df = df.withColumn("n_words", F.size("_w").cast("bigint"))
    df = df.withColumn("word_chars", (F.length("_t") - F.col("_chars")[BLANKS]).cast("bigint")).withColumn("n_symbols", F.col("_chars")[SYMBOLS].cast("bigint"))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != ""))
    df = df.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"))
    df = df.withColumn("_h", F.expr("CASE WHEN size(_w) < 3 THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END"))
    for stage in repeat_words("n_words", "_h"):
        df = df.withColumns({k: F.expr(v) for k, v in stage.items()})
    # no filter is pushed below a generator: the stages would be put into each other, and evaluated for every element
    df = df.withColumn("_b", F.explode(F.array(F.struct("n_words", "n_repeat_words"))))
    return df.withColumns({"n_words": F.col("_b.n_words"), "n_repeat_words": F.col("_b.n_repeat_words")}).drop("_h", "_s", "_p", "_l", "_b")


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, w, n: how often each short word, in lower case, stands in all texts of a language."""
    word = docs.where("_lang IS NOT NULL").select(F.col("_lang").alias("lang"), F.explode(words(F.col("_text"))).alias("w"))
    word = word.where((F.length("w") <= WORD_LENGTH) & F.col("w").rlike(r"^\p{L}+$"))
    return word.groupBy("lang", F.lower("w").alias("w")).agg(F.count("*").alias("n"))


def language_totals(docs: DataFrame) -> DataFrame:
    """lang, words and c (characters by class) summed over all texts of the languages with LEAST_TEXTS texts or more."""
    known = char_classes(split_words(docs.where("_lang IS NOT NULL")))
    sums = F.array(*[F.sum(F.col("_chars")[i].cast("bigint")) for i in range(CHAR_BINS)])
    found = known.groupBy(F.col("_lang").alias("lang")).agg(F.count("*").alias("texts"), F.sum(F.size("_w").cast("bigint")).alias("words"), sums.alias("c"))
    return found.where(F.col("texts") >= LEAST_TEXTS).select("lang", "words", "c")


def common_words(counts: DataFrame, totals: DataFrame) -> list[str]:
    """The union over the languages of totals of their COMMON most frequent short words."""
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
    best = counts.withColumn("r", F.row_number().over(top)).where(F.col("r") <= COMMON).join(totals.select("lang"), "lang", "left_semi")
    return sorted({r["w"] for r in best.select("w").collect()})


def references(counts: DataFrame, totals: DataFrame, common: list[str]) -> DataFrame:
    """lang, c and w (shares of the character classes and of the slots), far (the distance from w of a text without common
    words; null if the language has none) of the languages of totals; and a row without lang whose column every holds all."""
    slots = counts.where(F.col("w").isin(common)).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("m"))
    found = F.transform(F.array(*map(F.lit, common)) if common else F.array().cast("array<string>"), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("bigint")))
    refs = totals.join(slots, "lang", "left").withColumn("found", found)
    rest = F.col("words") - F.aggregate("found", F.lit(0).cast("bigint"), lambda a, x: a + x)
    refs = refs.select("lang", shares(F.col("c")).alias("c"), shares(F.concat("found", F.array(rest))).alias("w"))
    q = F.element_at("w", -1)
    far = F.sqrt(0.5 * (F.log2(2 / (1 + q)) + F.when(q > 0, q * F.log2(2 * q / (1 + q))).otherwise(F.lit(0.0)) + 1 - q))
    refs = refs.withColumn("far", F.when(q < 1, far))
    every = refs.agg(F.lit(None).cast(refs.schema["lang"].dataType).alias("lang"), F.collect_list(F.struct("c", "w", "far")).alias("every"))
    return refs.unionByName(every, allowMissingColumns=True)


def char_classes(df: DataFrame) -> DataFrame:
    """Adds _chars, the number of characters by class. Needs what split_words adds.

    Each class is taken out of what the ones before it left: all but the first read a small part of the text."""
    rest = ["_t", *[f"_rest{i}" for i in range(len(CLASSES) + 1)]]
    for i, c in enumerate((*CLASSES, WS)):
        df = df.withColumn(rest[i + 1], F.regexp_replace(rest[i], c, ""))
    counts = [F.length(a) - F.length(b) for a, b in zip(rest[:-1], rest[1:], strict=True)]
    return df.withColumn("_chars", F.array(*counts, F.length(rest[-1]))).drop(*rest[1:])


def common_slots(df: DataFrame, common: list[str]) -> DataFrame:
    """Adds _common, the slots that occur with their counts (the last slot takes the rest): its size follows the text, not the
    number of languages. Needs what base_counts adds."""
    hit = F.lit("")
    if common:
        slots = F.create_map(*[x for i, w in enumerate(common) for x in (F.lit(w), F.lit(slot_char(i)))])
        hit = F.array_join(F.transform("_w", lambda w: F.when(F.length(w) <= WORD_LENGTH, F.try_element_at(slots, F.lower(w)))), "")
    df = df.withColumn("_hit", hit)
    df = df.withColumn("_seen", F.when(F.col("_hit") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split("_hit", ""))))
    slot = lambda c: F.ascii(c) - SLOT - F.when(F.ascii(c) >= 0xD800, F.lit(0x800)).otherwise(F.lit(0))
    counts = F.transform("_seen", lambda c: F.struct(slot(c).alias("slot"), (F.length("_hit") - F.length(F.replace("_hit", c, F.lit("")))).alias("n")))
    rest = F.struct(F.lit(len(common)).alias("slot"), (F.col("n_words").cast("int") - F.length("_hit")).alias("n"))
    return df.withColumn("_common", F.concat(counts, F.array(rest))).drop("_hit", "_seen")


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence to base 2: 0 for equal histograms, 1 for disjoint ones."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: 0.5 * (term(a, b) + term(b, a)))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def sparse_js_distance(p: Column, q: Column) -> Column:
    """js_distance of a histogram given as slots with their shares from the array of all shares of another one."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    at = lambda x: F.get(q, x["slot"])
    both = F.aggregate(p, F.lit(0.0), lambda s, x: s + term(x["share"], at(x)) + term(at(x), x["share"]))
    only = 1.0 - F.aggregate(p, F.lit(0.0), lambda s, x: s + at(x))  # a slot of the other alone counts once its share
    return F.sqrt(F.greatest(F.lit(0.0), 0.5 * (both + only)))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", limits: Limits = Limits(), keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (all of docs by default) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
    word_distance, word_ratio (that distance by the distance of a text without common words) and kept; columns of docs with
    these names are replaced.

    Null and blank texts have no words and fail the base rules. A distance is null where its guard or a missing reference
    leaves it out. Repeated rows are judged alike; an empty table gives an empty result."""
    keep = [c for c in (docs.columns if keep is None else keep)]
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "word_ratio", "kept"]
    own = docs.select(F.struct(*keep).alias("_row"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    with scratch(docs.sparkSession):
        counts = materialize(word_counts(own), "word_counts")
        totals = materialize(language_totals(own), "totals", rows=1)
        common = common_words(counts, totals)
        refs = retain(materialize(references(counts, totals, common), "references", rows=1))
    judged = common_slots(base_counts(char_classes(split_words(own))), common)
    total = F.col("n_words").cast("double")
    judged = judged.withColumn("_n", F.aggregate("_chars", F.lit(0).cast("bigint"), lambda a, x: a + x)).withColumn("_p", shares(F.col("_chars")))
    judged = judged.withColumn("_q", F.transform("_common", lambda x: F.struct(x["slot"].alias("slot"), F.when(total > 0, x["n"] / total).otherwise(F.lit(0.0)).alias("share"))))
    # one reference a language: a row for each distinct value of lang that is common enough
    judged = judged.join(F.broadcast(refs), F.col("_lang").eqNullSafe(F.col("lang")), "left")
    chars = F.col("_n") >= limits.guard_chars
    by_char = lambda r: js_distance(F.col("_p"), r["c"])
    by_word = lambda r: F.when(total * (1 - F.element_at(r["w"], -1)) >= limits.guard_common, sparse_js_distance(F.col("_q"), r["w"]))
    own_ref = F.struct("c", "w", "far")
    judged = judged.withColumn("char_distance", F.when(chars, F.when(F.col("_lang").isNull(), F.array_min(F.transform("every", by_char))).when(F.col("c").isNotNull(), by_char(own_ref))))
    judged = judged.withColumn("word_distance", F.when(F.col("_lang").isNull(), F.array_min(F.transform("every", by_word))).when(F.col("w").isNotNull(), by_word(own_ref)))
    ratio = F.when(F.col("_lang").isNull(), F.array_min(F.transform("every", lambda r: by_word(r) / r["far"]))).otherwise(F.col("word_distance") / F.col("far"))
    judged = judged.withColumn("word_ratio", ratio)
    failed = (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.most_repeat_percent * F.col("n_words"))
    far = F.coalesce(F.col("char_distance") > limits.char_distance, F.lit(False)) | F.coalesce(F.col("word_ratio") > limits.word_ratio, F.lit(False))
    judged = judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)
    return judged.select(*[F.col("_row")[c].alias(c) for c in keep if c not in made], *made)
