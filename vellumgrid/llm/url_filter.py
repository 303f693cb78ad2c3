"""URL filters: exact membership in rule lists by a cascade of Bloom filters, without a join on the pages.

A rule is (host, path, verdict). It fits a url when the url's host equals the rule's or ends with "." and the rule's,
and the url's path starts with the rule's. The longest fitting rule (characters of host and path together; the longer
host on a tie) decides; a url that no rule fits is allowed.

Every url yields its probe keys: each suffix of its host by whole labels, with each prefix of its path that has the
length of some rule's path. A rule fits a url exactly if its key is among them. The keys of all pages are the cascade's
universe: level 1 encodes the listed keys, level 2 the keys of the universe that level 1 takes by mistake, level 3 the
listed keys that level 2 takes, and so on until none is left. For every key of the universe the first level that rejects
it tells the truth, so no exact list is needed afterwards.

Level 1 is given as many bits a key as keep the expected mistakes under MISTAKES whatever the number of pages: its size
is in proportion to the list and to the logarithm of the corpus, and the levels behind it are smaller still. Those bits
travel as literals of the plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm.common import ascii_lower, materialize, scratch

Rule = tuple[str, str, str]
#: Expected number of keys that level 1 takes by mistake, at most.
MISTAKES = 4096
#: Mistakes that a level takes, as a power of two, at least: small corpora keep a cascade of more than one level.
LEAST_BITS, MOST_BITS = 6, 48
#: Probes that a page has, for sizing only.
PROBES = 16


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: tuple[int, ...]

    def has(self, key: Column) -> Column:
        table = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # one literal, folded once
        found = None
        for p in positions(key, self.bits, self.hashes, self.seed):
            word = F.element_at(table, (F.shiftright(p, 6) + 1).cast("int"))
            bit = word.bitwiseAND(one_bit(p)) != 0
            found = bit if found is None else found & bit
        return found


def one_bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (position % 64).cast("int"))


def positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed * 64 + i), key), F.lit(bits).cast("bigint")) for i in range(hashes)]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without "://"."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def probe_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Array of (size, host_size, key), one for each rule key that could fit."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))

    def keys(suffix: Column) -> Column:
        made = [
            F.when(F.length(path) >= n, F.struct((F.length(suffix) + n).alias("size"), F.length(suffix).alias("host_size"), F.concat(suffix, F.substring(path, 1, n)).alias("key")))
            for n in lengths
        ]
        return F.array(*made)

    return F.filter(F.flatten(F.transform(suffixes, keys)), lambda x: x.isNotNull())


def build_level(keys: DataFrame, hashes: int, seed: int) -> Level | None:
    """A Bloom filter of the distinct keys of a DataFrame (column key); None without keys. Its words come to the driver:
    keys is a rule list, or mistakes of which MISTAKES are expected."""
    n = keys.count()
    if not n:
        return None
    bits = 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))
    spots = keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, seed))).alias("p"))
    rows = spots.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one_bit(F.col("p"))).alias("v")).collect()
    table = [0] * (bits // 64)
    for r in rows:
        table[r["w"]] = r["v"]
    return Level(bits, hashes, seed, tuple(table))


def member(levels: Sequence[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the first level that rejects it decides by its parity."""
    verdict = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        verdict = F.when(levels[i].has(key), verdict).otherwise(F.lit(i % 2 == 1))
    return verdict


def rules_table(spark: SparkSession, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """key, verdict and the length of the path; rules with a null in any column are left out."""
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string, verdict string")
    return table.dropna(subset=["host", "path", "verdict"]).select(F.concat("host", "path").alias("key"), "verdict", F.length("path").alias("length"))


def build_cascades(pages: DataFrame, listed: DataFrame, verdicts: Sequence[str], lengths: Sequence[int], url: str) -> dict[str, list[Level]]:
    """Per verdict the cascade that tells the keys of its rules from all other keys of the pages."""
    n = max(1, pages.count() * PROBES)
    hashes = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(n / MISTAKES)) if n > MISTAKES else 0))
    first = {v: build_level(listed.where(F.col("verdict") == v).select("key").distinct(), hashes, 0) for v in verdicts}
    host, path = url_parts(F.col(url))
    universe = pages.select(host.alias("host"), path.alias("path")).select(F.explode(probe_keys(F.col("host"), F.col("path"), lengths)).alias("probe")).select("probe.key")
    taken = None
    for level in first.values():
        taken = level.has(F.col("key")) if taken is None else taken | level.has(F.col("key"))
    taken = materialize(universe.where(taken).distinct(), "taken")
    cascades = {}
    for v, level in first.items():
        levels, own = [level], listed.where(F.col("verdict") == v).select("key").distinct()
        sides = [taken.join(own, "key", "left_anti").where(level.has(F.col("key"))), own]
        while level := build_level(sides[0], 2, len(levels)):
            levels.append(level)
            sides = [sides[1].where(level.has(F.col("key"))), sides[0]]
        cascades[v] = levels
    return cascades


def filter_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, url: str = "url") -> DataFrame:
    """rules: triples, or a table with the columns host, path and verdict, of which only filter bits come to the driver.

    pages with host, path, rule and verdict ("allow" or "block") added; columns of these names are replaced.

    Null urls and urls without "://" have an empty host and path, no rule, and are allowed. Without rules, all are
    allowed. A key listed under both verdicts is blocked. Repeated rows stay repeated."""
    host, path = url_parts(F.col(url))
    split = pages.withColumns({"host": host, "path": path})
    with scratch(pages.sparkSession):
        listed = rules_table(pages.sparkSession, rules)
        kinds = listed.groupBy("length", "verdict").count().collect()  # distinct lengths of paths
        if not kinds:
            return split.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
        lengths = sorted({r["length"] for r in kinds})
        cascades = build_cascades(pages, listed, sorted({r["verdict"] for r in kinds}), lengths, url)
    block, allow = cascades.get("block", []), cascades.get("allow", [])
    hit = lambda levels, key: member(levels, key) if levels else F.lit(False)
    judged = F.transform(
        probe_keys(F.col("host"), F.col("path"), lengths),
        lambda x: F.struct(x["size"].alias("size"), x["host_size"].alias("host_size"), x["key"].alias("key"), F.when(hit(block, x["key"]), F.lit("block")).when(hit(allow, x["key"]), F.lit("allow")).alias("verdict")),
    )
    best = F.array_max(F.filter(judged, lambda x: x["verdict"].isNotNull()))
    own = "_best" + "_" * max(map(len, split.columns))  # no column of pages has this name
    return split.withColumn(own, best).withColumns({"rule": F.col(own)["key"], "verdict": F.coalesce(F.col(own)["verdict"], F.lit("allow"))}).drop(own)
