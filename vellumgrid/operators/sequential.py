"""Operators whose steps depend on what was decided before: one group (a block, a pair, an exhibit) per Arrow-backed call."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.operators import versions as v
from vellumgrid.operators.relational import EDGES, PAGES, PAIRS
from vellumgrid.plans.dialect import ENGINE
from vellumgrid.sources import containers
from vellumgrid.sources.tables import corpus_blocks, load


def per_block(blocks: DataFrame, made, columns: str) -> DataFrame:
    """Rows that made(text) yields for each block, behind doc_id and block_index."""
    names = [c.strip().split()[0] for c in columns.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, b, *r) for d, b, t in zip(frame["doc_id"], frame["block_index"], frame["text"], strict=True) for r in made(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "block_index", *names])

    return blocks.select("doc_id", "block_index", "text").mapInPandas(run, f"doc_id bigint, block_index bigint, {columns}")


def p08_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_block(corpus_blocks(spark, sf_dir), v.sentences, "char_start bigint, char_end bigint")


def r11_bracket_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_block(corpus_blocks(spark, sf_dir).where(F.col("text").rlike(r"[()\[\]{}]")), lambda t: ((i, t[i]) for i in v.unmatched_brackets(t)), "place bigint, bracket string")


def r36_amount_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_block(corpus_blocks(spark, sf_dir).where(F.col("text").rlike(r"[0-9].*[(]")), v.amount_mismatches, "char_start bigint, char_end bigint, digits string, words string")


def r39_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inflected forms of the dictionary's misspellings: all forms are generated once, then joined by equality."""
    from vellumgrid.functions.language import TURKISH

    rows = [(form, wrong, *v.transfer(wrong, right, form)) for wrong, right in TURKISH.corrections for form in sorted(set(v.inflections(wrong).values())) if form != wrong]
    forms = F.broadcast(spark.createDataFrame(rows, "word string, wrong string, outcome string, replacement string"))
    tokens = corpus_blocks(spark, sf_dir).select("doc_id", "block_index", F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}'’]+)"))).alias("token"))
    return tokens.withColumn("word", F.lower(F.translate("token", "Iİ", "ıi"))).join(forms, "word").select("doc_id", "block_index", "token", "outcome", "replacement")


def m03_number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = spark.range(1, 5000).select(F.col("id"), (F.col("id") * F.col("id") * F.col("id") % 1000000007).alias("n"))

    def run(frames):
        for frame in frames:
            words = [v.number_words(int(n)) for n in frame["n"]]
            yield frame.assign(words=words, back=[v.words_number(w) for w in words])

    return numbers.mapInPandas(run, "id bigint, n bigint, words string, back bigint")


def m06_inflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(stem, k, form) for stem in ("kitap", "dava", "mahkeme", "karar", "söz", "gün") for k, form in v.inflections(stem).items()]
    return spark.createDataFrame(rows, "stem string, feature string, form string")


def m07_typed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("Süre 5 gün ve 12.03.2021", "Süre 7 gün ve 12.04.2021"), ("Bedel 1.250 TL", "Bedel 1.300 TL"), ("Süre 5 gün", "Süre 10 gün"), ("aynı", "aynı")]
    made = [(i, *c) for i, (a, b) in enumerate(rows) for c in v.typed_changes(a, b)]
    return spark.createDataFrame(made, "id bigint, kind string, before string, after string")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fixture pairs, and each document, of any number of blocks, against itself without every seventh block and with a word changed in every fifth."""
    fixture = spark.sql(ENGINE.values("x", "pair_id BIGINT, side string, place BIGINT, text string", PAIRS)[1])
    blocks = corpus_blocks(spark, sf_dir).where("doc_id >= 0").select((F.col("doc_id") + 1000).alias("pair_id"), F.col("block_index").alias("place"), "text")
    changed = blocks.where(F.col("place") % 7 != 6).withColumn("text", F.when(F.col("place") % 5 == 2, F.regexp_replace("text", r"^(\S+) (\S+)", "$1 changed")).otherwise(F.col("text")))
    side = lambda s: fixture.where(F.col("side") == s).select("pair_id", "place", "text")
    return side("base").unionByName(blocks), side("revised").unionByName(changed)


def d20_compare_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.compare_versions(*sides(spark, sf_dir))


def d07_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d20_compare_versions(spark, sf_dir).select("pair_id", "row_index", "base_place", "revised_place", "similarity")


def d13_word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d20_compare_versions(spark, sf_dir).where("kind = 'modified'").select("pair_id", "row_index", "fragments")


def d17_typed_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d20_compare_versions(spark, sf_dir).where("typed <> ''").select("pair_id", "row_index", "typed")


def d21_view_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by kind of each pair, and their share in hundredths of a percent."""
    rows = d20_compare_versions(spark, sf_dir).groupBy("pair_id", "kind").count()
    total = rows.groupBy("pair_id").agg(F.sum("count").alias("total"))
    return rows.join(total, "pair_id").select("pair_id", "kind", F.col("count").alias("n"), F.floor(F.col("count") * 10000 / F.col("total")).alias("share"))


def k04_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON and one Markdown report of each pair."""
    rows = d20_compare_versions(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("row_index", "kind", "fragments")))
    return rows.groupBy("pair_id").agg(ordered.alias("r")).select("pair_id", F.to_json("r").alias("json"), F.array_join(F.transform("r", lambda x: F.concat(F.lit("- **"), x["kind"], F.lit("** "), x["fragments"])), "\n").alias("markdown"))


def s03_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.read_packages(containers.sample_packages(spark))


def s04_style_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                if path.endswith("ornek.docx"):
                    rows += [(path, k, x.get("font"), x.get("size")) for k, x in containers.style_chain(containers.parse_xml(containers.entry(bytes(content), "word/styles.xml"))).items()]
            yield pd.DataFrame(rows, columns=["path", "style", "font", "size"])

    return containers.sample_packages(spark).mapInPandas(run, "path string, style string, font string, size string")


def s05_udf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s03_packages(spark, sf_dir).where("path LIKE '%.udf'").select("path", "block_index", "style", "text")


def s07_utf16_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each block with characters beyond 16 bits or accents: its length in code points and in UTF-16 units."""
    return per_block(corpus_blocks(spark, sf_dir).where(F.length("text") != F.octet_length("text")), lambda t: [(len(t), len(t.encode("utf-16-le", "surrogatepass")) // 2)], "code_points bigint, units bigint")


def s08_package_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s03_packages(spark, sf_dir).where("error IS NOT NULL").select("path", "error")


def s18_html_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.read_html(load(spark, sf_dir, "pages"))


def s24_scan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s03_packages(spark, sf_dir).groupBy("path").agg(F.count_if(F.col("error").isNull()).alias("blocks"), F.max("error").alias("error"))


def exhibit_pages(spark: SparkSession) -> DataFrame:
    return spark.sql(ENGINE.values("x", "exhibit_id BIGINT, ord BIGINT, source_id BIGINT, source_page BIGINT, bytes BIGINT, rotation BIGINT, width BIGINT, height BIGINT", PAGES)[1])


def e14_size_bounded_parts(spark: SparkSession, sf_dir: str, cap: int = 6000) -> DataFrame:
    """Parts of each exhibit: as many pages in order as stay under the cap, one at least. Sizes are taken as additive."""

    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        part, total, out = 1, 0, []
        for page, size in rows.sort_values("source_page")[["source_page", "bytes"]].itertuples(index=False):
            if total and total + size > cap:
                part, total = part + 1, 0
            total += size
            out.append((key[0], page, part, total))
        return pd.DataFrame(out, columns=["exhibit_id", "source_page", "part", "running"])

    return exhibit_pages(spark).groupBy("exhibit_id").applyInPandas(split, "exhibit_id bigint, source_page bigint, part bigint, running bigint")


def e13_exhibit_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of each exhibit: parts with their pages and bytes, named in order."""
    parts = e14_size_bounded_parts(spark, sf_dir).join(exhibit_pages(spark).select("exhibit_id", "source_page", "bytes"), ["exhibit_id", "source_page"])
    return parts.groupBy("exhibit_id", "part").agg(F.count("*").alias("pages"), F.sum("bytes").alias("bytes")).withColumn("name", F.format_string("ek-%02d-%d.pdf", "exhibit_id", "part"))


def g11_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an object and one it reaches: the frontier is joined to the edges until nothing is new."""
    edges = spark.sql(ENGINE.values("x", "a BIGINT, b BIGINT", EDGES)[1])
    found = frontier = edges.select(F.col("a").alias("root"), F.col("b").alias("node"))
    while not frontier.isEmpty():
        frontier = frontier.join(edges, F.col("node") == F.col("a")).select("root", F.col("b").alias("node")).distinct().join(found, ["root", "node"], "left_anti")
        found = found.unionByName(frontier)
    return found.distinct()


def g03_list_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible labels of numbered paragraphs: a counter for each list and level, deeper levels start anew."""
    rows = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 0), (1, 5, 1), (2, 0, 1), (2, 1, 0)], "list_id bigint, place bigint, level bigint")

    def label(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        counts: dict[int, int] = {}
        out = []
        for place, level in frame.sort_values("place")[["place", "level"]].itertuples(index=False):
            counts = {k: n for k, n in counts.items() if k <= level}
            counts[level] = counts.get(level, 0) + 1
            out.append((key[0], place, ".".join(str(counts.get(k, 1)) for k in range(level + 1)) + "."))
        return pd.DataFrame(out, columns=["list_id", "place", "label"])

    return rows.groupBy("list_id").applyInPandas(label, "list_id bigint, place bigint, label string")


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[:1] in "psrmdkeg" and name[1:3].isdigit()}
