"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm import oracles
from vellumgrid.llm.common import read_table

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumgrid.llm.toxicity import score_toxicity

    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2
    scored = score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~fold("id"))
    return scored.select("doc_id", F.coalesce(fold("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumgrid.llm.ngram_join import Threshold, jaccard_components

    return jaccard_components(read_table(spark, sf_dir, "documents"), 3, Threshold(90, 100)).select("doc_id", "n_shingles", "component_id", "class_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumgrid.llm.url_filter import filter_urls

    return filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumgrid.llm.quality import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumgrid.llm.language_id import identify_language

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    docs = read_table(spark, sf_dir, "documents")
    return identify_language(docs, ~held_out).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumgrid.llm.topk_search import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumgrid.llm.mixing import mix_sources

    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", "taken")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellumgrid.llm.suffix_dedup import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vellumgrid.llm.token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vellumgrid.llm.bpe_codec import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_ngram_join, op3_url_filter, op4_quality_rules, op5_language_id, op6_topk_search, op7_source_mix, op8_suffix_dedup, op9_token_counts, op10_bpe_codec)}

ORACLE_SQL = {
    "op3_url_filter": r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(h, t, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT p.*, (SELECT max({'n': length(h) + length(t), 'hn': length(h), 'k': h || t, 'v': v}) FROM r
               WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, t)) AS best FROM p)
SELECT page_id, host, path, best.k AS rule, coalesce(best.v, 'allow') AS verdict FROM m""",
    "op2_ngram_join": oracles.ngram_join(3, 90, 100),
    "op4_quality_rules": oracles.quality_rules(),
    "op6_topk_search": oracles.top_k(5, 256),
    "op8_suffix_dedup": oracles.suffix_dedup(100),
}
