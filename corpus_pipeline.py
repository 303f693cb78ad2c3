"""A corpus made ready for training: five stages, each over all that the one before it kept.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm.bpe_codec import encode_documents
from vellumgrid.llm.common import discard, materialize, read_table, retain, scratch
from vellumgrid.llm.mixing import mix_sources
from vellumgrid.llm.ngram_join import Threshold, jaccard_components
from vellumgrid.llm.quality import quality_rules
from vellumgrid.llm.suffix_dedup import remove_repeats

#: The columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity of 0.8 or more) the document with the least id; one of repeated rows.
    Documents without an id stay."""
    groups = jaccard_components(docs, 5, Threshold(80, 100))
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.select(*COLUMNS).join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.select(*COLUMNS).where("doc_id IS NULL"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages that start earlier in the corpus; n_chars is that of what is left."""
    left = remove_repeats(docs, kept=True, keep=["lang", "source"])
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("bigint").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mix_sources(docs, keep=COLUMNS).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of what they decode to."""
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), full=True).select("doc_id", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeats),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: The stages' methods are not for SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table, which stays; the others, and what operators leave, go once the next stage is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            made = retain(materialize(stage(spark, docs, sf_dir), name.replace(" ", "_")))
        discard(docs)
        docs = made
    return docs
