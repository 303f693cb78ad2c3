"""Relations read from a corpus: documents and their blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.plans.dialect import ENGINE, ORACLE, Dialect
from vellumgrid.sources import fixtures

BLOCKS = "doc_id BIGINT, block_index BIGINT, text string"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def blocks_of(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a line of a text: doc_id, block_index (from 0), text. Null texts have no blocks. No shuffle."""
    return documents.where(F.col(text).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("block_index", "text")).withColumn("block_index", F.col("block_index").cast("bigint"))


def corpus_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's blocks and those of our fixtures (negative ids)."""
    return blocks_of(load(spark, sf_dir, "documents")).unionByName(spark.sql(ENGINE.values("x", BLOCKS, fixtures.BLOCKS)[1]))


def corpus_blocks_sql(d: Dialect = ORACLE) -> tuple[tuple[str, str], ...]:
    """The same as relations of the comparison's SQL."""
    return (
        ("fixture_blocks", d.values("x", BLOCKS, fixtures.BLOCKS)[1]),
        ("blocks", d.posexplode("documents", "doc_id", "string_split(text, chr(10))", "block_index", "text").replace("FROM documents", "FROM documents WHERE text IS NOT NULL") + " UNION ALL SELECT * FROM fixture_blocks"),
    )
