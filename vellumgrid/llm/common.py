"""What the operators of this subpackage share: the shared folder, cut points in lineage, and native word expressions."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and U+0009 to U+000D.
WS_CHARS = " \t\n\x0b\x0c\r"
WS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a file where their number is known; they are narrow.
ROWS_A_FILE = 250_000
_own_dir: str | None = None
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


#: Spark drops a statement's shuffle files at its end while this is on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own if all run
    in one process (tests), else an error: executors would not see each other's files."""
    global _own_dir
    if conf := spark.conf.get("spark.checkpoint.dir", None):
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="vellumgrid-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


_scopes = threading.local()


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize() writes inside go when the block ends, but for those given to retain()."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            delete(spark, path)


def retain(table: DataFrame) -> DataFrame:
    """Leaves a table of the innermost scratch block to what is around it."""
    stack = _scopes.__dict__.get("stack", [])
    path = getattr(table, "_own_path", None)
    if stack and path in stack[-1]:
        stack[-1].remove(path)
        if len(stack) > 1:
            stack[-2].append(path)
    return table


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(table: DataFrame) -> None:
    """Deletes a table that materialize() wrote and nothing reads any more."""
    if path := getattr(table, "_own_path", None):
        delete(table.sparkSession, path)


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later stages survive lost executors and don't repeat the
    work; the statement's shuffle files go. rows: at most so many are written, and so few files do; null: unknown.

    The table lives as long as the scratch block around it, else as long as the shared folder; all tables of an application
    lie in one folder with its id."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/vellumgrid-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    with setting(spark, CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(f"{root}/{tag}")
    if stack := _scopes.__dict__.get("stack", []):
        stack[-1].append(root)
    table = spark.read.schema(df.schema).parquet(f"{root}/{tag}")
    table._own_path = root
    return table


def trim_memory() -> None:
    """Gives a Python worker's freed memory back to the system, where its C library can: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
