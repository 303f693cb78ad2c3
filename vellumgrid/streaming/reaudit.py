"""Documents that arrive while a stream runs are audited as they come: every micro-batch holds whole documents, so no state
and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vellumgrid.operators.audit import gated
from vellumgrid.plans.dialect import ENGINE, run
from vellumgrid.sources.tables import blocks_of


def audit(documents: DataFrame, cap: int = 50) -> DataFrame:
    """Gated findings of a table of documents."""
    return run(documents.sparkSession, gated(ENGINE, cap=cap), blocks=blocks_of(documents))


def audit_stream(documents: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends the findings of each micro-batch to Parquet files in `out`."""

    def write(batch: DataFrame, number: int) -> None:
        audit(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
