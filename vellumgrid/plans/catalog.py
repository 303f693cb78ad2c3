"""Every operator by name, with the SQL that its result is compared with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumgrid.operators import audit, containment, corrections, relational, sequential, structure
from vellumgrid.operators.scalars import SCALARS
from vellumgrid.plans.dialect import ENGINE, ORACLE, Dialect, Statement, run
from vellumgrid.sources.tables import corpus_blocks, corpus_blocks_sql, load

Query = Callable[[SparkSession, str], DataFrame]
Template = Callable[[Dialect], Statement]
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def query(template: Template) -> Query:
    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        statement = template(ENGINE)
        text = statement.text()
        relations = {t: load(spark, sf_dir, t) for t in TABLES if f" {t}" in text}
        if " blocks" in text:
            relations["blocks"] = corpus_blocks(spark, sf_dir)
        return run(spark, statement, **relations)

    return go


def oracle(template: Template) -> str:
    statement = template(ORACLE)
    return statement.text(corpus_blocks_sql() if " blocks" in statement.text() else ()).replace("AS string)", "AS VARCHAR)")


def templates() -> dict[str, Template]:
    return {**SCALARS, **audit.STATEMENTS, **audit.GATE, **structure.STATEMENTS, **relational.STATEMENTS, **containment.STATEMENTS, **corrections.STATEMENTS}


def queries() -> dict[str, Query]:
    return {**{n: query(t) for n, t in templates().items()}, **sequential.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {n: oracle(t) for n, t in templates().items()}
