"""One statement, two dialects: the engine's SQL, and the SQL that tests compare it with.

An operator is written once as a function of a Dialect and gives a Statement: named relations and a final SELECT.
Patterns avoid what the two regex engines read differently (look-arounds, \\b, \\w)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Statement:
    final: str
    parts: tuple[tuple[str, str], ...] = field(default=())

    def text(self, before: tuple[tuple[str, str], ...] = ()) -> str:
        parts = [*before, *self.parts]
        return ("WITH " + ",\n".join(f"{n} AS ({s})" for n, s in parts) + "\n" if parts else "") + self.final


class Dialect:
    """The engine's own SQL."""

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def extract_all(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({s}, {self.lit(pattern)}, {group})"

    def extract(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({s}, {self.lit(pattern)}, {group})"

    def replace(self, s: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(to)})"

    def like(self, s: str, pattern: str) -> str:
        return f"coalesce(regexp_like({s}, {self.lit(pattern)}), false)"

    def sieve(self, cond: str) -> str:
        """A condition that every row of the result meets, cheaper than the work it saves; not part of the compared SQL."""
        return cond

    def holds_any(self, s: str, parts) -> str:
        return self.like(s, "|".join(f"\\Q{p}\\E" for p in parts))

    def count(self, s: str, pattern: str) -> str:
        return f"CAST(regexp_count({s}, {self.lit(pattern)}) AS BIGINT)"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def at(self, a: str, i: str) -> str:
        return f"get({a}, CAST({i} AS INT) - 1)"

    def filter(self, a: str, x: str, cond: str) -> str:
        return f"filter({a}, {x} -> {cond})"

    def map(self, a: str, x: str, e: str) -> str:
        return f"transform({a}, {x} -> {e})"

    def upto(self, n: str) -> str:
        return f"(CASE WHEN {n} > 0 THEN sequence(1L, {n}) ELSE CAST(array() AS array<bigint>) END)"

    def between(self, a: str, b: str) -> str:
        return f"(CASE WHEN {a} <= {b} THEN sequence(CAST({a} AS BIGINT), CAST({b} AS BIGINT)) ELSE CAST(array() AS array<bigint>) END)"

    def head(self, a: str, n: str) -> str:
        return f"slice({a}, 1, CAST({n} AS INT))"

    def join(self, a: str, sep: str = "") -> str:
        return f"array_join({a}, {self.lit(sep)})"

    def explode(self, relation: str, columns: str, a: str, name: str) -> str:
        return f"SELECT {columns}, explode({a}) AS {name} FROM {relation}"

    def posexplode(self, relation: str, columns: str, a: str, pos: str, name: str) -> str:
        return f"SELECT {columns}, CAST({pos} AS BIGINT) AS {pos}, {name} FROM {relation} LATERAL VIEW posexplode({a}) AS {pos}, {name}"

    def length_to(self, a: str, first: str, last: str, n: int) -> str:
        """Length of the texts up to the last-th, n after those before the first-th (whose length is computed once)."""
        return f"length({self.join(self.head(a, f'{first} - 1'))}) + length({self.join(f'slice({a}, CAST({first} AS INT), {n})')})"

    def split(self, s: str, by: str) -> str:
        return f"split({s}, {self.lit(by)})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def intersect(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def union(self, a: str, b: str) -> str:
        return f"array_union({a}, {b})"

    def except_(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})"

    def contains(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def strings(self, xs) -> str:
        return ", ".join(self.lit(x) for x in xs)

    def values(self, name: str, columns: str, rows) -> tuple[str, str]:
        """A relation of literal rows."""
        cell = lambda x: "NULL" if x is None else self.lit(x) if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else self.array(*map(cell, x)) if isinstance(x, list) else str(x)
        kinds = [c.strip().split(" ") for c in columns.split(",")]
        names = ", ".join(k[0] for k in kinds)
        casts = ", ".join(f"CAST({k[0]} AS {self.kind(' '.join(k[1:]))}) AS {k[0]}" for k in kinds)
        return name, f"SELECT {casts} FROM (VALUES " + ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows) + f") AS t({names})"

    def kind(self, k: str) -> str:
        return k

    def min_by(self, x: str, key: str) -> str:
        return f"min_by({x}, {key})"

    def collect(self, x: str, key: str, sep: str) -> str:
        """Texts joined in the order of a numeric key."""
        return f"array_join(transform(array_sort(collect_list(struct({key} AS k, {x} AS v))), e -> e.v), {self.lit(sep)})"

    def count_if(self, cond: str) -> str:
        return f"count_if({cond})"

    def sha256(self, s: str) -> str:
        return f"sha2({s}, 256)"


class Duck(Dialect):
    """The SQL that results are compared with."""

    def sieve(self, cond: str) -> str:
        return "true"

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def extract_all(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({s}, {self.lit(pattern)}, {group})"

    def replace(self, s: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(to.replace('$', chr(92)))}, 'g')"

    def like(self, s: str, pattern: str) -> str:
        return f"coalesce(regexp_matches({s}, {self.lit(pattern)}), false)"

    def count(self, s: str, pattern: str) -> str:
        return f"CAST(len(regexp_extract_all({s}, {self.lit(pattern)})) AS BIGINT)"

    def size(self, a: str) -> str:
        return f"CAST(len({a}) AS BIGINT)"

    def at(self, a: str, i: str) -> str:
        return f"({a})[{i}]"

    def filter(self, a: str, x: str, cond: str) -> str:
        return f"list_filter({a}, lambda {x}: {cond})"

    def map(self, a: str, x: str, e: str) -> str:
        return f"list_transform({a}, lambda {x}: {e})"

    def upto(self, n: str) -> str:
        return f"range(1, CAST({n} AS BIGINT) + 1)"

    def between(self, a: str, b: str) -> str:
        return f"range(CAST({a} AS BIGINT), CAST({b} AS BIGINT) + 1)"

    def head(self, a: str, n: str) -> str:
        return f"({a})[1:CAST({n} AS BIGINT)]"

    def length_to(self, a: str, first: str, last: str, n: int) -> str:
        return f"length({self.join(self.head(a, last))})"

    def join(self, a: str, sep: str = "") -> str:
        return f"coalesce(array_to_string({a}, {self.lit(sep)}), '')"

    def explode(self, relation: str, columns: str, a: str, name: str) -> str:
        return f"SELECT {columns}, unnest({a}) AS {name} FROM {relation}"

    def posexplode(self, relation: str, columns: str, a: str, pos: str, name: str) -> str:
        return f"SELECT {columns}, unnest(range(len({a}))) AS {pos}, unnest({a}) AS {name} FROM {relation}"

    def split(self, s: str, by: str) -> str:
        return f"string_split({s}, {self.lit(by)})"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def intersect(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def union(self, a: str, b: str) -> str:
        return f"list_distinct(list_concat({a}, {b}))"

    def except_(self, a: str, b: str) -> str:
        return f"list_filter(list_distinct({a}), lambda e_: NOT list_contains({b}, e_))"

    def contains(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def kind(self, k: str) -> str:
        return {"string": "VARCHAR", "array<string>": "VARCHAR[]", "array<bigint>": "BIGINT[]"}.get(k, k)

    def min_by(self, x: str, key: str) -> str:
        return f"arg_min({x}, {key})"

    def collect(self, x: str, key: str, sep: str) -> str:
        return f"string_agg({x}, {self.lit(sep)} ORDER BY {key})"

    def sha256(self, s: str) -> str:
        return f"sha256({s})"


ENGINE, ORACLE = Dialect(), Duck()


def run(spark: SparkSession, statement: Statement, **relations: DataFrame) -> DataFrame:
    """The statement over relations, which are views only while it is analysed."""
    for name, df in relations.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(statement.text())
    finally:
        for name in relations:
            spark.catalog.dropTempView(name)
