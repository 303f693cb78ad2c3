"""Exact top-k inner products by an impact-ordered index, score at a time, for a batch of queries at once.

Vectors become integers, floor(scale * x). Vectors are dense, so a component's posting list holds every candidate of a
block. A block of candidates keeps its lists as a matrix of 32-bit impacts, component by component, with the candidates
cut into segments by descending length, the greatest impact that a query can draw from them. For a batch of queries the
components are put in order of their impact (the queries' weights times the spread of the candidates' values), and a
segment's lists are added slab by slab in that order: a slab's impacts for all queries of the batch are one matrix product.
What a candidate can still gain from the components left is at most the product of both sides' lengths in them, and the
error of 32-bit sums is bounded. A segment is passed over by queries that its lengths cannot help, and its slabs stop once
few candidates can reach the k-th best score known so far; those candidates are scored exactly, so that no other can be in
the answer. Blocks of queries meet blocks of candidates in a grid; each cell returns k rows a query, of which k are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.llm.common import materialize, retain, scratch, trim_memory

#: Size of a component, at most: differences of components fit 64 bits.
MOST = 1 << 61
LONG = 1 << 63
#: Candidates and queries in a block, at most; fewer if vectors have more than WIDE components.
CANDIDATES, QUERIES, WIDE = 16_384, 32_768, 64
#: Candidates of a segment, queries of a batch, components of a slab, pairs scored exactly at once.
SEGMENT, BATCH, SLAB, PAIRS = 2048, 512, 16, 1 << 16
#: Slabs stop when at most this part of a segment's pairs can still be in the answer.
FEW = 1 / 256


def unit(values: np.ndarray) -> float:
    """A power of two that brings values to 1 at most."""
    return float(2.0 ** np.ceil(np.log2(max(1.0, float(np.abs(values).max(initial=0))))))


def lengths(values: np.ndarray) -> np.ndarray:
    """Lengths of rows, from above."""
    return np.sqrt(np.einsum("ij,ij->i", values, values, dtype=np.float64)) * (1 + 1e-9)


class Index:
    """The posting lists of a block, and the best k candidates of its queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.unit = unit(vectors)
        whole = lengths(vectors / self.unit)
        order = np.lexsort((ids, -whole))
        self.ids, self.vectors, self.whole = ids[order], vectors[order], whole[order]
        self.impacts = np.ascontiguousarray((self.vectors / self.unit).T.astype(np.float32))  # component by candidate
        self.spread = lengths(self.impacts)
        self.most = float(np.abs(vectors).max(initial=0))

    def exact(self, queries: np.ndarray, asks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of pairs; those that no long holds become the nearest long."""
        if self.most * float(np.abs(queries).max(initial=0)) * queries.shape[1] < 2**53:  # sums are exact as doubles
            parts = [np.einsum("ij,ij->i", queries[asks[i : i + PAIRS]].astype(np.float64), self.vectors[at[i : i + PAIRS]].astype(np.float64)) for i in range(0, len(at), PAIRS)]
            return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        sums = [sum(a * b for a, b in zip(queries[q].tolist(), self.vectors[c].tolist(), strict=True)) for q, c in zip(asks, at, strict=True)]
        return np.array([min(max(s, -LONG), LONG - 1) for s in sums], np.int64)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and scores: the k best candidates of each query but those of its own id, ties to smaller ids."""
        (n, d), scale = queries.shape, unit(queries)
        weights = (queries / scale).astype(np.float32)
        order = np.argsort(-lengths(weights.T) * self.spread, kind="stable")
        weights = np.ascontiguousarray(weights[:, order])
        rest = [lengths(weights[:, a:]) for a in range(0, d, SLAB)] + [np.zeros(n)]
        reach = lengths(queries / scale)
        slack = (d + 4) * 2.0**-23 * reach  # of 32-bit components and sums, for a candidate of length 1
        best = np.full(n, -np.inf)  # a score that k candidates have
        pool = (np.zeros(0, np.int64),) * 3
        for a in range(0, len(self.ids), SEGMENT):
            b = min(a + SEGMENT, len(self.ids))
            length = float(self.whole[a])
            err = slack * length + 1e-30
            live = np.flatnonzero(reach * length + err >= best)
            if not len(live):
                break  # later candidates are shorter
            lists = self.impacts[order, a:b]
            mine = self.same(own[live], a, b)
            squares = [np.einsum("ij,ij->j", lists[j : j + SLAB], lists[j : j + SLAB]) for j in range(0, d, SLAB)]
            lengths_left = np.sqrt(np.cumsum(squares[::-1], axis=0).max(axis=1))[::-1] * (1 + 1e-5)
            gains = [rest[i][live] * float(lengths_left[i]) for i in range(1, len(squares))] + [np.zeros(len(live))]
            # a test is worth its cost where most candidates, whose scores so far are about 0, can fall out
            tests = [i for i, g in enumerate(gains) if i == len(squares) - 1 or (2 * g < best[live]).mean() > 0.5]
            scores = left = None
            for before, i in zip([-1, *tests], tests, strict=False):
                slabs = slice((before + 1) * SLAB, (i + 1) * SLAB)
                added = weights[live, slabs] @ lists[slabs]
                scores = added if scores is None else scores + added
                need = best[live] - gains[i] - err[live]
                if i == tests[-1] and (unknown := np.flatnonzero(best[live] == -np.inf)).size:
                    known = self.kth(scores, unknown, mine, k) - err[live[unknown]]
                    edge = LONG / scale / self.unit  # scores beyond a long are ties
                    need[unknown] = np.where(known <= -edge, -np.inf, np.minimum(known, edge) - err[live[unknown]])
                left = scores >= np.nextafter(need.astype(np.float32), np.float32(-np.inf))[:, None]
                if np.count_nonzero(left) <= FEW * left.size:
                    break
            left[mine] = False
            flat = np.flatnonzero(left)
            asks, at = live[flat // (b - a)], a + flat % (b - a)
            pool = self.keep(*(np.concatenate(x) for x in zip(pool, (asks, self.ids[at], self.exact(queries, asks, at)), strict=True)), k)
            full = np.bincount(pool[0], minlength=n) >= k
            ends = np.cumsum(np.bincount(pool[0], minlength=n)) - 1
            last = pool[2][ends[full]].astype(np.float64)
            best[full] = np.where(last <= -LONG, -np.inf, (last - np.abs(last) * 1e-15) / scale / self.unit)  # scores beyond a long are ties
        return pool

    def same(self, own: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a candidate of its own id."""
        by = np.argsort(self.ids[a:b], kind="stable")
        low, high = (np.searchsorted(self.ids[a:b], own, side, sorter=by) for side in ("left", "right"))
        asks = np.repeat(np.arange(len(own)), high - low)
        return asks, by[np.arange(len(asks)) - np.repeat(np.cumsum(high - low) - high, high - low)]

    @staticmethod
    def kth(scores: np.ndarray, rows: np.ndarray, mine: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
        """A score that k candidates of a row reach, not counting those of its own id; -inf where there are fewer."""
        scores[mine] = -np.inf
        scores = scores[rows]
        while scores.shape[1] >= 64 * k:  # the greater of two candidates stands for both: k such are k candidates
            half = scores.shape[1] // 2
            scores = np.maximum(scores[:, :half], scores[:, half : 2 * half])
        if scores.shape[1] < k:
            return np.full(len(rows), -np.inf)
        return np.partition(scores, -k, axis=1)[:, -k].astype(np.float64)

    @staticmethod
    def keep(asks: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by = np.lexsort((ids, ~scores, asks))
        asks = asks[by]
        first = np.searchsorted(asks, asks, "left")
        by, asks = by[top := np.arange(len(by)) - first < k], asks[top]
        return asks, ids[by], scores[by]


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as bigint, MOST at most and -MOST at least; null for vectors that are null or hold
    null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * scale)))))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the candidate's id and its score: the k greatest inner products of each query row with all
    other rows, all if there are fewer.

    Rows whose vector is null, or has null or non-finite components, or whose id is null, take no part; nor do pairs of
    unequal length. A row's own id is no candidate; repeated ids are separate candidates and queries with one answer.
    Ties go to the smaller id. Components beyond MOST count as MOST, scores that no long holds as the nearest
    long. An empty table gives an empty result."""
    table = vectors.select(F.col(id_col).cast("bigint").alias("id"), integers(F.col(vector), scale).alias("v"), is_query.alias("q")).where("id IS NOT NULL AND v IS NOT NULL").withColumn("d", F.size("v"))
    with scratch(vectors.sparkSession):
        table = retain(materialize(table, "integers"))
    sizes = table.groupBy("d").agg(F.count("*").alias("n"), F.count_if("q").alias("nq"))
    block = lambda n, most: F.greatest(F.lit(1), F.ceil(n * F.greatest(F.lit(1), F.col("d") / WIDE) / F.lit(float(most)))).cast("int")
    sizes = sizes.select("d", block(F.col("n"), CANDIDATES).alias("nc"), block(F.col("nq"), QUERIES).alias("nb"))
    spread = lambda n: F.pmod(F.xxhash64(F.lit(3), "id"), n).cast("int")
    candidates = table.join(sizes, "d").select("d", spread(F.col("nc")).alias("c"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), F.lit(False).alias("q"), "id", "v")
    queries = table.where("q").dropDuplicates(["id", "v"]).join(sizes, "d").select("d", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("c"), spread(F.col("nb")).alias("b"), F.lit(True).alias("q"), "id", "v")

    def cell(key: tuple, rows: pa.Table) -> pa.Table:
        asks = np.asarray(rows.column("q"))
        ids = np.asarray(rows.column("id"))
        flat = rows.column("v").combine_chunks()
        values = np.asarray(flat.flatten(), np.int64).reshape(rows.num_rows, -1)
        out = [(np.zeros(0, np.int64),) * 3]
        if (~asks).any() and values.shape[1]:
            index = Index(ids[~asks], values[~asks])
            own, queries = ids[asks], values[asks]
            for i in range(0, len(own), BATCH):
                places, found, scores = index.search(queries[i : i + BATCH], own[i : i + BATCH], k)
                out.append((own[i : i + BATCH][places], found, scores))
        trim_memory()
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], ["query_id", "id", "score"])

    found = candidates.unionByName(queries).groupBy("d", "c", "b").applyInArrow(cell, "query_id bigint, id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
