"""Exact Jaccard join of shingle sets, with an R-tree over count vectors, and the components of its links.

1. A text's set is its distinct runs of words, as 64-bit hashes. Texts with equal sets form a class (two independent 64-bit
   hashes of the set, and its size).
2. Two sets over the threshold share a shingle among the first n - ceil(t n) + 1 of each, in any order common to all.
   The order is by how common the words of a shingle are, and puts the shingles that texts share last, both as a bounded
   sample has them: shingles of rare words are seldom shared by chance. It decides the cost, never the result. Shingles that
   no two classes share are dropped after a pre-aggregated count. The classes of the others are cut into cells where no size
   of one side is near enough to one of the other to link. Cells only route: they say which classes meet in one index. Near
   copies share many shingles, so most cells have the very members of another (by their number and two 64-bit hashes of
   them), and one of these stands for all. Cells of one least member go to one bucket, where a pair that several of them
   find is given once.
3. Tokens are hashed into GROUPS groups; the counts by group are a class's point. Each cell's points go into a packed
   R-tree, which finds the pairs whose summed coordinate minima (from above: the minima with a node's upper corner) allow
   the overlap needed. Every candidate pair comes from this index.
4. Large groups of near copies would give pairs by the square of their size, so the index is asked in rounds, each followed
   by merging the verified links into components: first for the NEAREST partners of each class (the best one is verified
   before the others), then for those NEAREST of other components, last for all of other components that the bound leaves,
   so that no link is missed.
5. Cells of more than CELL classes are indexed in blocks. In the first rounds a class meets its own block only. In the last
   one blocks follow the components: a component that fills blocks has its own, which need not meet each other; small ones
   share blocks, and these meet all others that their sizes allow.
6. Candidate pairs are verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm.bytehash import mix
from vellumgrid.llm.common import materialize, retain, scratch, trim_memory
from vellumgrid.llm.components import connected_components
from vellumgrid.llm.shingles import shingle_sets, weighed_sets, word_blocks

#: Hash groups of a count vector; entries of an R-tree node; members of a cell, or block of one, at most.
GROUPS, FANOUT, CELL = 256, 16, 2048
#: Counts are bytes; this one stands for itself and all above, and bounds nothing in its group.
FULL = 255
#: Partners of a member in all rounds but the last.
NEAREST = 4
#: Texts sampled for common shingles and words; shingles held as common, at most; bits of a word's hash that its count goes by.
SAMPLE, COMMON, WORDS = 20_000, 200_000, 20
#: Bits of a set of size bands; the bands repeat after them.
BITS = 63
#: Cell members handed to one Python call, about.
BUCKET = 20_000
#: Ids that are broadcast to find their texts, at most; beyond that texts and ids are shuffled.
BROADCAST = 200_000
#: Texts, or pairs, whose sets are held at once.
ROWS = 500
_SECOND, _HASH = np.uint64(0xD6E8FEB86659FD93), np.uint64((1 << 56) - 1)


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of num / den or more."""

    num: int
    den: int

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def bands(self, most: int = 4096) -> np.ndarray:
        """Least sizes of bands such that sets of one band may link, and those of bands that are not neighbours cannot; the
        last one holds all above."""
        least = [1]
        while len(least) < most and least[-1] < 1 << 40:
            least.append(self.den * least[-1] // self.num + 1)
        return np.array(least)

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)


def class_of(s: np.ndarray) -> tuple[int, int]:
    """Two numbers for a set, as signed 64-bit integers."""
    n = np.uint64(len(s))
    mixed, other = mix(s), mix(s ^ _SECOND)
    both = np.array([s.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(mixed), other.sum(dtype=np.uint64)], np.uint64) + n
    a, b = mix(both).view(np.int64).tolist()
    return a, b


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """From a sample of about SAMPLE texts: the first 56 bits of the hashes of shingles that two of its texts or more share,
    the COMMON most frequent, sorted; and for weighed_sets the logarithms of its words' counts."""
    n = docs.count()
    picked = docs.where(F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, n))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            found, texts = np.unique(np.concatenate(list(shingle_sets(batch.column(1), size))), return_counts=True)
            counts = np.zeros(1 << WORDS, np.int64)
            for words, _ in word_blocks(batch.column(1)):
                np.add.at(counts, (words >> np.uint64(64 - WORDS)).astype(np.int64), 1)
            seen = np.flatnonzero(counts)
            key = np.concatenate([(found >> np.uint64(8)).astype(np.int64), seen])
            yield pa.record_batch([pa.array(np.repeat([False, True], [len(found), len(seen)])), pa.array(key), pa.array(np.concatenate([texts, counts[seen]]))], ["word", "s", "texts"])
        trim_memory()

    counts = picked.mapInArrow(run, "word boolean, s bigint, texts bigint").groupBy("word", "s").agg(F.sum("texts").alias("texts")).where("texts > 1")
    counts = materialize(counts, "counts")
    shared = counts.where("NOT word").orderBy(F.desc("texts"), "s").limit(COMMON).select("s").toArrow()
    words = counts.where("word").select(F.col("s").cast("int"), "texts").toArrow()
    weights = np.zeros(1 << WORDS, np.uint8)
    if words.num_rows:
        logs = np.log2(words.column(1).to_numpy())
        weights[words.column(0).to_numpy()] = logs * (255 // size / logs.max())
    return np.sort(shared.column(0).to_numpy().view(np.uint64)), weights


def prefix_of(marks: np.ndarray, k: int, common: np.ndarray) -> np.ndarray:
    """The first k of a set's marks: those not common, then the common ones, each in order."""
    if not len(common):
        return marks[:k]
    n = 2 * k
    while True:  # most sets need but a part of their marks looked up
        head = marks[:n] & _HASH
        seen = common[np.minimum(np.searchsorted(common, head), len(common) - 1)] == head
        rare = marks[:n][~seen]
        if len(rare) >= k or n >= len(marks):
            return rare[:k] if len(rare) >= k else np.concatenate([rare, marks[:n][seen][: k - len(rare)]])
        n *= 2


class RTree:
    """A packed R-tree: points are sorted into leaves by their most spread coordinates; nodes keep their upper corner and
    the least size below them."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        order = self.pack(points, np.arange(len(points)))
        self.order, self.levels = order, []
        upper, least = points[order], sizes[order]
        while len(upper) > FANOUT:
            cuts = np.arange(0, len(upper), FANOUT)
            upper, least = np.maximum.reduceat(upper, cuts, axis=0), np.minimum.reduceat(least, cuts)
            self.levels.append((upper, least))

    @staticmethod
    def pack(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if len(rows) <= FANOUT:
            return rows
        own = points[rows]
        rows = rows[np.argsort(own[:, int(np.argmax(own.max(axis=0) - own.min(axis=0)))], kind="stable")]
        half = -(-len(rows) // (2 * FANOUT)) * FANOUT
        return np.concatenate([RTree.pack(points, rows[:half]), RTree.pack(points, rows[half:])]) if half < len(rows) else rows

    def search(self, point: np.ndarray, size: int, t: Threshold) -> np.ndarray:
        """Places of points that no node rules out."""
        nodes = None
        for upper, least in reversed(self.levels):
            at = np.arange(len(upper)) if nodes is None else nodes[nodes < len(upper)]
            bound = np.minimum(upper[at], point).sum(axis=1)
            at = at[(t.num + t.den) * bound >= t.num * (size + least[at])]
            nodes = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        if nodes is None:
            return self.order
        return self.order[nodes[nodes < len(self.order)]]


def cell_pairs(ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, points: np.ndarray, t: Threshold, nearest: int | None, left: np.ndarray | None = None) -> Iterator[tuple[int, int, float]]:
    """Pairs of members of different components that the bound allows, the smaller id first, and the bound by their sizes.
    left: of two blocks, the members of the first."""
    tree = RTree(points, sizes)
    for i in range(len(ids)) if left is None else np.flatnonzero(left):
        at = tree.search(points[i], int(sizes[i]), t)
        every = nearest is None and left is None  # a pair is found from both ends
        at = at[(comps[at] != comps[i]) & (True if left is None else ~left[at]) & ((ids[at] > ids[i]) if every else True)]
        bound = np.minimum(points[at], points[i]).sum(axis=1)
        fits = (t.num + t.den) * bound >= t.num * (sizes[i] + sizes[at])
        at, ratio = at[fits], bound[fits] / (sizes[at[fits]] + sizes[i])
        if nearest is not None and len(at) > nearest:
            best = np.argsort(-ratio, kind="stable")[:nearest]
            at, ratio = at[best], ratio[best]
        for j, x in zip(at, ratio, strict=True):
            yield (int(ids[i]), int(ids[j]), float(x)) if ids[i] < ids[j] else (int(ids[j]), int(ids[i]), float(x))


def leaf_pairs(cells: np.ndarray, comps: np.ndarray, sizes: np.ndarray, counts: np.ndarray, t: Threshold, nearest: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cell_pairs for all cells that are one leaf of equally many members: rows of both ends and the ratio. cells: rows by cell."""
    n, m = cells.shape
    ratio = np.full((n, m, m), -1.0)
    for i in range(m):
        for j in range(i + 1, m):
            a, b = cells[:, i], cells[:, j]
            least, both = np.minimum(counts[a], counts[b]), sizes[a] + sizes[b]
            bound = np.where((least == FULL).any(axis=1), 1 << 40, least.sum(axis=1, dtype=np.int64))
            fits = (comps[a] != comps[b]) & ((t.num + t.den) * bound >= t.num * both)
            ratio[:, i, j] = ratio[:, j, i] = np.where(fits, bound / both, -1.0)
    found = ratio > 0
    if nearest is not None and m > nearest + 1:
        best = np.zeros_like(found)
        np.put_along_axis(best, np.argsort(-ratio, axis=2, kind="stable")[:, :, :nearest], True, axis=2)
        found &= best | best.transpose(0, 2, 1)
    which, i, j = np.nonzero(np.triu(found))
    return cells[which, i], cells[which, j], ratio[which, i, j]


def cell_join(t: Threshold, nearest: int | None):
    """Function of a bucket of whole cells, or of a pair of blocks of one cell (column side)."""

    def run(rows: pa.Table) -> pa.Table:
        key, ids, comps = (np.asarray(rows.column(c)) for c in ("key", "cls", "comp"))
        sizes, side = np.asarray(rows.column("n")), np.asarray(rows.column("side"))
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint8).reshape(len(ids), GROUPS)
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1))
        members = np.diff(starts, append=len(order))
        ends: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        two = side.any()
        for m in [] if two else [int(m) for m in np.unique(members) if 1 < m <= FANOUT]:
            first = starts[members == m]
            for k in range(0, len(first), max(1, 20_000 // m)):
                ends.append(leaf_pairs(order[first[k : k + max(1, 20_000 // m), None] + np.arange(m)], comps, sizes, counts, t, nearest))
        for a, m in zip(starts.tolist(), members.tolist(), strict=True):
            part = order[a : a + m]
            if (two and not side[part].min() and side[part].max()) or (not two and m > FANOUT):
                points = counts[part].astype(np.int64)
                points[points == FULL] = 1 << 40
                found = list(cell_pairs(np.arange(m), comps[part], sizes[part], points, t, nearest, side[part] == 0 if two else None))
                x, y, ratio = (np.array([f[i] for f in found], kind) for i, kind in enumerate((np.int64, np.int64, np.float64)))
                ends.append((part[x], part[y], ratio))
        x, y, ratio = (np.concatenate([e[i] for e in ends]) if ends else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, np.float64)))
        low, high = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
        by = np.lexsort((high, low))
        low, high, ratio = low[by], high[by], ratio[by]
        new = np.ones(len(by), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        return pa.table([pa.array(low[new]), pa.array(high[new]), pa.array(ratio[new])], ["a", "b", "ratio"])

    return run


def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    end = lambda k: comps.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    return pairs.join(end("a"), "a", "left").join(end("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def block_pairs(large: DataFrame, t: Threshold) -> DataFrame:
    """Rows of large cells by pairs of blocks (i, j, side) that hold members of different components whose sizes allow a link."""
    own = large.groupBy("key", "comp").agg(F.count("*").alias("k"))
    pooled = own.groupBy("key").agg(F.coalesce(F.sum(F.when(F.col("k") < CELL, F.col("k"))), F.lit(0)).alias("rest"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / CELL)).cast("int")
    rows = large.join(own, ["key", "comp"]).join(pooled, "key").withColumn("c", F.when(F.col("k") >= CELL, F.col("comp")))
    spread = F.when(F.col("c").isNull(), F.pmod(F.xxhash64(F.lit(17), "comp"), blocks(F.col("rest")))).otherwise(F.pmod(F.xxhash64(F.lit(17), "cls"), blocks(F.col("k"))))
    rows = rows.withColumn("block", F.xxhash64("key", "c", F.coalesce("c", F.lit(0)) == 0, spread.cast("int"))).select("key", "cls", "comp", "n", "counts", "block", "c")
    rows = materialize(rows, "blocks")
    edges = rows.groupBy("key", "block").agg(F.max("c").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    end = lambda k: edges.select("key", F.col("block").alias(k), *[F.col(x).alias(f"{k}_{x}") for x in ("c", "lo", "hi")])
    pairs = end("i").join(end("j"), "key").where("i <= j").where(~F.coalesce(F.col("i_c") == F.col("j_c"), F.lit(False)))
    pairs = pairs.where((F.col("i_lo") * t.num <= F.col("j_hi") * t.den) & (F.col("j_lo") * t.num <= F.col("i_hi") * t.den)).select("key", "i", "j")
    side = lambda k, x: pairs.where(f"{x} = 0 OR i <> j").join(rows.withColumnRenamed("block", k), ["key", k]).select("key", "cls", "comp", "n", "counts", "i", "j", F.lit(x).alias("side"))
    return side("i", 0).unionByName(side("j", 1))


def may_link(t: Threshold) -> Column:
    """Of a group's number of members m and extreme sizes lo and hi: if two of them may link (from three on: may be)."""
    return (F.col("m") > 2) | ((F.col("m") == 2) & (F.col("hi") * t.num <= F.col("lo") * t.den))


def cells_of(keyed: DataFrame, t: Threshold) -> DataFrame:
    """Of classes by shingle (columns key, cls, n, band: modulo BITS), those that may link to another of their shingle, by
    cells (key): no two of one shingle's are of bands that are equal or neighbours."""
    extent = [F.count("*").alias("m"), F.min("n").alias("lo"), F.max("n").alias("hi")]
    shared = keyed.groupBy("key").agg(*extent, F.bit_or(F.expr("shiftleft(1L, band)")).alias("bands")).where(may_link(t)).select("key", "bands")
    # runs of bands begin where the one before is empty; the last one goes on at the first band
    begins = F.col("bands").bitwiseAND(F.bitwise_not(F.shiftleft("bands", 1).bitwiseOR(F.shiftright("bands", BITS - 1))))
    upto = F.bit_count(F.col("begins").bitwiseAND(F.expr(f"shiftrightunsigned(-1L, {BITS} - band)")))
    rows = keyed.join(shared.select("key", begins.alias("begins")), "key")
    rows = rows.select(F.xxhash64("key", F.pmod(upto, F.greatest(F.lit(1), F.bit_count("begins")))).alias("key"), "cls", "n")
    return materialize(rows, "shared")


def distinct_cells(shared: DataFrame, t: Threshold) -> DataFrame:
    """Of the cells (columns key, cls, n) that may hold a link one for each set of classes, with its size m, and near: equal
    for cells of one least class, up to about BUCKET rows."""
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "cls")).alias(f"x{k}") for k in (1, 2)]
    cells = shared.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("cls").alias("least"), *marks).where(may_link(t))
    cells = materialize(cells.groupBy("m", "x1", "x2").agg(F.min("key").alias("key"), F.first("least").alias("least")).select("key", "m", "least"), "cells")
    parts = cells.groupBy("least").agg(F.ceil(F.sum("m") / BUCKET).alias("parts"))
    return cells.join(parts, "least").select("key", "m", F.xxhash64("least", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("near"))


def candidate_pairs(members: DataFrame, comps: DataFrame | None, classes: DataFrame, t: Threshold, nearest: int | None, salt: int) -> DataFrame:
    """Pairs (a, b) with their bound (ratio) that the index finds in cells of more than one component; without comps every
    class is one. With nearest, a class of a cell of several blocks meets its own block only."""
    schema = "a bigint, b bigint, ratio double"
    if comps is None:
        own = members.withColumn("comp", F.col("cls"))
    else:
        own = members.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).select("key", "cls", "m", "near", "comp")
        # a cell of NEAREST members and one more was wholly searched in the first round
        open_cells = own.where(F.col("m") > NEAREST + 1).groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        own = own.join(open_cells, "key")
    rows = materialize(own.join(classes.select("cls", "n", "counts"), "cls").select("key", "cls", "comp", "n", "counts", "m", "near"), "rows")
    total = rows.count()
    small = rows.where(F.col("m") <= CELL).withColumn("bucket", F.pmod("near", F.lit(max(1, -(-total // BUCKET))))).withColumn("side", F.lit(0))
    pairs = small.groupBy("bucket").applyInArrow(cell_join(t, nearest), schema)
    large = rows.where(F.col("m") > CELL)
    if not large.isEmpty():
        if nearest is None:
            pairs = pairs.unionByName(block_pairs(large, t).groupBy("key", "i", "j").applyInArrow(cell_join(t, None), schema))
        else:
            block = F.pmod(F.xxhash64(F.lit(salt), "cls"), F.ceil(F.col("m") / CELL)).cast("int")
            pairs = pairs.unionByName(large.withColumn("block", block).withColumn("side", F.lit(0)).groupBy("key", "block").applyInArrow(cell_join(t, nearest), schema))
    return pairs.groupBy("a", "b").agg(F.max("ratio").alias("ratio"))


def count_vector(s: np.ndarray) -> bytes:
    shift = np.uint64(65 - GROUPS.bit_length())
    counts = np.bincount((s >> shift).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, FULL).astype(np.uint8).tobytes()


def sets_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """cls, n and s (the packed set) of the classes wanted (column cls), from the text of one document each."""
    ids = materialize(wanted.join(classes, "cls").select(F.col("rep").alias("id"), "cls", "h1", "h2"), "ids")
    n = ids.count()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            cls, h1, h2 = (batch.column(i).to_pylist() for i in range(1, 4))
            # texts that share an id with the class's own are left out
            found = [(c, s) for c, x, y, s in zip(cls, h1, h2, shingle_sets(batch.column(0), size), strict=True) if len(s) and class_of(s) == (x, y)]
            yield pa.record_batch([pa.array([c for c, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["cls", "n", "s"])
        trim_memory()

    side = F.broadcast(ids) if n <= BROADCAST else ids
    sets = materialize(docs.join(side, "id").select("text", "cls", "h1", "h2").mapInArrow(packed, "cls bigint, n bigint, s binary"), "sets")
    return sets if sets.count() == n else materialize(sets.dropDuplicates(["cls"]), "sets")  # rows of one id and text


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, t: Threshold) -> DataFrame:
    """The pairs that are links."""
    pairs = materialize(pairs.select("a", "b"), "pairs")
    if pairs.isEmpty():
        return pairs
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), classes, docs, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            keep = []
            for i, (na, nb, sa, sb) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)):
                both = np.concatenate([np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)])
                both.sort(kind="stable")  # each side is distinct, so equal neighbours are of both
                if t.linked(int((both[1:] == both[:-1]).sum()), na, nb):
                    keep.append(i)
            places = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column(0).take(places), batch.column(1).take(places)], ["a", "b"])
        trim_memory()

    side = lambda k: sets.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("s").alias(f"s{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return materialize(joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint"), "links")


def jaccard_components(docs: DataFrame, size: int = 5, t: Threshold = Threshold(80, 100), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of docs: id, n_shingles, class_id (the least id with the same set), component_id (the least id
    reachable by links, itself included).

    Null and blank texts have no shingles and are components of their own, as are rows with a null id, whose ids are null.
    Rows that share an id count as separate texts with one name. An empty table gives an empty result."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    ids = docs.schema["id"].dataType.simpleString()
    bands = t.bands()

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            sets, marks = map(list, zip(*weighed_sets(batch.column(1), size, weights), strict=True))
            cls = [class_of(s) if len(s) else (None, None) for s in sets]
            counts = pa.array([count_vector(s) for s in sets], pa.binary())
            # sets that only equal sets can link to need no keys
            keys = [prefix_of(m, t.prefix(len(s)), common) if t.den * len(s) >= t.num * (len(s) + 1) else m[:0] for s, m in zip(sets, marks, strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64) if keys else [], pa.int64()))
            h1, h2 = (pa.array([c[k] for c in cls], pa.int64()) for k in range(2))
            sizes = np.array([len(s) for s in sets])
            band = pa.array(((np.searchsorted(bands, sizes, "right") - 1) % BITS).astype(np.int32))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), h1, h2, band, counts, lists], ["id", "n", "h1", "h2", "band", "counts", "keys"])
        trim_memory()

    with scratch(spark):
        common, weights = common_shingles(docs, size)
        profile = materialize(docs.mapInArrow(profiles, f"id {ids}, n bigint, h1 bigint, h2 bigint, band int, counts binary, keys array<bigint>"), "profile")
        known = profile.where("h1 IS NOT NULL AND id IS NOT NULL")
        equal = known.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), *[F.first(k).alias(k) for k in ("band", "counts", "keys")])
        classes = materialize(equal.withColumn("cls", F.monotonically_increasing_id()), "classes")
        docs = docs.where("id IS NOT NULL")
        shared = cells_of(classes.select(F.explode("keys").alias("key"), "cls", "n", "band"), t)
        members = materialize(shared.join(distinct_cells(shared, t), "key").select("key", "cls", "m", "near"), "members")
        near = materialize(candidate_pairs(members, None, classes, t, NEAREST, 0), "near")
        best = near.groupBy("b").agg(F.max_by("a", F.struct("ratio", "a")).alias("a"))
        links = verify(best, classes, docs, size, t)
        comps = materialize(connected_components(links), "components")
        rounds = [lambda c: apart(near, c).join(best, ["a", "b"], "left_anti")]
        rounds += [lambda c, k=k, n=n: candidate_pairs(members, c, classes, t, n, k) for k, n in ((1, NEAREST), (2, None))]
        for candidates in rounds:
            found = verify(candidates(comps), classes, docs, size, t)
            if not found.isEmpty():
                links = links.unionByName(found)
                comps = materialize(connected_components(links), "components")
        comps = comps.withColumnRenamed("node", "cls")
        grouped = classes.join(comps, "cls", "left").select("h1", "h2", "n", "rep", F.coalesce("component", "cls").alias("component"))
        grouped = materialize(grouped, "grouped")
        least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
        named = retain(materialize(grouped.join(least, "component").select("h1", "h2", "n", F.col("rep").alias("class_id"), "component_id"), "named"))
        narrow = retain(materialize(profile.select("id", "n", "h1", "h2"), "narrow"))
    some = narrow.where("h1 IS NOT NULL AND id IS NOT NULL").join(named, ["h1", "h2", "n"]).select("id", "n", "class_id", "component_id")
    none = narrow.where("h1 IS NULL OR id IS NULL").select("id", "n", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return some.unionByName(none).withColumnRenamed("n", "n_shingles").withColumnRenamed("id", id_col)
