"""Removal of repeated byte strings: every byte that a `length`-byte string covers which also starts earlier.

1. Every window of `length` bytes picks an anchor, the least hash of its ANCHOR-byte strings, the first on a tie. Equal
   windows pick equal anchors at equal offsets. Neighbouring windows mostly share an anchor; a run of them is one row:
   anchor, context (a hash of all bytes of the run's windows), document and place.
2. Anchors that occur once, which are most, go after a pre-aggregated count. Of rows with one context the first stays and
   all windows of the others are repeats.
3. The first rows of an anchor with several contexts may share some windows: their bytes are gathered in shards by anchor,
   and each shard's suffixes are sorted in two stages; windows whose common prefix with their neighbour has `length` bytes
   are equal, and all but the earliest are repeats.
4. Anchors with more than HOT contexts are not gathered: each of their windows becomes a row by its hash, and the earliest
   of each hash is found by pre-aggregation.
5. The repeats' spans are joined to the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm.bytehash import buffer_of, prefix_sums, span_hashes
from vellumgrid.llm.common import materialize, retain, scratch, trim_memory
from vellumgrid.llm.suffix_sort import common_prefixes, sort_suffixes, words8

#: Bytes of an anchor; contexts of an anchor that are gathered, at most; contexts in a shard, about.
ANCHOR, HOT, SHARD = 24, 4096, 12_000
#: Texts whose bytes are cut at once.
ROWS = 500
#: Bytes of text hashed at once, unless one text is longer.
BLOCK = (1 << 18) - 1


def part_bits(length: int) -> int:
    """A place holds the first window's start, then the further windows and the anchor's offset in so many bits each: a run
    has under `length` windows, and its anchor lies in the first. Starts have the other bits (48 at 100 bytes)."""
    return length.bit_length()


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - have : width - have + n])


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the windows of all texts in a buffer, run after run: first and last start, anchor's place, its hash, the context's hash."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_sums(data)
    at = np.arange(len(data) - ANCHOR + 1)
    hashes = span_hashes(sums, at, at + ANCHOR)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    least = sliding_least((hashes >> bits << bits) | at.astype(np.uint64), length - ANCHOR + 1)
    place = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    sizes = np.diff(offsets)
    windows = np.zeros(len(data) + 1, np.int64)  # starts whose window ends within its text
    long = sizes >= length
    np.add.at(windows, offsets[:-1][long], 1)
    np.add.at(windows, offsets[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(windows)[: len(place)] > 0)
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[starts[1:]] != place[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi = starts[first], starts[np.concatenate([first[1:], [len(starts)]]) - 1]
    # neighbouring texts: their windows are apart by length - 1 starts, so no run spans two
    anchor = place[lo]
    return lo, hi, anchor, hashes[anchor], span_hashes(sums, lo, hi + length) + (anchor - lo).astype(np.uint64)


def blocks_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = buffer_of(texts)
    begin, n = 0, len(texts)
    while begin < n:
        end = min(n, max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BLOCK, "right")) - 1))
        yield begin, end, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def repeats_in(starts: np.ndarray, counts: np.ndarray, raw: list[bytes], ids: np.ndarray, lo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and window (within the row) of each repeat among the rows of a shard. starts: the rows' places in their joined bytes."""
    text = np.frombuffer(b"".join(raw), np.uint8)
    wanted = np.zeros(len(text), bool)
    row = np.repeat(np.arange(len(raw)), counts)
    window = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    spot = starts[row] + window
    wanted[spot] = True
    owner = np.zeros(len(text), np.int64)
    owner[spot] = np.arange(len(spot))
    words = words8(text, length + 16)
    order = sort_suffixes(text, wanted, words, length)
    shared = common_prefixes(order, words, length)
    group = np.cumsum(shared < length)
    who = owner[order]
    doc, begin = ids[row[who]], lo[row[who]] + window[who]
    by = np.lexsort((begin, doc, group))
    heads = np.flatnonzero(np.diff(group[by], prepend=-1))
    head = by[np.repeat(heads, np.diff(heads, append=len(by)))]
    again = who[by][(doc[by] != doc[head]) | (begin[by] != begin[head])]  # rows given twice are one
    return row[again], window[again]


def runs_of(row: np.ndarray, window: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """row, first and last window of runs of neighbouring windows."""
    by = np.lexsort((window, row))
    row, window = row[by], window[by]
    cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(window) != 1)) + 1
    for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(row)]]), strict=True):
        if b > a:
            yield int(row[a]), int(window[a]), int(window[b - 1])


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text: str = "text", kept: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """One row a row of docs: id, the columns of keep, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and
    with kept the remaining text (a character that lost some of its bytes goes as a whole).

    Null texts are empty; texts under `length` bytes stay whole. Repeated rows are one document to each other: none is
    earlier. Rows with a null id, or with an id that rows of other texts share, have no place in the order: they stay whole
    and repeat nothing. An empty table gives an empty result."""
    spark = docs.sparkSession
    part = part_bits(length)
    keep = [c for c in keep if c != id_col]
    whole = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"), F.struct(F.lit(0).alias("_"), *keep).alias("row"))
    docs = whole.select("id", "text")
    with scratch(spark):
        shared = docs.where("id IS NOT NULL").groupBy("id").agg(F.min(F.xxhash64("text")).alias("x"), F.max(F.xxhash64("text")).alias("y")).where("x <> y").select("id")
        shared = materialize(shared, "shared")
        own = docs.where("id IS NOT NULL")
        if not shared.isEmpty():
            own = own.join(shared, "id", "left_anti")

        def rows(full: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
                    for begin, end, data, offsets in blocks_of(batch.column(1)):
                        lo, hi, at, anchor, context = anchor_runs(data, offsets, length)
                        columns = [pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64))]
                        if full:
                            doc = np.searchsorted(offsets, lo, "right") - 1
                            place = (((lo - offsets[doc]) << part | (hi - lo)) << part) | (at - lo)
                            columns += [pa.array(ids[begin:end][doc]), pa.array(place)]
                        yield pa.record_batch(columns, ["anchor", "context", "id", "place"][: len(columns)])
                trim_memory()

            return own.mapInArrow(run, "anchor bigint, context bigint" + ", id bigint, place bigint" * full)

        counted = rows(False).groupBy("anchor").agg(F.count("*").alias("m"), F.min("context").alias("c0"), F.max("context").alias("c1"))
        again = materialize(counted.where("m > 1").select("anchor", (F.col("c0") != F.col("c1")).alias("several")), "again")
        found = materialize(rows(True).join(again, "anchor"), "found")
        classes = materialize(found.groupBy("anchor", "context", "several").agg(F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("m")), "classes")
        start, windows = F.shiftright("place", 2 * part), F.shiftright("place", part).bitwiseAND(F.lit((1 << part) - 1))
        copies = found.join(classes.where("m > 1").select("anchor", "context", "first"), ["anchor", "context"]).where((F.col("id") != F.col("first.id")) | (F.col("place") != F.col("first.place")))
        spans = materialize(copies.select("id", start.alias("begin"), (start + windows + length).alias("end")), "copies")

        firsts = classes.where("several").select("anchor", F.col("first.id").alias("id"), F.col("first.place").alias("place"))
        sizes = classes.where("several").groupBy("anchor").agg(F.count("*").alias("contexts"))
        firsts = materialize(firsts.join(sizes, "anchor"), "firsts")
        per_doc = firsts.groupBy("id").agg(F.collect_list(F.struct("anchor", "place", "contexts")).alias("runs"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mask = (1 << part) - 1
            for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
                out: list[list] = [[], [], [], [], [], []]
                for i, t, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    raw = t.encode("utf-8")
                    for r in runs:
                        lo, n = r["place"] >> 2 * part, (r["place"] >> part & mask) + 1
                        for x, v in zip(out, (r["anchor"], i, lo, n, r["contexts"], raw[lo : lo + n - 1 + length]), strict=True):
                            x.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["anchor", "id", "lo", "n", "contexts", "raw"])

        gathered = own.join(per_doc, "id").mapInArrow(cut, "anchor bigint, id bigint, lo bigint, n bigint, contexts bigint, raw binary")
        gathered = materialize(gathered, "gathered")

        def shard(table: pa.Table) -> pa.Table:
            raw = table.column("raw").to_pylist()
            counts, ids, lo = (np.asarray(table.column(c)) for c in ("n", "id", "lo"))
            sizes = np.array([len(r) for r in raw], np.int64)
            out = [(int(ids[r]), int(lo[r]) + a, int(lo[r]) + b + length) for r, a, b in runs_of(*repeats_in(np.cumsum(sizes) - sizes, counts, raw, ids, lo, length))]
            return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["id", "begin", "end"])

        shards = max(1, -(-firsts.where(F.col("contexts") <= HOT).count() // SHARD))
        cool = gathered.where(F.col("contexts") <= HOT).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        partial = cool.groupBy("shard").applyInArrow(shard, "id bigint, begin bigint, end bigint")

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, lo, n, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    sums = prefix_sums(np.frombuffer(raw, np.uint8))
                    at = np.arange(n)
                    yield pa.record_batch([pa.array(span_hashes(sums, at, at + length).view(np.int64)), pa.array(np.full(n, i)), pa.array(lo + at)], ["w", "id", "begin"])

        single = gathered.where(F.col("contexts") > HOT).select("id", "lo", "n", "raw").mapInArrow(each, "w bigint, id bigint, begin bigint")
        earliest = single.groupBy("w").agg(F.min(F.struct("id", "begin")).alias("first"))
        hot = single.join(earliest, "w").where((F.col("id") != F.col("first.id")) | (F.col("begin") != F.col("first.begin"))).select("id", "begin", (F.col("begin") + length).alias("end"))
        spans = retain(materialize(spans.unionByName(partial).unionByName(hot), "spans"))
    by_doc = spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            out: list[list] = [[], [], [], [], []]
            for t, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (t or "").encode("utf-8")
                parts, end, n_spans, removed, covered = [], 0, 0, 0, -1
                for r in runs or ():
                    a, b = r["begin"], r["end"]
                    if a > covered or covered < 0:
                        parts.append(raw[max(end, 0) : a])
                        n_spans += 1
                        removed += b - a
                        covered = b
                    elif b > covered:
                        removed += b - covered
                        covered = b
                    end = covered
                parts.append(raw[end:])
                rest = b"".join(parts)
                for x, v in zip(out, (len(raw), removed, n_spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if kept else None), strict=True):
                    x.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([batch.column(0), batch.column(3), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], ["id", "row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        trim_memory()

    joined = whole.join(by_doc, "id", "left").select("id", "text", "spans", "row")
    row = joined.schema["row"].dataType.simpleString()
    made = joined.mapInArrow(finish, f"id bigint, row {row}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")
    return made.select(F.col("id").alias(id_col), *[F.col("row")[c].alias(c) for c in keep], "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * kept)
