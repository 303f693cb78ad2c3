"""Mixing sources to target weights: certain whole copies first, then Pareto order sampling of the rest.

A source of `source_size` words that is due `target` words has the rate target / source_size. Each of its documents is
taken floor(rate) times for certain; the remaining words come from one more copy of some documents. A document's inclusion
probability p is in proportion to its size, 1 at most, such that the words expected are those due; c in p = min(1, c * size)
follows from the source's counts by size. Documents of probability 1 are certain too. The others are ranked by
(u / (1 - u)) / (p / (1 - p)), with u a hash of the document, and taken in this order as long as they don't pass the words
due. What is missing then comes from one more document, the one of those left whose size is nearest to it (the first by
rank on a tie), if that brings the source nearer to its target: targets are met closely even where documents are large.

No source is sorted as a whole: words are summed by source and rank bucket, and the bucket in which the sum crosses what
is due is found in that small table, BUCKETS rows a source; then once more over the finer buckets within it. Only the
documents of one fine bucket, one in BUCKETS * BUCKETS of a source, are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.llm.common import materialize, retain, scratch, words

WEIGHTS = (5.0, 2.0, 1.0)
#: Copies of a document, and so words of a source, at most.
MOST_COPIES = 3
#: Rank buckets of a source, and finer ones of a bucket.
BUCKETS = 256


def source_targets(sized: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """source, source_size, target: the words of all sources, shared by weight; no target is over `most` times its source's
    size, and the excess goes to the other sources by weight.

    With the sources in the order of most * size / weight, those that are capped come first: for each number of capped
    sources the share of the others follows, and the right number is the least with which no other is above its cap."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.select(
        "source", "source_size", "w", "cap",
        ((F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))).alias("level"),
    )
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(every)["level"]
    return levels.withColumn("share", first).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("share") * F.col("w"), F.col("cap"))).alias("target"))


def inclusion_rates(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """For sources that are due words c_source, c, largest and start: the words of all documents, each by min(1, c * size),
    sum to what is due; those above the size `largest` are certain and have `start` words.

    With the sizes in falling order, those that are capped come first: for each number of them c follows from the rest, and
    the right number is the least with which no other size is capped. A source has a row for each distinct size."""
    sizes = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").cast("double").alias("n")).withColumnRenamed("source", "c_source")
    sizes = sizes.join(plan.where("due > 0").select("source", "due"), F.col("c_source").eqNullSafe(F.col("source"))).drop("source")
    falling = Window.partitionBy("c_source").orderBy(F.desc("size"))
    capped = F.coalesce(F.sum(F.col("n") * F.col("size")).over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum(F.col("n") * F.col("size") * F.col("size")).over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    tried = sizes.select("c_source", "size", capped.alias("start"), ((F.col("due") - capped) / free).alias("c")).where(F.col("c") * F.col("size") <= 1)
    return tried.groupBy("c_source").agg(F.max_by("c", "size").alias("c"), F.max("size").alias("largest"), F.max_by("start", "size").alias("start"))


def bucket_of(odds: Column, buckets: int) -> Column:
    """Rank bucket: the odds ratio, taken back to 0 to 1."""
    return F.least(F.lit(buckets - 1), F.floor(odds / (odds + 1) * buckets)).cast("int")


def crossing_bucket(ranked: DataFrame, bucket: str) -> DataFrame:
    """Of each source the bucket in which its words, after `start`, reach what is due: c_source, c_bucket, before."""
    sums = ranked.groupBy("source", "due", "start", bucket).agg(F.sum("size").alias("words"))
    before = F.col("start") + F.sum("words").over(Window.partitionBy("source").orderBy(bucket)) - F.col("words")
    found = sums.withColumn("before", before).where("before < due and before + words >= due")
    return materialize(found.select(F.col("source").alias("c_source"), F.col(bucket).alias("c_bucket"), "before"), "crossing")


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, id_col: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """One row a document: id, the columns of keep, size, source_size, target, copies and taken (size times copies).

    Null texts have size 0 and are taken as often as their source's certain copies; a source without words has target 0
    and no copies. A null source is a source of its own, after all others. Rows that agree in id, source, size and text are
    ties, of which any may be taken; a repeated run takes the same number. An empty table gives an empty result."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    sized = docs.select("id", "source", *[f"keep_{c}" for c in keep], F.size(words(F.col("text"))).cast("bigint").alias("size"), F.xxhash64(F.lit(7), "id", "source", "text").alias("h"))
    same = F.col("source").eqNullSafe(F.col("c_source"))
    with scratch(spark):
        sized = retain(materialize(sized, "sized"))
        targets = materialize(source_targets(sized, weights, most), "targets")
        rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        plan = targets.withColumn("rate", F.least(rate, F.lit(float(most)))).withColumn("whole", F.floor("rate").cast("int")).withColumn("due", (F.col("rate") - F.col("whole")) * F.col("source_size"))
        plan = plan.join(inclusion_rates(sized, plan), same, "left").drop("c_source")
        plan = retain(materialize(plan, "plan"))
        sure = F.coalesce(F.col("size") > F.col("largest"), F.lit(False))
        p = F.when(~sure, F.least(F.lit(1.0), F.col("c") * F.col("size")))
        u = (F.shiftrightunsigned(F.col("h"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        odds = F.when(F.col("p") >= 1, F.lit(0.0)).when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
        ranked = sized.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("s").withColumn("p", p).withColumn("rank", odds).withColumn("whole", F.col("whole") + sure.cast("int"))
        ranked = ranked.withColumn("coarse", bucket_of(F.col("rank"), BUCKETS)).withColumn("bucket", bucket_of(F.col("rank"), BUCKETS * BUCKETS))
        first = crossing_bucket(ranked.where("p > 0"), "coarse")
        crossing = retain(crossing_bucket(ranked.drop("start").join(first.withColumnRenamed("before", "start"), same & (F.col("coarse") == F.col("c_bucket"))), "bucket"))
        key = F.struct("rank", "id", "size", "h")
        order = Window.partitionBy("source", "bucket").orderBy("rank", "id", "size", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = ranked.join(crossing, same, "left")
        edge = F.coalesce(F.col("bucket") == F.col("c_bucket"), F.lit(False))
        summed = placed.where(edge).withColumn("sum", F.col("before") + F.sum("size").over(order))
        fits = F.col("sum") <= F.col("due")
        reached = summed.groupBy("c_source").agg((F.max("due") - F.greatest(F.max("before"), F.coalesce(F.max(F.when(fits, F.col("sum"))), F.lit(0.0)))).alias("missing"), F.max(F.when(fits, key)).alias("last"))
        reached = materialize(reached, "reached")
        later = placed.drop("c_source").join(reached, same).where((F.col("bucket") > F.col("c_bucket")) | (edge & F.coalesce(key > F.col("last"), F.lit(True))))
        nearest = later.groupBy("c_source", "missing").agg(F.min(F.struct(F.abs(F.col("size") - F.col("missing")).alias("off"), *[F.col(c) for c in ("rank", "id", "size", "h")])).alias("x"))
        closing = retain(materialize(nearest.where("x.off < missing").select("c_source", F.struct("x.rank", "x.id", "x.size", "x.h").alias("closing")), "closing"))
    placed = placed.drop("c_source").join(closing, same, "left").drop("c_source")
    inside = F.coalesce(F.col("bucket") < F.col("c_bucket"), F.lit(False))
    last = F.coalesce(key.eqNullSafe(F.col("closing")), F.lit(False))  # of repeated rows one closes
    out = lambda df, extra: df.select("id", "source", *[f"keep_{c}" for c in keep], "size", "source_size", "target", (F.col("whole") + extra.cast("int")).alias("copies"))
    nth = F.row_number().over(Window.partitionBy("source", "rank", "id", "size", "h").orderBy("bucket"))
    at_edge = placed.where(edge | last).withColumn("sum", F.col("before") + F.sum("size").over(order)).withColumn("nth", nth)
    done = out(placed.where(~(edge | last)), inside).unionByName(out(at_edge, (edge & fits) | (last & (F.col("nth") == 1))))
    named = [F.col("id").alias(id_col), F.col("source").alias(source) if source in keep else None, *[F.col(f"keep_{c}").alias(c) for c in keep if c not in (id_col, source)]]
    return done.select(*[c for c in named if c is not None], "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
