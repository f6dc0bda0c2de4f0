"""Mixing sources to target weights by weighted fair queueing.  [native]

Each source is a queue of its documents in a shuffled order that depends on
the document only, repeated up to ``max_epochs`` times.  A document copy's
virtual finish time is the source's cumulative words up to its end divided by
the source's target; serving copies in order of virtual time gives every
source words in proportion to its target, and cutting the global order at
virtual time 1 is cutting it at the total budget.  The copy that a cut falls
into is taken in part.

Targets: the sources, by code point with null last, weigh ``weights`` in
turn and share the sum of all sizes; no target exceeds ``max_epochs`` times
its source's size, and the excess is shared by weight among the others until
none is above.

The running totals of a queue are never computed in one task: the shuffled
order is cut into ranges of about ``RANGE_ROWS`` documents, ranges are summed,
their offsets added up, and each range is numbered by itself.  Only the table
of sources (one row each) is ordered as a whole.

Null texts count 0 words, null sources are a source of their own, repeated
rows are separate documents, an empty table gives an empty mix.  Extra
columns pass through ``mix_stream``; its own are ``copy``, ``copy_words`` and
``virtual_finish``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, carried, stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
RANGE_ROWS = 4000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("bigint")


def mix_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with target.  One row per source: both windows
    below order that small table as a whole."""
    by_source, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    turn = F.array(*[F.lit(int(w)) for w in weights])
    t = sizes.withColumn("w", F.element_at(turn, F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights))) + 1).cast("bigint"))
    t = t.withColumn("cap", F.col("source_size") * max_epochs)
    # sources in the order in which a rising common level fills them up
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = (t.withColumn("budget", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
         .withColumn("rest", F.col("budget") - (F.sum("cap").over(upto) - F.col("cap")))
         .withColumn("rest_w", F.col("all_w") - (F.sum("w").over(upto) - F.col("w")))
         .withColumn("i", F.row_number().over(order))
         .withColumn("free", F.col("rest") * F.col("w") <= F.col("cap") * F.col("rest_w")))
    level = F.min(F.when(F.col("free"), F.struct("i", "rest", "rest_w"))).over(everything)
    t = t.withColumn("level", level)
    share = (F.col("w") * F.col("level.rest")).cast("double") / F.col("level.rest_w")
    target = F.when(F.col("level").isNull() | (F.col("i") < F.col("level.i")), F.col("cap").cast("double")).otherwise(share)
    return t.select("source", "source_size", target.alias("target"))


def queue_positions(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, tag, size) -> with source_size, target and ``before``, the
    words that stand before the document in its source's shuffled queue."""
    order_key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = stored(docs.withColumn("okey", order_key), "sizes")
    ranges = max(1, -(-docs.count() // RANGE_ROWS))
    head = F.conv(F.substring("okey", 1, 8), 16, 10).cast("bigint")
    docs = docs.withColumn("range", F.shiftright(head * ranges, 32))
    per_range = docs.groupBy("source", "range").agg(F.sum("size").alias("words"))
    per_range = stored(per_range, "ranges")
    targets = mix_targets(per_range.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    up = Window.partitionBy("source").orderBy("range")
    per_range = per_range.withColumn("ahead", F.sum("words").over(up) - F.col("words"))
    facts = per_range.alias("r").join(targets.alias("t"), F.expr("r.source <=> t.source")).select(
        F.col("r.source").alias("_source"), F.col("range").alias("_range"), "ahead", "source_size", "target")
    facts = stored(facts, "offsets")
    within = Window.partitionBy("source", "range").orderBy("okey", "size", "tag")
    docs = docs.withColumn("inside", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    docs = docs.join(facts, F.expr("source <=> _source and range = _range"))
    return docs.withColumn("before", F.col("ahead") + F.col("inside")).drop("_source", "_range", "ahead", "inside", "range", "okey")


def copy_words(copy: Column) -> Column:
    """Words that the mix takes of a document's copy: what is left of the target
    at the copy's start, at most the document."""
    start = copy * F.col("source_size") + F.col("before")
    return F.least(F.greatest(F.floor("target") - start, F.lit(0).cast("bigint")), F.col("size"))


def virtual_finish(copy: Column) -> Column:
    return F.when(F.col("target") > 0, (copy * F.col("source_size") + F.col("before") + F.col("size")) / F.col("target"))


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document with its size, its source's size and target, the words
    taken and the virtual finish time of its first copy, range-sorted by that time."""
    rows = queue_positions(docs.select("doc_id", F.col("source").cast("string").alias("source"),
                                       F.xxhash64("text").alias("tag"), n_words(F.col("text")).alias("size")), weights, max_epochs)
    taken = sum((copy_words(F.lit(e)) for e in range(1, max_epochs)), copy_words(F.lit(0)))
    out = rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"),
                      virtual_finish(F.lit(0)).alias("virtual_finish"))
    return out.orderBy(F.col("virtual_finish").asc_nulls_last(), "doc_id")


def mix_stream(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: every taken copy of every document, whole rows, in order of
    virtual finish time.  A copy that the budget cuts stays if at least half of it fits."""
    own = [c for c in docs.columns if c.lower() not in ("copy", "copy_words", "virtual_finish")]
    keyed = carried(docs).withColumn("_tag", F.xxhash64("_row.text"))
    pos = stored(queue_positions(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("tag"),
                                             n_words(F.col("text")).alias("size")), weights, max_epochs), "positions")
    copies = pos.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    copies = copies.withColumn("copy_words", copy_words(F.col("copy"))).withColumn("virtual_finish", virtual_finish(F.col("copy")))
    copies = copies.filter((F.col("size") > 0) & (F.col("copy_words") * 2 >= F.col("size")))
    same = "_row.doc_id <=> _id and cast(_row.source as string) <=> _src and _tag = tag"
    right = copies.select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), "tag", "copy", "copy_words", "virtual_finish", "before")
    repeats = stored(pos.groupBy("doc_id", "source", "tag").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeats")
    if repeats.limit(1).count():
        # rows equal in id, source and text are interchangeable: number them on both sides
        keyed = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_row.doc_id", "_row.source", "_tag").orderBy(F.lit(1))))
        right = right.withColumn("_m", F.dense_rank().over(Window.partitionBy("_id", "_src", "tag").orderBy("before")))
        same += " and _n = _m"
    out = keyed.join(right, F.expr(same)).orderBy("virtual_finish", "_id", "copy")
    return out.select(*[F.col("_row")[c].alias(c) for c in own], "copy", "copy_words", "virtual_finish")
