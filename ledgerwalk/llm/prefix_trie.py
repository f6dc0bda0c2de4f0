"""The prefix trie of conversations, by collapsing whole sequences.

Conversations are rebuilt (``rebuilt_turns``: a branch shares the first turns of
its base), every prefix gets a name, and identical rebuilt conversations become
one weighted sequence with the list of its ids.  A sequence whose name is the
name of another one's proper prefix is no leaf (an anti-join finds the leaves).
Prefixes of the sequences, with their weights, are aggregated by name into nodes.

Names are 128 bits: a turn counts with its place and the SHA-256 of its role and
text, and a prefix's name is the digest of the sums of four such 32-bit numbers.
Sums can be taken in any order, so a conversation of any length is numbered and
named in blocks: rows are range-partitioned by (conversation, turn), positions
come from counts per range, running sums from totals per ``BLOCK`` turns.  Sums
over a subtree need no list of ancestors either: each node lies on the chain of
its least leaf, so a subtree's total is that of the chains of its leaves without
the part of its own chain above it.

Rows of equal turn are ordered by the SHA-256 of role and text; a null turn comes
first; null role or text is empty; rows without conv_id take no part; an empty
table gives no nodes, not even a root.  Texts stay where they are until
``with_texts`` joins them back.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import ensure_checkpoint_dir
from .common import stored

#: Conversations of one base, and the most turns (plus one) that a branch shares.
FAMILY, SHARED = 100, 6
#: Turns summed at a time, and ids of an end list kept in one row.
BLOCK, LIST_ROWS = 1024, 4096
LISTS_AT_A_TIME = 64
WORDS = ("s0", "s1", "s2", "s3")


def turn_digest() -> Column:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(c, zone, place, t, n): every turn with its range, its place there (from 1), its
    digest and its code points.  Stored."""
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("c"), "turn", turn_digest().alias("t"),
        F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"), F.monotonically_increasing_id().alias("o"))
    turns = turns.repartitionByRange("c", "turn", "t", "o").withColumn("zone", F.spark_partition_id())
    turns = stored(turns, "turns")  # the ranges are fixed from here on
    order = Window.partitionBy("c", "zone").orderBy(F.col("turn").asc_nulls_first(), "t", "o")
    return turns.select("c", "zone", "t", "n", F.row_number().over(order).cast("bigint").alias("place"))


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (c, length) of each, also without turns, and
    (c, depth, length, t, n) of each of their turns.

    Conversation c takes the first h turns of its base c - c % FAMILY, h being
    crc32(decimal c) % SHARED, and its own turns after its first h."""
    turns = numbered_turns(conversations)
    zones = stored(turns.groupBy("c", "zone").agg(F.max("place").alias("rows")), "zones")
    own = zones.groupBy("c").agg(F.sum("rows").alias("own"))
    base = own.filter(F.col("c") % FAMILY == 0).select(F.col("c").alias("base"), F.col("own").alias("base_own"))
    convs = own.withColumn("base", F.col("c") - F.col("c") % FAMILY).withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % SHARED)
    convs = convs.join(base, "base", "left").withColumn("k", F.least("h", F.coalesce("base_own", F.lit(0).cast("bigint"))))
    length = F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("bigint"))
    convs = stored(convs.select("c", "base", "h", "k", length.alias("length")), "conversations")
    earlier = Window.partitionBy("c").orderBy("zone")
    facts = zones.withColumn("ahead", F.sum("rows").over(earlier) - F.col("rows")).drop("rows").join(convs, "c")
    placed = turns.join(facts, ["c", "zone"]).withColumn("pos", F.col("ahead") + F.col("place"))
    first = (F.col("c") % FAMILY == 0) & (F.col("pos") < SHARED)
    placed = stored(placed.filter(first | (F.col("pos") > F.col("h"))).select("c", "pos", "h", "k", "length", "t", "n"), "placed")
    heads = placed.filter(first).groupBy(F.col("c").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "t", "n"))).alias("head"))
    shared = convs.filter("k > 0").join(heads, "base").select("c", "length", F.explode(F.slice("head", F.lit(1), F.col("k").cast("int"))).alias("x"))
    tail = placed.filter(F.col("pos") > F.col("h")).withColumn("depth", F.col("pos") - F.col("h") + F.col("k"))
    tail = tail.select("c", "depth", "length", "t", "n")
    return convs.select("c", "length"), shared.select("c", F.col("x.pos").alias("depth"), "length", "x.t", "x.n").unionByName(tail)


def running(df: DataFrame, key: str, order: str, values: tuple[str, ...]) -> DataFrame:
    """``df`` with ``<value>_upto``: the sum of ``value`` over the rows of the same key up
    to and with this one, ``order`` counting from 0 without large gaps.  At most
    BLOCK rows, or the totals of BLOCK rows each, are ordered together."""
    df = df.withColumn("_block", F.expr(f"{order} div {BLOCK}"))
    inside = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = df.groupBy(key, "_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.partitionBy(key).orderBy("_block")
    totals = totals.select(key, "_block", *[(F.sum(f"_{v}").over(before) - F.col(f"_{v}")).alias(f"_{v}") for v in values])
    out = df.select("*", *[F.sum(v).over(inside).alias(f"_in_{v}") for v in values])
    out = out.join(totals.filter("_block > 0"), [key, "_block"], "left")
    for v in values:
        out = out.withColumn(f"{v}_upto", F.col(f"_in_{v}") + F.coalesce(f"_{v}", F.lit(0).cast("bigint")))
    return out.drop("_block", *[f"_{v}" for v in values], *[f"_in_{v}" for v in values])


def name_of(depth: Column, sums: list[Column]) -> Column:
    whole = F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums])
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))


def named_prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(c, depth, length, node, parent, t, n) of every prefix of every rebuilt
    conversation, the empty one included.  Stored."""
    low = F.lit(0xFFFFFFFF).cast("bigint")
    for i in (0, 1):
        h = F.xxhash64("depth", "t", F.lit(i))
        turns = turns.withColumn(WORDS[2 * i], h.bitwiseAND(low)).withColumn(WORDS[2 * i + 1], F.shiftrightunsigned(h, 32))
    summed = running(turns, "c", "depth", WORDS)
    here = [F.col(f"{w}_upto") for w in WORDS]
    above = [F.col(f"{w}_upto") - F.col(w) for w in WORDS]
    named = summed.select("c", "depth", "length", name_of(F.col("depth"), here).alias("node"),
                          name_of(F.col("depth") - 1, above).alias("parent"), "t", "n")
    zero = F.lit(0).cast("bigint")
    roots = convs.select("c", zero.alias("depth"), "length", name_of(zero, [zero] * 4).alias("node"),
                         F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("binary").alias("t"), zero.alias("n"))
    return stored(named.unionByName(roots), "prefixes")


class Trie(NamedTuple):
    """``nodes``: node, parent, conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and the digest ``t`` of the last turn.  ``ends``: (node,
    conv_id), the conversations that end at a node."""
    nodes: DataFrame
    ends: DataFrame


def prefix_trie(conversations: DataFrame) -> Trie:
    spark = conversations.sparkSession
    ensure_checkpoint_dir(spark)
    prefixes = named_prefixes(*rebuilt_turns(conversations))
    ends = prefixes.filter("depth = length").select("node", F.col("c").alias("conv_id"))
    # identical conversations: one sequence, under its smallest id
    sequences = stored(ends.groupBy("node").agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("weight")), "sequences")
    weighted = salted_join(prefixes, sequences.select("c", "weight"), "c", spread_by=["depth"])
    weighted = stored(weighted.drop("length"), "weighted")
    proper = weighted.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("node")).distinct()
    leaves = sequences.join(proper, "node", "left_anti").select("c", F.lit(1).cast("bigint").alias("leaf"))
    flagged = salted_join(weighted, leaves, "c", "left", spread_by=["depth"])
    nodes = flagged.groupBy("node").agg(
        F.max("parent").alias("parent"), F.min("c").alias("conv_id"), F.max("depth").alias("depth"), F.sum("weight").alias("n_convs"),
        F.count("leaf").alias("n_leaves"), F.min(F.when(F.col("leaf") == 1, F.col("c"))).alias("chain"), F.max("n").alias("n"), F.max("t").alias("t"))
    nodes = stored(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("n")), "nodes")
    nodes_run = running(nodes, "chain", "depth", ("saved",))
    # what the chains below a node hold; a node is on the chain of its least leaf
    chains = nodes.groupBy(F.col("chain").alias("c")).agg(F.sum("saved").alias("total")).filter("total > 0")
    below = salted_join(weighted.select("node", "c", "depth"), chains, "c", spread_by=["depth"])
    below = below.groupBy("node").agg(F.sum("total").alias("total"))
    children = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = salted_join(nodes_run, parents, "parent", "left", spread_by=["node"])
    zero = F.lit(0).cast("bigint")
    out = out.join(below, "node", "left").join(children, "node", "left")
    out = out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                     "n_leaves", (F.coalesce("total", zero) - (F.col("saved_upto") - F.col("saved"))).alias("saved_tokens"), "t")
    return Trie(out, ends)


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes with the role and text of their last turn (null at the root)."""
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        turn_digest().alias("t"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.groupBy("t").agg(F.max("role").alias("role"), F.max("text").alias("text"))
    return salted_join(nodes, turns, "t", "left", spread_by=["node"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of a node's end list, ids ascending and joined by
    commas.  A list is put together in rows of LIST_ROWS ids, each made on its own; the
    digest takes them one after another."""
    ranged = stored(ends.repartitionByRange("node", "conv_id").withColumn("zone", F.spark_partition_id()), "ends")
    place = F.row_number().over(Window.partitionBy("node", "zone").orderBy("conv_id"))
    rows = ranged.withColumn("row", F.floor((place - 1) / LIST_ROWS))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    rows = rows.groupBy("node", "zone", "row").agg(ids.alias("ids"))
    rows = rows.repartition("node").sortWithinPartitions("node", "zone", "row").select("node", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for name, ids in zip(b.column(0).to_pylist(), b.column(1)):
                if name != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())],
                                             names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    return stored(rows.mapInArrow(digest, "node binary, ends_sha256 string"), "digests", LISTS_AT_A_TIME)


def trie_report(trie: Trie) -> DataFrame:
    """The nodes with the digest of their end lists."""
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = trie.nodes.join(end_digests(trie.ends), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", none).alias("ends_sha256"))
