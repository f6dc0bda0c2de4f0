"""Packing documents into windows by non-negative least squares.

Documents become token ids and are cut into pieces of a whole window and one
remainder (``tokenise``, stored).  The histogram of piece lengths, at most one
row per length, goes to the driver, whatever the corpus' size.  There

1. shallow combinations that fill a window exactly are enumerated: ``m`` pieces
   of one length, or ``m`` of one and one or two of another;
2. non-negative least squares gives each a repeat count, so that together they
   come close to the histogram (``solve``);
3. counts are rounded to what is there, and what is left over is filled
   greedily with the same combinations;
4. the residual pieces, longest first, fill windows one after another and are
   cut where a window ends.  The last, shorter stretch is cut into sequences of
   a power of two, which need no padding.

The plan (``Slot`` rows, bounded by the window's length) says which ranks of a
length go where.  A piece's rank among those of its length is its number inside
the task that made it plus the pieces of that length in earlier tasks, so no
length, however frequent, is numbered in one task.

Null texts are empty: a document without tokens still has its end token.  A
null id stays null; repeated rows are separate documents; an empty table gives
no pieces.  Texts are tokenised whole; a long one only costs more pieces.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .common import small_side, stored

WINDOW = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Rows handed to a Python worker at a time, and bytes of text tokenised at a time.
DOC_ROWS, CHUNK = 512, 8_000_000
#: Words whose ids a worker remembers, and words tokenised in one call.
REMEMBERED, CALL = 1_000_000, 10_000
STEPS = 400

_BLANKS = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
_LOWER_BLANKS = bytes(b + 32 if 65 <= b <= 90 else b for b in _BLANKS)
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_MARK = np.array([chr(b) in ".,;:!?" for b in range(256)])


class Lexicon:
    """A tokenizer and the ids of the words it has met, at most REMEMBERED and those of
    one chunk of text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        ids, sizes = [self.ids], [self.sizes]
        for k in range(0, len(words), CALL):
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(words[k:k + CALL], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)))
            ids.append(np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes[-1].sum())))
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)

    def look_up(self, words: list[str]) -> np.ndarray:
        fresh = [w for w in words if w not in self.at]
        if len(self.at) + len(fresh) > REMEMBERED:
            self.forget()
            fresh = words
        if fresh:
            self.learn(fresh)
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))


@lru_cache(maxsize=2)
def _lexicon(path: str) -> Lexicon:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Lexicon(path)


def encode_texts(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of all texts, one after another, and the number of ids of each.

    No token crosses white space, nor the place between a letter (ASCII or Latin-1)
    and one of ``.,;:!?`` before white space, and the tokenizer ignores case, but for
    the names of its own tokens: so each different word is tokenised once."""
    whole = b" ".join(texts) + b" "
    data = np.frombuffer(whole.translate(_BLANKS if b"<|" in whole else _LOWER_BLANKS), np.uint8)
    blank = data == 32
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    if not len(ends):
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    marks = ends[ends > 2] - 1
    marks = marks[_MARK[data[marks]]]
    before, two_before = data[marks - 1], data[marks - 2]
    marks = marks[_LETTER[before] | ((two_before == 0xC3) & (before != 0x97) & (before != 0xB7) & (before >= 0x80))]
    ends = np.sort(np.concatenate((ends, marks)), kind="stable")
    offsets = np.concatenate(([0], np.cumsum(~blank, dtype=np.int32)[ends - 1]))
    words = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data[~blank])]).dictionary_encode()
    lexicon = _lexicon(path)
    at = lexicon.look_up(words.dictionary.to_pylist())[words.indices.to_numpy()]
    n = lexicon.sizes[at]
    total = np.concatenate(([0], np.cumsum(n)))
    starts = (np.cumsum(lexicon.sizes) - lexicon.sizes)[at]
    ids = lexicon.ids[np.repeat(starts - total[:-1], n) + np.arange(total[-1])]
    # a word belongs to the text in which it ends
    upto = np.cumsum(np.array([len(t) + 1 for t in texts]))
    per_text = np.diff(np.concatenate(([0], total[np.searchsorted(ends, upto, side="left")])))
    return ids, per_text


def with_end(ids: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """END_ID after each text."""
    sizes = per_text + 1
    out = np.full(int(sizes.sum()), END_ID, np.uint32)
    own = np.ones(len(out), bool)
    own[np.cumsum(sizes) - 1] = False
    out[own] = ids
    return out, sizes


def tokenise(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Pieces of at most ``window`` ids: doc_id, start, length, doc_tokens, the task
    (``part``) and the piece's number among those of its length there (``nth``), ids
    as little-endian 32-bit numbers and their crc32.  Stored."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("doc_tokens", T.LongType()), T.StructField("part", T.LongType()),
                           T.StructField("nth", T.LongType()), T.StructField("ids", T.BinaryType())])

    def pieces(doc_ids: pa.Array, texts: list[bytes], part: int, seen: np.ndarray) -> pa.RecordBatch:
        ids, sizes = with_end(*encode_texts(texts, path))
        count = -(-sizes // window)
        doc = np.repeat(np.arange(len(sizes)), count)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * window
        length = np.minimum(sizes[doc] - start, window)
        order = np.argsort(length, kind="stable")
        first = np.searchsorted(length[order], length[order])
        nth = np.empty(len(doc), np.int64)
        nth[order] = np.arange(len(doc)) - first
        nth += seen[length]
        seen += np.bincount(length, minlength=window + 1)
        ends = np.concatenate(([0], np.cumsum(length) * 4)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [doc_ids.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(sizes[doc]),
             pa.array(np.full(len(doc), part)), pa.array(nth),
             pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])],
            names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        ids: list[pa.Array] = []
        texts: list[bytes] = []
        size = 0
        for b in batches:
            begin = 0
            for i, t in enumerate(b.column(1)):
                texts.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
                size += len(texts[-1]) + 1
                if size > CHUNK:
                    yield pieces(pa.concat_arrays([*ids, b.column(0)[begin:i + 1]]), texts, part, seen)
                    begin, size, texts, ids = i + 1, 0, [], []
            ids.append(b.column(0)[begin:])
        if texts:
            yield pieces(pa.concat_arrays(ids), texts, part, seen)

    made = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
    return stored(made.withColumn("crc", F.crc32("ids")), "tokens", DOC_ROWS)


class Slot(NamedTuple):
    """Ranks ``lo`` to ``hi`` of a length.  With ``repeats``: rank lo + j * repeats + i
    goes to sequence ``base + i``, at ``offset + j * length``.  Without: one after another
    from token ``offset`` of the residual on."""
    length: int
    lo: int
    hi: int
    repeats: int
    base: int
    offset: int


def combinations(present: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """Shallow combinations (a, m, b, k): m pieces of length a and k of length b fill a
    window; k is 0 where a alone does.  Only lengths that are there often enough."""
    a = np.flatnonzero(present[:window])
    a = a[a > 0]
    m = np.minimum(present[a], (window // np.maximum(a, 1)))
    rows = np.repeat(a, m)
    times = np.arange(len(rows)) - np.repeat(np.cumsum(m) - m, m) + 1
    out = []
    left = window - rows * times
    for k in (0, 1, 2, 3):
        if k == 0:
            keep, b = left == 0, np.zeros(len(rows), np.int64)
        else:
            b = left // k
            keep = (left > 0) & (left % k == 0) & (b != rows)
            keep &= np.where(keep, present[b], 0) >= k
            # the same set from both sides counts once
            keep &= (times > k) | ((times == k) & (rows > b))
        out.append(np.stack((rows[keep], times[keep], b[keep], np.full(int(keep.sum()), k))))
    return list(np.concatenate(out, axis=1))


def solve(present: np.ndarray, combos: list[np.ndarray], steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts x with A x near the histogram, by accelerated
    projected gradient steps; column i of A holds m at a and k at b."""
    a, m, b, k = combos
    x = np.zeros(len(a))
    if not len(a):
        return x
    size = len(present)
    h = present.astype(float)
    # rows are scaled by the root of their column sums, so one step length suits all
    load = np.bincount(a, m * (m + k), size) + np.bincount(b, k * (m + k), size)
    rate = 1 / np.maximum(m * load[a] + k * load[b], 1) * (m + k)
    y, t = x, 1.0
    for _ in range(steps):
        rest = np.bincount(a, m * y, size) + np.bincount(b, k * y, size) - h
        rest[0] = 0
        new = np.maximum(0, y - rate * (m * rest[a] + k * rest[b]))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


class Plan(NamedTuple):
    slots: list[Slot]
    #: The residual's first sequence, and where its last, shorter sequences begin and end.
    base: int
    edges: list[int]


def plan(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    """Where the pieces of each length go."""
    present = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        present[length] = n
    left = present.tolist()
    slots = [Slot(window, 0, left[window], left[window], 0, 0)] if left[window] else []
    base, left[window] = left[window], 0
    combos = combinations(present, window)
    x = solve(present, combos)
    order = np.argsort(-x, kind="stable")
    rows = list(zip(*[c[order].tolist() for c in combos], x[order].tolist()))
    for rounding in (True, False):
        for a, m, b, k, want in rows:
            most = min(left[a] // m, left[b] // k) if k else left[a] // m
            n = min(most, int(want + 0.5)) if rounding else most
            if n <= 0:
                continue
            offset = 0
            for length, times in ((a, m), (b, k)):
                if times:
                    lo = int(present[length]) - left[length]
                    slots.append(Slot(length, lo, lo + n * times, n, base, offset))
                    left[length] -= n * times
                    offset += length * times
            base += n
    at = 0
    for length in range(window - 1, 0, -1):
        if left[length]:
            hi = int(present[length])
            slots.append(Slot(length, hi - left[length], hi, 0, base, at))
            at += length * left[length]
    edges = [at - at % window]
    while edges[-1] < at:
        edges.append(edges[-1] + (1 << (at - edges[-1]).bit_length() - 1))
    return Plan(slots, base, edges)


class Packing(NamedTuple):
    """``pieces``: doc_id, start, length, doc_tokens, sequence_id, offset, and the stored
    piece they are of (part, whole, nth, whole_start).  ``tokens``: the stored pieces."""
    pieces: DataFrame
    tokens: DataFrame


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> Packing:
    """Every token of ``docs`` in exactly one place of one sequence."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    tokens = tokenise(docs, window, path)
    narrow = tokens.drop("ids")
    per_part = stored(narrow.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # at most one row per length
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(histogram, window)
    earlier = Window.partitionBy("length").orderBy("part")
    offsets = per_part.withColumn("before", F.sum("n").over(earlier) - F.col("n")).drop("n")
    ranked = narrow.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    slots = spark.createDataFrame(made.slots, "slot_length bigint, lo bigint, hi bigint, repeats bigint, base bigint, at bigint")
    hit = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.join(F.broadcast(slots), hit)  # bounded by the window, not by the corpus
    place = F.col("rank") - F.col("lo")
    keep = ["doc_id", F.col("start").alias("whole_start"), F.col("length").alias("whole"), "doc_tokens", "part", "nth", "crc"]
    whole = placed.filter("repeats > 0").select(
        *keep, "start", "length", (F.col("base") + place % F.col("repeats")).alias("sequence_id"),
        (F.col("at") + F.expr("(rank - lo) div repeats") * F.col("length")).alias("offset"))
    edges = F.array(*[F.lit(e).cast("bigint") for e in made.edges])
    run = placed.filter("repeats = 0").withColumn("p", F.col("at") + place * F.col("length")).withColumn("q", F.col("p") + F.col("length"))
    inside = lambda c: (c > F.col("p")) & (c < F.col("q"))
    window_end = (F.expr(f"p div {window}") + 1) * window
    cuts = F.concat(F.array("p", "q"), F.filter(F.array(window_end), lambda c: inside(c) & (c <= made.edges[0])), F.filter(edges, inside))
    run = run.withColumn("cuts", F.array_sort(F.array_distinct(cuts)))
    run = run.select("*", F.posexplode(F.slice("cuts", F.lit(1), F.size("cuts") - 1)).alias("i", "from"))
    tail = F.size(F.filter(edges, lambda e: e <= F.col("from"))) - 1  # which of the last, shorter sequences
    last = F.col("from") >= made.edges[0]
    cut = run.select(
        *keep, (F.col("start") + F.col("from") - F.col("p")).alias("start"),
        (F.element_at("cuts", F.col("i") + 2) - F.col("from")).alias("length"),
        (F.col("base") + F.when(last, F.lit(made.edges[0] // window) + tail).otherwise(F.expr(f"`from` div {window}"))).alias("sequence_id"),
        F.when(last, F.col("from") - F.element_at(edges, tail + 1)).otherwise(F.col("from") % window).alias("offset"))
    return Packing(whole.unionByName(cut), tokens)


def ids_of(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """``pieces`` with their token ids."""
    own = tokens.select("part", F.col("length").alias("whole"), "nth", F.col("ids").alias("all_ids"))
    cut = F.expr("substring(all_ids, cast((start - whole_start) * 4 + 1 as int), cast(length * 4 as int))")
    return pieces.join(own, ["part", "whole", "nth"]).withColumn("ids", cut).drop("all_ids")


def checksums(packing: Packing) -> DataFrame:
    """Pieces with the crc32 of their ids: that of the stored piece where it is whole;
    of the cut ones the ids are read; those are at most one for a residual window and
    are broadcast if a count allows it."""
    whole = packing.pieces.filter("length = whole").withColumnRenamed("crc", "ids_crc32")
    cut = ids_of(small_side(packing.pieces.filter("length < whole").drop("crc")), packing.tokens)
    return whole.unionByName(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
