"""Removal of repeated byte strings by fingerprints of sampled grams.

A byte goes if a string of ``length`` bytes that covers it also starts
anywhere else in the corpus, the same document included.  This is not
bucket-pointer refinement, which it replaces: nothing is sorted on the buckets
of later offsets and no update is used again.  Minimum-hash q-grams are
sampled, whole runs are grouped by a polynomial hash of all their bytes, and
the rest is settled in one step by a hash of the whole string.

1. Initial buckets are q-grams of ``length // 2 + 1`` bytes, but only at
   sampled offsets: of every window of starts the gram with the least hash.  A
   string of ``length`` bytes holds a whole window, so equal strings have the
   same sampled gram at the same offset, and consecutive starts that share a
   sample form one run.  (A suffix array over every byte would shuffle tens of
   times the input; the runs hold about two in a hundred bytes.)
2. The identifier of a run is the bucket of its gram together with that of
   everything from its first start to the end of its last string.  Equal
   runs of one chunk of text are counted before anything is shuffled.  Runs alone
   in their gram's bucket are unique.  Runs whose whole identifier occurs again
   repeat at each of their starts.
3. Where a gram's bucket holds different runs, one of each kind is refined
   start by start: the identifier of a start is its gram's bucket, its offset
   from it and the bucket of its whole string.  Starts whose identifier occurs
   in two kinds of runs repeat.  Buckets with more than ``HOT`` kinds are
   refined over all tasks, the others each in the task that holds them.

Buckets are named by 64-bit hashes.  Null texts are empty; texts shorter than
``length`` repeat nothing; repeated rows repeat each other.  Results come back
by a hash of doc_id and text, so repeated rows get equal results.  Empty
tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, small_side, stored
from .shingles import chunks, mix, powers

LENGTH = 200
HOT = 20_000
CHUNK = 1 << 21
#: Texts that a Python worker holds at a time.
TEXT_ROWS = 1000
_BYTES = np.random.default_rng(7).integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)
_OFFSET = np.uint64(0xD6E8FEB86659FD93)


class Hashes:
    """Hashes of the strings of a buffer."""

    def __init__(self, buf: np.ndarray):
        up, self.down = powers(len(buf) + 1)
        self.total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTES[buf] * up[:len(buf)], out=self.total[1:])

    def of(self, start, end) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])

    def grams(self, q: int) -> np.ndarray:
        return mix((self.total[q:] - self.total[:-q]) * self.down[:len(self.total) - q])


def sampled_runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, gram bucket, run identifier, offset of the sample in its text,
    sample minus first start, sample minus last start) of the runs of all texts."""
    q = length // 2 + 1
    window = length - q + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if not (sizes >= length).any():
        return (np.zeros(0, np.int64),) * 6
    hashes = Hashes(buf)
    grams = hashes.grams(q)
    least = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    span = 1
    while 2 * span <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[:span - window], least[window - span:])
    valid = np.ones(len(least), bool)
    for b, n in zip(begin.tolist(), sizes.tolist()):
        valid[max(b, b + n - length + 1):b + n] = False
    at = np.flatnonzero(valid)
    sample = (_LOW - (least[at] & _LOW)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (sample[1:] != sample[:-1]) | (at[1:] != at[:-1] + 1))))
    first, last, sample = at[cut], at[np.append(cut[1:], len(at)) - 1], sample[cut]
    text = np.searchsorted(begin, first, side="right") - 1
    shape = ((sample - first) * 1024 + (sample - last)).astype(np.uint64)
    run = mix(hashes.of(first, last + length) + mix(shape * _OFFSET))
    return text, grams[sample], run, sample - begin[text], sample - first, sample - last


def _bytes(texts) -> Iterator[bytes]:
    return (t.encode() if isinstance(t, str) else b"" for t in texts)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))


def all_runs(docs: DataFrame, length: int) -> DataFrame:
    """(gram, run, k, rid, loc, spans) of the runs of the corpus.  Equal runs of one
    chunk of text are one row with their number ``k``, so what a corpus repeats
    everywhere is not shuffled once for each time.  ``rid`` and ``loc`` are those of
    one of them (loc packs the sample's offset, and how far before it the first and
    the last start are); ``spans`` has the bytes that all of them cover, if k > 1."""

    def run(batches):
        for b in batches:
            rid, row = b["rid"].to_numpy(), 0
            for part in chunks(_bytes(b["text"]), CHUNK):
                text, gram, ident, at, back, ahead = sampled_runs(part, length)
                doc, row = rid[row + text], row + len(part)
                order = np.lexsort((at, doc, ident, gram))
                gram, ident, doc, at, back, ahead = (x[order] for x in (gram, ident, doc, at, back, ahead))
                new = np.ones(len(gram), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (ident[1:] != ident[:-1])
                first = np.flatnonzero(new)
                k = np.diff(np.append(first, len(gram)))
                # stretches of the runs that are there more than once
                many = np.repeat(k > 1, k)
                group, r, begin, end = (x[many] for x in (np.repeat(np.arange(len(k)), k), doc, at - back, at - ahead + length))
                cut = np.ones(len(group), bool)
                cut[1:] = (group[1:] != group[:-1]) | (r[1:] != r[:-1]) | (begin[1:] > end[:-1])
                s = np.flatnonzero(cut)
                e = np.append(s[1:], len(group)) - 1 if len(s) else s
                packed = np.stack((r[s], begin[s], end[e]), axis=1).astype(np.int64)
                edge = np.searchsorted(group[s], np.flatnonzero(k > 1), side="left").tolist() + [len(s)]
                spans = np.full(len(k), None, object)
                for i, g in enumerate(np.flatnonzero(k > 1).tolist()):
                    spans[g] = packed[edge[i]:edge[i + 1]].tobytes()
                yield pd.DataFrame({"gram": gram[first].view(np.int64), "run": ident[first].view(np.int64), "k": k, "rid": doc[first],
                                    "loc": ((at << 20) | (back << 10) | ahead)[first], "spans": spans})

    return keyed(docs).select("rid", "text").mapInPandas(run, "gram bigint, run bigint, k bigint, rid bigint, loc bigint, spans binary")


def start_identifiers(gram: np.ndarray, loc: np.ndarray, context: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(identifier, row, start offset in its text) of every start of the given runs."""
    back, ahead, at = (loc >> 10) & 1023, loc & 1023, loc >> 20
    count = back - ahead + 1
    begin = np.cumsum([0, *map(len, context)])[:-1]
    hashes = Hashes(np.frombuffer(b"".join(context), np.uint8))
    row = np.repeat(np.arange(len(loc)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    string = hashes.of(begin[row] + step, begin[row] + step + length)
    offset = (back[row] - step).astype(np.uint64)
    return mix(string + mix(gram.view(np.uint64)[row] + offset * _OFFSET)), row, at[row] - back[row] + step


def _stretches(rid: np.ndarray, start: np.ndarray, length: int) -> pd.DataFrame:
    """Consecutive starts of one text as (rid, begin, end) of the bytes they cover."""
    order = np.lexsort((start, rid))
    rid, start = rid[order], start[order]
    cut = np.flatnonzero(np.concatenate(([True], (rid[1:] != rid[:-1]) | (start[1:] > start[:-1] + 1)))) if len(rid) else np.zeros(0, np.int64)
    last = np.append(cut[1:], len(rid)) - 1 if len(cut) else cut
    return pd.DataFrame({"rid": rid[cut], "begin": start[cut], "end": start[last] + length})


def refine(kinds: DataFrame, length: int) -> DataFrame:
    """(rid, begin, end) of the repeated stretches of the runs (gram, rid, loc, context),
    one run of each kind, that share grams with others."""

    def run(batches):
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            gram = b["gram"].to_numpy()
            done = int(np.searchsorted(gram, gram[-1]))  # the last bucket may go on
            held = b.iloc[done:]
            if done:
                yield decide(b.iloc[:done])
        if held is not None and len(held):
            yield decide(held)

    def decide(f: pd.DataFrame) -> pd.DataFrame:
        ident, row, start = start_identifiers(f["gram"].to_numpy(), f["loc"].to_numpy(), f["context"].tolist(), length)
        _, inverse, count = np.unique(ident, return_inverse=True, return_counts=True)
        again = count[inverse] > 1
        return _stretches(f["rid"].to_numpy()[row[again]], start[again], length)

    dealt = kinds.select("gram", "rid", "loc", "context").repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInPandas(run, "rid bigint, begin bigint, end bigint")


def refine_hot(kinds: DataFrame, length: int) -> DataFrame:
    """The same for buckets with very many kinds of runs: by start, over all tasks."""

    def run(batches):
        for f in batches:
            ident, row, start = start_identifiers(f["gram"].to_numpy(), f["loc"].to_numpy(), f["context"].tolist(), length)
            yield pd.DataFrame({"ident": ident.view(np.int64), "rid": f["rid"].to_numpy()[row], "begin": start})

    starts = kinds.select("gram", "rid", "loc", "context").mapInPandas(run, "ident bigint, rid bigint, begin bigint")
    again = starts.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ident"))).filter("n > 1")
    return again.select("rid", "begin", (F.col("begin") + length).alias("end"))


def repeated_stretches(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, begin, end): stretches of bytes to remove; they may overlap."""
    same_gram, same_run = Window.partitionBy("gram"), Window.partitionBy("gram", "run")
    runs = all_runs(docs, length)
    runs = runs.withColumn("in_gram", F.sum("k").over(same_gram)).filter("in_gram > 1")
    runs = runs.withColumn("in_run", F.sum("k").over(same_run))
    runs = runs.withColumn("kind", (F.col("in_gram") > F.col("in_run")) & (F.row_number().over(same_run.orderBy("rid", "loc")) == 1))
    runs = stored(runs.filter("kind or in_run > 1").select(F.when(F.col("kind"), F.col("gram")).alias("gram"), "rid", "loc", "spans", (F.col("in_run") > 1).alias("dup")), "runs", TEXT_ROWS)

    def unpack(batches):
        for b in batches:
            one = b["spans"].isna().to_numpy()
            loc, rid = b["loc"].to_numpy()[one], b["rid"].to_numpy()[one]
            at, back, ahead = loc >> 20, (loc >> 10) & 1023, loc & 1023
            more = np.frombuffer(b"".join(b["spans"][~one]), np.int64).reshape(-1, 3)
            yield pd.DataFrame({"rid": np.concatenate((rid, more[:, 0])), "begin": np.concatenate((at - back, more[:, 1])),
                                "end": np.concatenate((at - ahead + length, more[:, 2]))})

    whole = runs.filter("dup").select("rid", "loc", "spans").mapInPandas(unpack, "rid bigint, begin bigint, end bigint")

    # the bytes of one run of each kind, where a gram has several
    kinds = runs.filter("gram is not null")
    hot = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > HOT).select("gram")
    lists = kinds.groupBy("rid").agg(F.collect_list(F.struct("gram", "loc")).alias("kinds"))  # bounded by the text
    lists = stored(lists, "kinds")
    texts = keyed(docs).select("rid", "text").join(small_side(lists.select("rid")), "rid", "left_semi").join(lists, "rid")

    def cut(batches):
        for b in batches:
            out: list[tuple] = []
            for rid, text, want in zip(b["rid"], _bytes(b["text"]), b["kinds"]):
                for k in want:
                    a, n, m = k["loc"] >> 20, k["loc"] >> 10 & 1023, k["loc"] & 1023
                    out.append((k["gram"], rid, k["loc"], text[a - n:a - m + length]))
            yield pd.DataFrame(out, columns=["gram", "rid", "loc", "context"])

    pieces = stored(texts.select("rid", "text", "kinds").mapInPandas(cut, "gram bigint, rid bigint, loc bigint, context binary"), "pieces", TEXT_ROWS)
    hot = small_side(stored(hot, "hot"))
    partly = refine(pieces.join(hot, "gram", "left_anti"), length).unionByName(refine_hot(pieces.join(hot, "gram", "left_semi"), length))
    return whole.unionByName(partly)


def remove_repeats(docs: DataFrame, length: int = LENGTH, bytes_too: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with
    ``bytes_too``, kept (the remaining bytes, which need not be valid UTF-8)."""
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:5 + bytes_too]
    stretches = repeated_stretches(docs, length).groupBy("rid").agg(F.collect_list(F.struct("begin", "end")).alias("cuts"))  # bounded by the text

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text, cuts in zip(b["doc_id"], _bytes(b["text"]), b["cuts"]):
                kept, at, spans, upto = [], 0, 0, -1
                for s, e in sorted((c["begin"], c["end"]) for c in cuts) if cuts is not None else ():
                    if s > upto:
                        kept.append(text[at:s])
                        spans += 1
                    upto = at = max(upto, e)
                kept = b"".join(kept) + text[at:]
                rows.append((doc_id, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)[:len(columns)])
            yield pd.DataFrame(rows, columns=columns)

    rows = keyed(docs).join(stretches, "rid", "left").select(id_text("doc_id"), "text", "cuts")
    out = rows.mapInPandas(run, "doc_id string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * bytes_too)
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))
