"""Exact n-gram Jaccard join with signature trees.

A document's set is its distinct 5-word shingles (64-bit hashes).  Documents
with equal sets are one class; classes are linked when 100 * intersection >=
80 * union, and a document's component is the smallest doc_id it reaches.

Routing is by prefix: order all shingles the same way everywhere; two sets
that link share one of their first ``n - ceil(0.8 n) + 1`` shingles.  Shingles
that many documents hold come last in that order, so a passage common to
unrelated documents routes nothing until a document consists of little else.
All classes that meet at a shingle form a cell.

1. The least class of a cell is compared with the others (one pair for each
   member, not all pairs): first by size and token bitmap, then by the sets.
   Linked classes are joined to components, which settles groups of copies.
2. Cells that still hold several components are searched with signature
   trees, twice: for the nearest mate of each class, and for all that is left
   when those are joined.  A node has the OR of its members' token bitmaps, the range of their
   sizes and the most tokens that share bits; the tree of a cell is traversed
   against itself, and a pair of nodes is left when sizes or the greatest
   possible overlap rule every link out, or when all members are of one
   component.  Surviving pairs are compared by their sets and components
   joined again.

Large cells are cut into blocks of ``BLOCK`` classes by size, and pairs of
blocks are separate groups, so no task holds a whole cell.  Which shingles
count as common only moves work: any choice gives the same links.

Null or empty texts have empty sets: n_shingles 0, linked with nothing, their
own component.  Texts of fewer than five words have one shingle, the whole
sequence.  Repeated rows are copies.  A null doc_id can be in a component but
never names one unless all its ids are null.  Empty tables give empty results.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, id_text, small_side, stored
from .shingles import chunks, shingle_sets

#: Counted locally from LOCAL_DF documents of a chunk on; at most MAX_COMMON of
#: the most frequent are put last in the order.
LOCAL_DF = 2
COMMON_DF = 12
MAX_COMMON = 1_000_000
BLOCK = 2048
LEAF = 32
FANOUT = 4
#: Texts, or pairs of sets, that a Python worker holds at a time.
TEXT_ROWS = 1000


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def bitmap(tokens: np.ndarray) -> bytes:
    """Token bitmap of 4 to 8 bits a token (a power of two of at least 64)."""
    bits = max(64, 1 << int(4 * len(tokens) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(tokens >> np.uint64(24)) & np.uint64(bits - 1)] = 1
    return np.packbits(out).tobytes()


def digests(tokens: np.ndarray) -> tuple[int, int]:
    """Two halves of a set's 128-bit digest."""
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def digest(tokens: np.ndarray, met: frozenset[int] = frozenset()) -> int:
    """A class' name: the first half of its digest, the second where different sets
    were seen to meet in the first (``met``)."""
    first, second = digests(tokens)
    return second if first in met else first


def _sets(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(row number, set) of a batch's texts."""
    row = 0
    for part in chunks(t.encode() if isinstance(t, str) else b"" for t in batch["text"]):
        for s in shingle_sets(part):
            yield row, s
            row += 1


def class_facts(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: a document (doc_id, h, n, cls, second, bits) or a shingle that
    is locally common (token, df)."""

    def run(batches):
        held, seen, size = [], set(), 0

        def common():
            token, df = np.unique(np.concatenate(held), return_counts=True)
            keep = df >= LOCAL_DF
            return pd.DataFrame({"doc_id": None, "h": 0, "n": 0, "cls": 0, "second": 0, "bits": None, "token": token[keep].view(np.int64), "df": df[keep]})

        for b in batches:
            n, cls, other, bits = [], [], [], []
            for _, s in _sets(b):
                d, d2 = digests(s) if len(s) else (0, 0)
                n.append(len(s))
                cls.append(d)
                other.append(d2)
                bits.append(bitmap(s) if len(s) else None)
                if len(s) and d not in seen:  # exact copies count once
                    seen.add(d)
                    held.append(s)
                    size += len(s)
                if size > 2_000_000:
                    yield common()
                    held, seen, size = [], set(), 0
            yield pd.DataFrame({"doc_id": b["doc_id"], "h": b["h"], "n": n, "cls": cls, "second": other, "bits": bits, "token": 0, "df": 0})
        if held:
            yield common()

    rows = docs.select(id_text("doc_id"), F.xxhash64("text").alias("h"), "text")
    out = rows.mapInPandas(run, "doc_id string, h bigint, n int, cls bigint, second bigint, bits binary, token bigint, df bigint")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def met_digests(facts: DataFrame) -> frozenset[int]:
    """First halves that sets of different second halves have: of n classes about
    n * n / 2**65, none below some 10**9."""
    some = facts.filter("n > 0").groupBy("cls").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).filter("lo < hi")
    return frozenset(r["cls"] for r in some.select("cls").collect())


def common_tokens(facts: DataFrame) -> np.ndarray:
    """The sorted shingles to be put last: at most MAX_COMMON."""
    df = facts.filter("df > 0").groupBy("token").agg(F.sum("df").alias("df")).filter(F.col("df") >= COMMON_DF)
    top = df.orderBy(F.col("df").desc(), "token").limit(MAX_COMMON).select("token").toPandas()
    return np.sort(top["token"].to_numpy(np.int64).view(np.uint64))


def prefixes(docs: DataFrame, common: np.ndarray, met: frozenset[int]) -> DataFrame:
    """(token, cls, n) for the prefix of every class, at least once."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most MAX_COMMON numbers

    def run(batches):
        last, done = shared.value, set()
        for b in batches:
            tokens, cls, size = [], [], []
            for _, s in _sets(b):
                if not len(s) or (d := digest(s, met)) in done:
                    continue
                done.add(d)
                p = prefix_length(len(s))
                at = np.searchsorted(last, s)
                is_last = np.zeros(len(s), bool) if not len(last) else last[np.minimum(at, len(last) - 1)] == s
                first = s[~is_last][:p]
                tokens.append(first if len(first) == p else np.concatenate((first, s[is_last][:p - len(first)])))
                cls.append(d)
                size.append(len(s))
            if tokens:
                count = [len(t) for t in tokens]
                yield pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "cls": np.repeat(np.array(cls, np.int64), count), "n": np.repeat(np.array(size, np.int32), count)})
            if len(done) > 200_000:
                done.clear()

    return docs.select("text").mapInPandas(run, "token bigint, cls bigint, n int")


def cells(postings: DataFrame) -> DataFrame:
    """Rows (a, b, cell): a pair of the least class of a cell and another member
    (cell null), or a member ``a`` of a cell of three or more (b null).  Cells
    with the same members are one cell as far as a task sees them."""

    def run(batches):
        pairs: set[tuple[int, int]] = set()
        known: set[int] = set()
        token, lead, lead_n, prev = None, 0, 0, None  # the cell being read
        held: np.ndarray | None = None  # its members of the batch before
        long = False

        for b in batches:
            t, c, n = (b[x].to_numpy() for x in ("token", "cls", "n"))
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            if token is not None and t[0] == token and c[0] == prev:
                new[0] = False
            t, c, n = t[new], c[new], n[new]
            if not len(t):
                continue
            out_pairs, out_members, out_names = [], [], []
            edge = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1], [True])))
            many = np.diff(edge) > 1
            many[0] = True
            many[-1] = True
            for i in np.flatnonzero(many).tolist():
                s, e = int(edge[i]), int(edge[i + 1])
                tok = int(t[s])
                members, sizes = c[s:e], n[s:e]
                goes_on = token == tok
                if not goes_on:
                    if held is not None and (long or len(held) > 2):
                        name = token if long else digest(held)
                        if long or name not in known:
                            known.add(name)
                            out_members.append(held)
                            out_names.append(np.full(len(held), name, np.int64))
                    token, lead, lead_n, held, long = tok, int(members[0]), int(sizes[0]), None, False
                    rest, rest_n = members[1:], sizes[1:]
                else:
                    rest, rest_n = members, sizes
                fits = 5 * np.minimum(rest_n, lead_n) >= 4 * np.maximum(rest_n, lead_n)
                for x in rest[fits].tolist():
                    if (lead, x) not in pairs:
                        pairs.add((lead, x))
                        out_pairs.append((lead, x))
                if goes_on and held is not None:
                    out_members.append(held)
                    out_names.append(np.full(len(held), tok, np.int64))
                    long = True
                held = members
            prev = int(c[-1])
            if out_pairs:
                a, o = zip(*out_pairs)
                yield pd.DataFrame({"a": a, "b": o, "cell": None}).astype({"a": "Int64", "b": "Int64", "cell": "Int64"})
            if out_members:
                yield pd.DataFrame({"a": np.concatenate(out_members), "b": None, "cell": np.concatenate(out_names)}).astype({"a": "Int64", "b": "Int64", "cell": "Int64"})
            if len(pairs) > 200_000:
                pairs.clear()
            if len(known) > 200_000:
                known.clear()
        if held is not None and (long or len(held) > 2):
            yield pd.DataFrame({"a": held, "b": None, "cell": token}).astype({"a": "Int64", "b": "Int64", "cell": "Int64"})

    dealt = postings.repartition("token").sortWithinPartitions("token", "cls")
    return dealt.mapInPandas(run, "a bigint, b bigint, cell bigint")


def fold(m: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) brought to ``words`` words by OR of their parts."""
    while m.shape[1] > words:
        half = m.shape[1] // 2
        m = m[:, :half] | m[:, half:]
    return m


def _words(bits: bytes) -> np.ndarray:
    # the index of a bit is taken modulo the width, so halves fold onto each other
    return np.frombuffer(bits, np.uint64)


def may_link(na: int, a: bytes, nb: int, b: bytes) -> bool:
    """Whether sizes and bitmaps allow a link: bits that differ are tokens that differ."""
    if 5 * min(na, nb) < 4 * max(na, nb):
        return False
    x, y = _words(a)[None], _words(b)[None]
    width = min(x.shape[1], y.shape[1])
    return 9 * int(np.bitwise_count(fold(x, width) ^ fold(y, width)).sum()) <= na + nb


class Tree:
    """A signature tree over classes ordered by size: levels of (first, last) member
    ranges with the OR of the bitmaps, the sizes' range and the greatest number of
    tokens that share bits."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, comp: np.ndarray):
        self.n, self.bits, self.comp = n, bits, comp
        count = np.bitwise_count(bits).sum(1).astype(np.int64)
        lo = np.arange(0, len(n), LEAF)
        hi = np.minimum(lo + LEAF, len(n))
        self.levels = []
        excess = np.maximum.reduceat(n - count, lo)
        signature = np.bitwise_or.reduceat(bits, lo, axis=0)
        one = np.array([comp[i] if (comp[i:j] == comp[i]).all() else -1 for i, j in zip(lo, hi)], dtype=object)
        while True:
            self.levels.append((lo, hi, signature, n[lo], n[hi - 1], excess, one))
            if len(lo) == 1:
                return
            at = np.arange(0, len(lo), FANOUT)
            end = np.minimum(at + FANOUT, len(lo)) - 1
            one = np.array([one[i] if one[i] != -1 and all(o == one[i] for o in one[i:j + 1]) else -1 for i, j in zip(at, end)], dtype=object)
            lo, hi = lo[at], hi[end]
            signature = np.bitwise_or.reduceat(signature, at, axis=0)
            excess = np.maximum.reduceat(excess, at)


def dual_traversal(p: Tree, q: Tree, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index arrays of the members of two trees (or of one against itself) that may
    link, and how many bits of theirs differ."""
    todo = [(len(p.levels) - 1, 0, len(q.levels) - 1, 0)]
    while todo:
        lp, i, lq, j = todo.pop()
        plo, phi, psig, pmin, pmax, pex, pone = (x[i] for x in p.levels[lp])
        qlo, qhi, qsig, qmin, qmax, qex, qone = (x[j] for x in q.levels[lq])
        if pone != -1 and pone == qone or 5 * pmax < 4 * qmin or 5 * qmax < 4 * pmin:
            continue
        overlap = min(int(np.bitwise_count(psig & qsig).sum()) + int(min(pex, qex)), int(pmax), int(qmax))
        if 9 * overlap < 4 * int(pmin + qmin):
            continue
        if lp == 0 and lq == 0:
            a, b = np.arange(plo, phi), np.arange(qlo, qhi)
            differ = np.bitwise_count(p.bits[a][:, None] ^ q.bits[b][None]).sum(2).astype(np.int64)
            na, nb = p.n[a][:, None], q.n[b][None]
            ok = (9 * differ <= na + nb) & (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)) & (p.comp[a][:, None] != q.comp[b][None])
            if same:
                ok &= a[:, None] < b[None]
            x, y = np.nonzero(ok)
            if len(x):
                yield a[x], b[y], differ[x, y]
            continue
        down_p = lp >= lq and lp > 0
        level, at, side = (lp, i, p) if down_p else (lq, j, q)
        below = range(at * FANOUT, min(at * FANOUT + FANOUT, len(side.levels[level - 1][0])))
        for k in below:
            nxt = (lp - 1, k, lq, j) if down_p else (lp, i, lq - 1, k)
            todo.append(nxt)


def surviving_pairs(x: pd.DataFrame, y: pd.DataFrame | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of classes of one block, or of two, that may link and are of different
    components, and how many bits differ.  Bitmaps are compared at the smaller width
    of two adjoining ones."""

    def by_width(f: pd.DataFrame):
        width = f["bits"].map(len)
        return {w: g.sort_values(["n", "cls"]) for w, g in f.groupby(width)}

    def tree(g: pd.DataFrame, width: int) -> Tree:
        m = fold(np.stack([_words(b) for b in g["bits"]]), width // 8)
        return Tree(g["n"].to_numpy(np.int64), m, g["comp"].to_numpy())

    left = by_width(x)
    right = left if y is None else by_width(y)
    for wp, gp in left.items():
        for wq, gq in right.items():
            if not wp // 2 <= wq <= 2 * wp or (y is None and wq < wp):
                continue
            w = min(wp, wq)
            for a, b, d in dual_traversal(tree(gp, w), tree(gq, w), y is None and wp == wq):
                yield gp["cls"].to_numpy()[a], gq["cls"].to_numpy()[b], d


def leaf_pairs(f: pd.DataFrame, size: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same for many cells of at most LEAF members at once: trees of one leaf."""
    n, cls, comp = f["n"].to_numpy(np.int64), f["cls"].to_numpy(), f["comp"].to_numpy()
    width = f["bits"].map(len).to_numpy()
    first, second = [], []
    for m in np.unique(size):
        i, j = np.triu_indices(int(m), 1)
        at = start[size == m][:, None]
        first.append((at + i).ravel())
        second.append((at + j).ravel())
    x, y = np.concatenate(first), np.concatenate(second)
    ok = (comp[x] != comp[y]) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y]))
    x, y = x[ok], y[ok]
    swap = cls[x] > cls[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    order = np.lexsort((cls[y], cls[x]))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (cls[x][1:] != cls[x][:-1]) | (cls[y][1:] != cls[y][:-1])
    x, y = x[new], y[new]
    row = np.zeros(len(f), np.int64)
    held = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        row[at] = np.arange(len(at))
        held[w] = np.frombuffer(b"".join(f["bits"].iloc[at]), np.uint64).reshape(len(at), w // 8)
    for wx in held:
        for wy in held:
            w = min(wx, wy)
            pick = np.flatnonzero((width[x] == wx) & (width[y] == wy))
            left, right = fold(held[wx], w // 8), fold(held[wy], w // 8)
            for k in range(0, len(pick), max(1, (1 << 22) // w)):
                a, b = x[pick[k:k + (1 << 22) // w]], y[pick[k:k + (1 << 22) // w]]
                differ = np.bitwise_count(left[row[a]] ^ right[row[b]]).sum(1).astype(np.int64)
                keep = 9 * differ <= n[a] + n[b]
                yield cls[a[keep]], cls[b[keep]], differ[keep]


def search_cells(members: DataFrame, sketch: DataFrame, nearest: bool) -> DataFrame:
    """(a, b) candidates of the cells (cell, cls, n, comp): all that may link, or with
    ``nearest`` only the one of each class whose bitmap is nearest."""
    at = Window.partitionBy("cell").orderBy("n", "cls")
    rows = members.withColumn("blk", F.floor((F.row_number().over(at) - 1) / BLOCK).cast("int"))
    # a class whose neighbours by size are too small and too large has no mate here
    rows = rows.withColumn("below", F.lag("n").over(at)).withColumn("above", F.lead("n").over(at))
    rows = rows.filter("5 * below >= 4 * n or 5 * n >= 4 * above").drop("below", "above")
    rows = rows.withColumn("top", F.max("blk").over(Window.partitionBy("cell")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("top"))))
    rows = rows.withColumn("i", F.least("blk", "other")).withColumn("j", F.greatest("blk", "other"))

    def groups(f: pd.DataFrame) -> np.ndarray:
        """Where groups of (cell, i, j) begin, and the end."""
        k = f[["cell", "i", "j"]].to_numpy()
        return np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(1), [True])))

    def found(f: pd.DataFrame, edge: np.ndarray) -> pd.DataFrame:
        size, start = np.diff(edge), edge[:-1]
        small = size <= LEAF
        out = list(leaf_pairs(f, size[small], start[small])) if small.any() else []
        for s, m in zip(start[~small].tolist(), size[~small].tolist()):
            g = f.iloc[s:s + m]
            if g["i"].iloc[0] == g["j"].iloc[0]:
                out += surviving_pairs(g)
            elif g["blk"].nunique() == 2:
                out += surviving_pairs(g[g["blk"] == g["i"]], g[g["blk"] == g["j"]])
        if not out:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        a, b, d = (np.concatenate(z).astype(np.int64) for z in zip(*out))
        if nearest:
            both, mate = np.concatenate((a, b)), np.concatenate((b, a))
            order = np.lexsort((mate, np.concatenate((d, d)), both))
            first = np.concatenate(([True], both[order][1:] != both[order][:-1])) if len(order) else np.zeros(0, bool)
            a, b = both[order][first], mate[order][first]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    def run(batches):
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            edge = groups(b)
            held = b.iloc[edge[-2]:]  # the last group may go on; it has at most two blocks
            if len(edge) > 2:
                yield found(b, edge[:-1])
        if held is not None and len(held):
            held = held.reset_index(drop=True)
            yield found(held, groups(held))

    # the bitmaps join last: they are shuffled once
    rows = rows.join(sketch.select("cls", "bits"), "cls")
    dealt = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return dealt.select("cell", "i", "j", "blk", "cls", "n", "bits", "comp").mapInPandas(run, "a bigint, b bigint")


def linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, met: frozenset[int]) -> DataFrame:
    """Those of the pairs (a, b) of classes that link, by their whole sets."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    chosen = stored(classes.join(needed, "cls").select(F.col("rep.doc_id").alias("_id"), F.col("rep.h").alias("_h")), "representatives")
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(
        small_side(chosen), F.expr("doc_id <=> _id and h = _h"), "left_semi").select("text")

    def sets(batches):
        for b in batches:
            found = [s for _, s in _sets(b) if len(s)]
            yield pd.DataFrame({"cls": [digest(s, met) for s in found], "tokens": [s.tobytes() for s in found]})

    held = stored(texts.mapInPandas(sets, "cls bigint, tokens binary").groupBy("cls").agg(F.first("tokens").alias("tokens")), "sets", TEXT_ROWS)
    both = pairs.join(held.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), "a")
    both = both.join(held.select(F.col("cls").alias("b"), F.col("tokens").alias("y")), "b")

    def check(batches):
        for f in batches:
            ok = []
            for x, y in zip(f["x"], f["y"]):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(s) + len(t) - len(np.union1d(s, t))
                ok.append(100 * common >= 80 * (len(s) + len(t) - common))
            yield f.loc[ok, ["a", "b"]]

    return both.select("a", "b", "x", "y").mapInPandas(check, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(cls, comp): the least class that each end of an edge reaches.  Every round takes
    the least label among the neighbours and then the label's own label."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "cls"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("cls")).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, F.col("cls") == F.col("a")).select("cls", "comp", F.least("comp", "near").alias("new"))
        jump = step.alias("s").join(labels.select(F.col("cls").alias("l"), F.col("comp").alias("lc")), F.col("s.new") == F.col("l"))
        moved = stored(jump.select("s.cls", F.least("s.new", "lc").alias("comp"), (F.least("s.new", "lc") < F.col("s.comp")).alias("moved")), "labels")
        labels = moved.drop("moved")
        if not moved.filter("moved").limit(1).count():
            return labels


def jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, component_id, component) of every row of ``docs``
    (doc_id, text); ``component`` names the component by class, null for empty sets."""
    facts = stored(class_facts(docs), "facts", TEXT_ROWS)
    met = met_digests(facts)
    if met:
        facts = facts.withColumn("cls", F.when(F.col("cls").isin(*met), F.col("second")).otherwise(F.col("cls")))
    documents = facts.filter("df = 0").select("doc_id", "h", "n", "cls")
    classes = stored(facts.filter("df = 0 and n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min(F.struct("doc_id", "h")).alias("rep")), "classes")
    found = stored(cells(prefixes(docs, common_tokens(facts), met)), "cells", 4 * TEXT_ROWS)

    sketch = classes.select("cls", "n", "bits")
    pairs = stored(found.filter("cell is null").select("a", "b").distinct(), "pairs")
    with_a = pairs.join(sketch.withColumnsRenamed({"cls": "a", "n": "na", "bits": "xa"}), "a")
    with_b = with_a.join(sketch.withColumnsRenamed({"cls": "b", "n": "nb", "bits": "xb"}), "b")

    def prune(batches):
        for f in batches:
            keep = [may_link(*r) for r in zip(f["na"], f["xa"], f["nb"], f["xb"])]
            yield f.loc[keep, ["a", "b"]]

    candidates = stored(with_b.mapInPandas(prune, "a bigint, b bigint"), "candidates")
    links = stored(linked(candidates, classes, docs, met), "links", TEXT_ROWS)
    comp = components(links)

    # cells in which more than one component is left: first the nearest of each class,
    # which joins most of what belongs together, then all that is left
    members = found.filter("cell is not null").select("cell", F.col("a").alias("cls")).distinct()
    members = stored(members.join(sketch.select("cls", "n"), "cls"), "members")
    tested = pairs
    for nearest in (True, False):
        placed = members.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        mixed = placed.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("cell")
        open_cells = placed.join(mixed, "cell", "left_semi")
        more = stored(search_cells(open_cells, sketch, nearest).distinct().join(tested, ["a", "b"], "left_anti"), "survivors", 4 * TEXT_ROWS)
        if more.limit(1).count():
            links = links.unionByName(stored(linked(more, classes, docs, met), "links", TEXT_ROWS))
            tested = tested.unionByName(more)
            comp = components(links)
    named = classes.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_class = stored(named.join(names, "comp").select("cls", "component_id", "comp"), "components")
    out = documents.join(of_class, "cls", "left")
    return out.select("doc_id", "h", F.col("n").cast("bigint").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      F.when(F.col("n") > 0, F.col("comp")).alias("component"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id.  Rows
    without words are in no component and all stay."""
    rows = stored(jaccard_join(docs), "joined").filter("component is not null")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("keep")
    kept = rows.groupBy("component").agg(least).select(F.col("component").alias("_c"), F.col("keep.doc_id").alias("_id"), F.col("keep.h").alias("_h"))
    copies = rows.groupBy("component", "doc_id", "h").agg(F.count(F.lit(1)).alias("rows"))
    copies = copies.join(kept, F.expr("component = _c and doc_id <=> _id and h = _h"), "left")
    gone = small_side(stored(copies.filter("_c is null").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct(), "gone"))
    again = small_side(stored(copies.filter("_c is not null and rows > 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct(), "repeated"))
    same = F.expr("_row.doc_id <=> _id and _hash = _h")
    left = carried(docs).withColumn("_hash", F.xxhash64("_row.text")).join(gone, same, "left_anti")
    single, repeated = left.join(again, same, "left_anti"), left.join(again, same, "left_semi")
    return single.unionByName(repeated.withColumn("_key", F.struct("_row.doc_id", "_hash")).dropDuplicates(["_key"]).drop("_key")).select("_row.*")
