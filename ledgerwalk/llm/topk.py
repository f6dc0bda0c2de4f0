"""Exact top-k inner-product search by no-random-access aggregation.

Vectors are cut into blocks; in a block every dimension is a list sorted by
value.  A query reads its lists from their good ends (large values where its
weight is positive, small ones where it is negative), all to the same depth.
What has been read of a vector, plus the worst or best value that the rest of
each list allows, bounds its score from below and above.  A vector whose upper
bound is under the k-th lower bound cannot qualify; reading goes on, twice as
deep each time, until few enough are left, and their scores are resolved.
Results of the blocks are merged: a vector among the k best of all is among
the k best of its block.

Blocks of queries meet blocks of vectors, so neither side is broadcast and the
memory of a task is bounded by ``BLOCK`` and ``QUERY_BLOCK``.

Scores are exact integers.  Vectors that are null or hold null or non-finite
components take no part; vectors of unequal length are compared as if padded
with zeros.  An id counts once: of several rows with one id the smallest
vector is used; rows with a null id take no part.  Equal scores go to the
smaller id.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
QUERY_BLOCK = 256
SCALE = 1024


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): components floor(1024 * x), one row per id."""
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    v = F.transform(x, lambda e: F.floor(e * SCALE))
    return (df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.when(x.isNotNull() & finite, v).alias("v"))
            .filter("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v")))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def nra_block(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vector index, score) of the k best vectors of a block for each query."""
    n, dims = x.shape
    own = qid[:, None] == vid[None, :]
    big = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(dims, 1) >= 2 ** 53
    if big:  # beyond exact doubles: whole numbers of any size
        score = np.clip(q.astype(object) @ x.astype(object).T, -2 ** 63, 2 ** 63 - 1).astype(np.int64)
        qi, vi = np.nonzero(~own)
        return _best(qi, vi, score[qi, vi], vid, k)
    qp, qn = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    xf = x.astype(float)
    lists = np.sort(xf, axis=0)
    depth = max(2 * k, n // 8)
    while True:
        alive = ~own
        if depth < n:
            top, bottom, low, high = lists[n - depth], lists[depth - 1], lists[0], lists[-1]
            read_top, read_bottom = xf >= top, xf <= bottom
            lower = qp @ np.where(read_top, xf, low).T + qn @ np.where(read_bottom, xf, high).T
            upper = qp @ np.where(read_top, xf, top).T + qn @ np.where(read_bottom, xf, bottom).T
            lower[own] = -np.inf
            kth = np.partition(lower, n - k, axis=1)[:, n - k]
            alive &= upper >= kth[:, None]
        if depth >= n or alive.sum() <= max(8 * k * len(q), n * len(q) // 50):
            break
        depth *= 2
    qi, vi = np.nonzero(alive)
    score = np.concatenate([np.einsum("ij,ij->i", q[qi[i:i + 65536]], x[vi[i:i + 65536]]) for i in range(0, len(qi), 65536)] or [np.zeros(0, np.int64)])
    return _best(qi, vi, score, vid, k)


def _best(qi: np.ndarray, vi: np.ndarray, score: np.ndarray, vid: np.ndarray, k: int):
    order = np.lexsort((vid[vi], -score, qi))
    qi, vi, score = qi[order], vi[order], score[order]
    first = np.searchsorted(qi, qi)
    keep = np.arange(len(qi)) - first < k
    return qi[keep], vi[keep], score[keep]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other vectors for each row
    of ``vectors`` (vec_id, v) that ``is_query`` selects."""
    n, n_queries = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))

    def of(count: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    data = vectors.select("vec_id", "v", of(blocks).alias("b")).withColumn("qb", every(query_blocks))
    queries = vectors.filter(is_query).select("vec_id", "v", of(query_blocks).alias("qb")).withColumn("b", every(blocks))

    def search(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(xs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        width = max(max(map(len, qs["v"])), max(map(len, xs["v"])))
        x, vid, parts = _matrix(xs["v"].tolist(), width), xs["vec_id"].to_numpy(), []
        for i in range(0, len(qs), query_block):
            part = qs.iloc[i:i + query_block]
            qid = part["vec_id"].to_numpy()
            qi, vi, score = nra_block(qid, _matrix(part["v"].tolist(), width), vid, x, min(k, len(vid)))
            parts.append(pd.DataFrame({"query_id": qid[qi], "vec_id": vid[vi], "score": score}))
        return pd.concat(parts)

    found = queries.groupBy("b", "qb").cogroup(data.groupBy("b", "qb")).applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
