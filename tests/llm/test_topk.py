import math
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerwalk.llm import topk


def brute(rows, is_query, k):
    vecs = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(1024 * x) for x in v]
        vecs[i] = min(vecs.get(i, q), q)
    out = []
    for i in vecs:
        if is_query(i):
            s = sorted((-sum(a * b for a, b in zip(vecs[i], v)), j) for j, v in vecs.items() if j != i)
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


def test_equals_brute_force_with_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]  # one very common vector: ties
    rows += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8),
             (2100, []), (2101, [0.3, 0.1]), (5, [9.0] * 8), (5, [9.0] * 8), (-100, [0.2] * 8), (2200, [0.0] * 8)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id bigint, embedding array<double>, v string, b int")
    got = topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 100 == 0, 10, block=128, query_block=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 100 == 0, 10)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}


def test_fewer_rows_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id bigint, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(topk.integer_vectors(df), F.col("vec_id") == 0).collect()))
    assert got == [(0, 1, 1, 2 * 1024 * 1024), (0, 2, 2, -1024 * 1024)]
    assert topk.top_k(topk.integer_vectors(df.limit(0)), F.col("vec_id") == 0).count() == 0


def test_values_beyond_exact_doubles():
    q, x = np.array([[2 ** 40, 1]]), np.array([[2 ** 20, 5], [2 ** 20, 6], [-2 ** 20, 7]])
    _, vi, score = topk.nra_block(np.array([9]), q, np.array([1, 2, 3]), x, 2)
    assert vi.tolist() == [1, 0] and score.tolist() == [2 ** 60 + 6, 2 ** 60 + 5]


def test_reading_stops_early():
    """Lists whose ends decide: few vectors are resolved, and the answer is exact."""
    rng = np.random.default_rng(1)
    x = np.rint(rng.normal(0, 20, (4000, 16))).astype(np.int64)
    x[:12] += 400
    q = np.full((3, 16), 50)
    qi, vi, score = topk.nra_block(np.array([-1, -2, -3]), q, np.arange(4000), x, 10)
    full = q @ x.T
    for i in range(3):
        best = sorted(zip((-full[i]).tolist(), range(4000)))[:10]
        assert [(-s, j) for s, j in zip(score[qi == i].tolist(), vi[qi == i].tolist())] == best
