import hashlib
import random
import re
from collections import Counter

import pytest

from ledgerwalk.llm import repeats as R


def brute(rows, n):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p:p + n] for _, t in data for p in range(len(t) - n + 1))
    out = []
    for i, t in data:
        m = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if seen[t[p:p + n]] > 1:
                m[p:p + n] = b"\1" * n
        kept = bytes(c for c, x in zip(t, m) if not x)
        out.append((i, len(t), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df, n):
    return sorted(map(tuple, R.remove_repeats(df, n).drop("kept").collect()), key=str)


def test_equals_brute_force(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    small = odd_docs.filter("doc_id is null or doc_id <> 13")
    assert result(odd_docs.filter("doc_id = 13"), 200) == brute([r for r in rows if r[0] == 13], 200)
    assert result(small, 200) == brute([r for r in rows if r[0] != 13], 200)
    assert R.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("n,hot", [(20, 20_000), (21, 0), (5, 2), (200, 0)])
def test_match_ends_inside_runs(spark, monkeypatch, n, hot):
    """Pieces cut at any place, overlapping, with other neighbours, and periodic texts;
    refined in tasks or over all tasks."""
    rng = random.Random(n)
    monkeypatch.setattr(R, "HOT", hot)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(n, 5 * n))) for _ in range(6)]
    rows = []
    for i in range(60):
        t = ""
        for _ in range(rng.randrange(5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            t += p[a:a + rng.randrange(1, 4 * n)] + "".join(rng.choice("abcd") for _ in range(rng.randrange(3 * n)))
        rows.append((i, t))
    rows += [(100, "ab" * (2 * n)), (101, "x" * (3 * n)), (102, "x" * n), (103, None), (104, ""), (105, "y" * (n - 1)), (105, "y" * (n - 1)),
             (106, pool[0]), (106, pool[0]), (None, pool[1]), (107, "z" * n), (108, "é" * n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert result(df, n) == brute(rows, n)


def test_kept_bytes(spark):
    p = "0123456789" * 3
    df = spark.createDataFrame([(1, "left" + p + "right"), (2, "other" + p)], "doc_id bigint, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in R.remove_repeats(df, 25).collect()}
    assert got == {1: b"leftright", 2: b"other"}
