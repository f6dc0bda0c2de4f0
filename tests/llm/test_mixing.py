import re
from collections import Counter, defaultdict

import pytest

from ledgerwalk.llm import mixing as M


def fill(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, capped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return target
        rest = left - sum(target[s] for s in capped)
        for s in free:
            target[s] = rest * w[s] / sum(w[f] for f in free)
        over = [s for s in free if target[s] > cap * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = cap * sizes[s]
            capped.add(s)


def test_mix(odd_docs, no_docs):
    rows = odd_docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    target = fill(sizes)
    got = M.mix_documents(odd_docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r["source"] for r in rows if r["doc_id"] not in (None, 2)}
    taken, seen = defaultdict(int), defaultdict(set)
    for g in got:
        assert 0 <= g["taken"] <= 3 * g["size"]
        if g["doc_id"] in by_id:
            s = by_id[g["doc_id"]]
            assert g["source_size"] == sizes[s] and g["target"] == pytest.approx(target[s], rel=1e-9)
        seen[g["source_size"]].add(g["target"])
        taken[g["source_size"]] += g["taken"]
    assert all(len(v) == 1 for v in seen.values())
    for size, t in seen.items():  # each source's words come to its target, exactly
        assert taken[size] == int(next(iter(t)))
    assert sorted(map(tuple, M.mix_documents(odd_docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert M.mix_documents(no_docs).count() == 0


def test_targets_when_most_are_capped(spark):
    df = spark.createDataFrame([("a", 1), ("b", 10), ("c", 1000), (None, 0)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in M.mix_targets(df).collect()}
    want = fill({"a": 1, "b": 10, "c": 1000, None: 0})
    assert got == pytest.approx(want)


def test_stream_is_ordered_and_whole(odd_docs, no_docs):
    extra = odd_docs.withColumnRenamed("rid", "copy").withColumnRenamed("wid", "_n")
    got = M.mix_stream(extra).collect()
    times = [r["virtual_finish"] for r in got]
    assert times == sorted(times)
    words = Counter()
    for r in got:
        size = len(r["text"].split())
        assert 2 * r["copy_words"] >= size and r["copy"] in (0, 1, 2)
        words[r["source"]] += size
    target = {r["source_size"]: r["target"] for r in M.mix_documents(odd_docs).collect()}
    assert sum(words.values()) == pytest.approx(sum(target.values()), rel=0.5)
    copies = Counter((r["doc_id"], r["text"]) for r in got)
    rows = Counter((r["doc_id"], r["text"]) for r in odd_docs.collect())
    assert all(n <= 3 * rows[k] for k, n in copies.items())
    assert M.mix_stream(no_docs).count() == 0


def test_queues_are_cut_into_ranges(odd_docs, monkeypatch):
    whole = sorted(map(tuple, M.mix_documents(odd_docs).collect()), key=str)
    monkeypatch.setattr(M, "RANGE_ROWS", 3)
    assert sorted(map(tuple, M.mix_documents(odd_docs).collect()), key=str) == whole
