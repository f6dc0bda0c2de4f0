import hashlib
from collections import Counter

import pytest

from ledgerwalk.llm import sharding as S


def test_every_shard_claims_its_turn():
    """Against the plain statement: shard by shard, the next preferred free slot."""
    shards, size = ["a", "b", "c"], 13
    perms = [[(S.preference(s, size)[0] + j * S.preference(s, size)[1]) % size for j in range(size)] for s in shards]
    assert all(sorted(p) == list(range(size)) for p in perms)
    owner = {}
    while len(owner) < size:
        for i, p in enumerate(perms):
            if len(owner) < size:
                owner[next(x for x in p if x not in owner)] = i
    assert S.fill_table(shards, size) == [owner[k] for k in range(size)]


def test_balance_and_small_disruption():
    table = S.fill_table(S.SHARDS)
    counts = Counter(table).values()
    assert max(counts) - min(counts) <= 1
    fewer = S.fill_table(S.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer))
    assert moved < 0.25 * len(table)


@pytest.mark.parametrize("shards,size", [((), 13), (("a", "a"), 13), (("a",), 12), (("a", "b", "c"), 2)])
def test_bad_tables(shards, size):
    with pytest.raises(ValueError):
        S.fill_table(shards, size)


def test_placement(spark, odd_docs, no_docs):
    table = S.fill_table(S.SHARDS)
    got = S.place(odd_docs.withColumnRenamed("wid", "slot").withColumnRenamed("rid", "_slot")).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % S.TABLE_SIZE
        assert (r["slot"], r["shard"], r["_slot"]) == (slot, S.SHARDS[table[slot]], "clash")
    assert S.place(no_docs).count() == 0
