import hashlib
import random
import zlib

import pytest

from ledgerwalk.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, node string, c string"


def order_of(turn, role, text):
    digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    return (turn is not None, turn or 0, digest)


def brute_force(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    turns = {c: [(r, x) for _, r, x in sorted(ts, key=lambda t: order_of(*t))] for c, ts in own.items()}
    rebuilt = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(turns.get(base, [])[:h] + mine[h:])
    nodes = {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    saved, leaves = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        kids = children.get(p, [])
        own_saving = (len(nodes[p]) - 1) * len(p[-1][1]) if p else 0
        saved[p] = own_saving + sum(saved[k] for k in kids)
        leaves[p] = sum(leaves[k] for k in kids) if kids else 1
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(m for m in members if len(rebuilt[m]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children.get(p, [])), leaves[p],
                    saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rng = random.Random(3)
    first = [("system", "be kind"), ("user", "hello " * 20), ("assistant", "héllo 👋"), ("user", "bye"), (None, None), ("user", "")]
    rows = []
    for c in list(range(0, 12)) + [100, 103, 104, 250, 251, -5, -100, -107]:
        n = rng.randrange(0, 9)
        for i in range(n):
            role, text = first[i] if i < 6 and rng.random() < 0.8 else (rng.choice(["user", "assistant"]), rng.choice(["a", "b", "ccc"]))
            rows.append((c, i, role, text))
    for c in range(400, 450):  # copies
        rows += [(c, i, "user", f"same {i}") for i in range(7)]
    rows += [(300, i, "user", f"t{i % 3}") for i in range(40)]  # a long one
    rows += [(301, i, "user", f"t{i % 3}") for i in range(44)]
    rows += [(302, None, "user", "x"), (302, None, "user", "x"), (302, None, None, "y"), (302, 5, "user", "z"), (302, 5, "user", "z")]
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None), (303, 0, "user", "long " * 50_000)]
    return [(*r, 9, "clash", "clash") for r in rows]


def report(spark, rows):
    df = prefix_trie.trie_report(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_equals_brute_force(spark):
    rows = conversations()
    assert report(spark, rows) == brute_force(rows)


def test_blocks_and_lists_of_any_size_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "LIST_ROWS", 3)
    monkeypatch.setattr(prefix_trie, "LISTS_AT_A_TIME", 2)
    rows = conversations()
    assert report(spark, rows) == brute_force(rows)


def test_turns_of_one_conversation_may_lie_in_many_ranges(spark):
    rows = [(7, i % 50, "user", f"t{i}", 0, "", "") for i in range(600)] + [(8, i, "user", f"t{i}", 0, "", "") for i in range(600)]
    assert report(spark, rows) == brute_force(rows)


def test_empty_table(spark):
    assert report(spark, []) == []


def test_texts_of_nodes(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA)
    trie = prefix_trie.prefix_trie(df)
    got = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in prefix_trie.with_texts(trie.nodes, df).collect()}
    assert len(got) == len(brute_force(rows))
    assert got[(400, 7)] == ("user", "same 6")
    assert [v for (_, d), v in got.items() if d == 0] == [(None, None)]


@pytest.mark.parametrize("rows", [[(5, 0, "user", "a")], [(5, 0, "user", "a"), (0, 0, "user", "b")]])
def test_turnless_conversations_are_members_of_the_root(spark, rows):
    full = [(*r, 0, "", "") for r in rows]
    assert report(spark, full) == brute_force(full)
