import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from ledgerwalk.llm import jaccard as J
from ledgerwalk.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * len(sets[a] | sets[b]):
                part[root(a)] = root(b)
    ids = {}
    for x in range(len(rows)):
        ids.setdefault(root(x), []).append(rows[x][0])
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return sorted(((rows[x][0], len(sets[x]), least[root(x)]) for x in range(len(rows))), key=str)


def test_equals_brute_force(odd_docs, no_docs):
    want = brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert len({r[2] for r in want}) < len(want) - 5
    got = J.jaccard_join(odd_docs).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert J.jaccard_join(no_docs).count() == 0


def near_copies(rng, n, edits, size=200):
    base = [f"b{rng.randrange(10 ** 6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(size)] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("common", [1, 10 ** 9])
def test_groups_near_the_threshold(spark, monkeypatch, common):
    """Groups of copies whose members link in part, a passage that many documents
    share, with every shingle common or none, and small blocks."""
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = near_copies(rng, 40, 3) + near_copies(rng, 40, 2, 60) + near_copies(rng, 10, 40)
    texts += [" ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(5, 200))) + " " + passage for _ in range(60)]
    texts += [texts[0]] * 5
    rows = list(enumerate(texts))
    monkeypatch.setattr(J, "COMMON_DF", common)
    monkeypatch.setattr(J, "LOCAL_DF", 2)
    monkeypatch.setattr(J, "BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = J.jaccard_join(df).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_one_of_each(odd_docs, no_docs):
    kept = J.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    groups = Counter(r[2] for r in brute(rows) if r[1])
    texts = [r for r in kept.collect() if shingles(r["text"])]
    assert len(texts) == len(groups)
    assert sum(not shingles(r["text"]) for r in kept.collect()) == sum(not shingles(t) for _, t in rows)
    assert J.one_of_each(no_docs).count() == 0


def test_tree_loses_no_link():
    """Dual traversal against all pairs, members of mixed sizes and components."""
    rng = random.Random(4)
    texts = [t for n, e, s in ((30, 1, 60), (30, 1, 100), (40, 2, 300), (30, 1, 150)) for t in near_copies(rng, n, e, s)]
    texts += [" ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(5, 160))) for _ in range(200)]
    sets = shingle_sets([t.encode() for t in texts])
    frame = pd.DataFrame({"cls": range(len(sets)), "n": [len(s) for s in sets], "bits": [J.bitmap(s) for s in sets], "comp": [rng.randrange(200) for _ in sets]})
    got = {tuple(sorted(p)) for a, b, _ in J.surviving_pairs(frame) for p in zip(a.tolist(), b.tolist())}
    half = frame.iloc[::2], frame.iloc[1::2]
    across = {tuple(sorted(p)) for a, b, _ in J.surviving_pairs(*half) for p in zip(a.tolist(), b.tolist())}
    links = set()
    for a in range(len(sets)):
        for b in range(a):
            k = len(np.intersect1d(sets[a], sets[b]))
            if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k) and frame["comp"][a] != frame["comp"][b]:
                links.add((b, a))
    assert len(links) > 200 and links <= got
    assert {(a, b) for a, b in links if (a + b) % 2} <= across
    assert len(got) < len(sets) ** 2 / 20


def test_sets_equal_plain_shingles():
    rng = random.Random(9)
    texts = ["", " ", "a", "a b c d", "a b c d e", "A b C d E", "é ñ x y\x0bz w\r\nq", " a  b\tc d e f "] + \
            [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(200)]
    names = {}
    for t, s in zip(texts, shingle_sets([t.encode() for t in texts])):
        assert len(s) == len(shingles(t)), t
        assert (np.diff(s.view(np.uint64).astype(object)) > 0).all()
        assert names.setdefault(frozenset(shingles(t)), s.tobytes()) == s.tobytes()
    assert len(set(names.values())) == len(names)


def test_words_built_against_polynomial_hashes_are_not_equal(spark):
    """Thue-Morse words have equal polynomial hashes modulo any power of two."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    assert len(word) == 1024 and all(x != y for x, y in zip(word, other))
    docs = spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_join(docs).collect()}
    assert got == {(1, 1, 1), (2, 1, 2), (3, 1, 1)}


def test_sets_that_meet_in_half_a_digest_have_different_names():
    one, two = np.array([1], np.uint64), np.array([2], np.uint64)
    first, second = J.digests(one)
    assert J.digest(one) == first and J.digest(one, frozenset([first])) == second
    assert J.digest(two, frozenset([first])) == J.digests(two)[0]
