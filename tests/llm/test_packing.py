import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerwalk.llm import packing

PATH = public_tokenizers.path(packing.VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def check(tokenizer, docs, rows, window):
    """Every id of every document once, sequences without holes, and no padding but at a power of two."""
    want = Counter((i, tuple(ids_of(tokenizer, t))) for i, t in docs)
    assert sum(r["length"] for r in rows) == sum(len(x[1]) * n for x, n in want.items())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    texts = {}
    for (i, ids), n in want.items():
        texts.setdefault((i, len(ids)), []).append((ids, n))
    for key, pieces in by_doc.items():
        (ids, n), = texts.pop(key)
        covered = Counter()
        for p in pieces:
            own = ids[p["start"]:p["start"] + p["length"]]
            assert len(own) == p["length"] and p["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
            covered.update(range(p["start"], p["start"] + p["length"]))
        assert covered == Counter(dict.fromkeys(range(key[1]), n))
    assert not texts
    for pieces in by_sequence.values():
        end = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == end
            end += p["length"]
        assert end == window or end & (end - 1) == 0 and end < window


def test_odd_documents(spark, odd_docs, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    packed = packing.pack(odd_docs)
    rows = packing.checksums(packed).collect()
    check(tokenizer, docs, rows, packing.WINDOW)
    with_ids = packing.ids_of(packed.pieces, packed.tokens).collect()
    assert Counter(zlib.crc32(bytes(r["ids"])) for r in with_ids) == Counter(r["ids_crc32"] for r in rows)


def test_small_window_and_chunks(spark, odd_docs, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 2000)
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check(tokenizer, docs, packing.checksums(packing.pack(odd_docs, window=64)).collect(), 64)


def test_no_documents(spark, no_docs):
    assert packing.checksums(packing.pack(no_docs)).collect() == []


def test_words_tokenise_as_whole_texts_do(tokenizer):
    rng = random.Random(4)
    bits = ["a", "B", "é", "É", "́", ",", ".", "!", "'", " ", "\n", " ", "1", "…", "s", "<|", "<|endoftext|>", "日", "ß", "ll", " ", "İ", "ſ", "Σ", "\x1c", "×", "."]
    texts = ["", "  ", "Don't WE'LL it's 'S a'b.", "é, ß. naïve! ×. ÷, ? . ,", "<|ENDOFTEXT|> <|endoftext|>. <|startoftext|>a"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(1500)]
    for group in ([t for t in texts if "<|" not in t], texts):
        ids, sizes = packing.encode_texts([t.encode() for t in group], PATH)
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in group]
        assert sizes.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_combinations_fill_the_window():
    present = np.array([0] + [9] * 64)
    a, m, b, k = packing.combinations(present, 64)
    assert ((a * m + b * k) == 64).all() and (m <= present[a]).all() and (k <= 3).all()
    sets = [tuple(sorted([x] * i + [y] * j)) for x, i, y, j in zip(a.tolist(), m.tolist(), b.tolist(), k.tolist())]
    assert len(sets) == len(set(sets))


def test_repeat_counts_come_near_the_histogram():
    rng = np.random.default_rng(0)
    histogram = dict(Counter(rng.integers(1, 4096, 200_000).tolist()))
    made = packing.plan(histogram)
    packed = sum(s.hi - s.lo for s in made.slots if s.repeats)
    assert packed > 0.9 * 200_000
    for length, n in histogram.items():
        ranks = sorted((s.lo, s.hi) for s in made.slots if s.length == length)
        assert ranks[0][0] == 0 and ranks[-1][1] == n and all(x[1] == y[0] for x, y in zip(ranks, ranks[1:]))


def test_a_hot_length_is_planned_not_listed():
    made = packing.plan({3000: 10 ** 12, 7: 5, 4096: 10 ** 9})
    assert len(made.slots) < 20 and made.edges[-1] == 3000 * 10 ** 12 + 35 - made_packed(made)


def made_packed(made):
    return sum((s.hi - s.lo) * s.length for s in made.slots if s.repeats and s.length < 4096)
