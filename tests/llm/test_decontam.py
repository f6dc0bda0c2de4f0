import hashlib
import re

from ledgerwalk.llm import decontam as D

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
ITEM_SCHEMA = "item_id bigint, text string, wid bigint, terms string"


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add("null" if i is None else str(i))
    sizes = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for p in range(len(w)):
            for k in sizes:
                x = tuple(w[p:p + k])
                if len(x) == k and x in windows:
                    hit |= set(range(p, p + k))
                    found |= windows[x]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def items_for(docs):
    long = docs.filter("doc_id = 13").first()["text"].split()
    base = docs.filter("doc_id = 1").first()["text"].split()
    return [(1, " ".join(long[29_980:30_000])), (2, " ".join(base[5:30]).upper()), (2, "One, two!"), (3, "ÜNÏcödé ẞ İ"), (3, "Ünïcödé ẞ İ"),
            (4, None), (5, " . "), (None, " ".join(base[100:111])), (7, "never seen words " * 5), (8, "spam " * 12), (8, "spam " * 12), (9, " ".join(base[290:300]) + " unknown")]


def test_equals_brute_force(spark, odd_docs):
    items = items_for(odd_docs)
    df = spark.createDataFrame([(*r, 1, "clash") for r in items], ITEM_SCHEMA)
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = brute(docs, items)
    assert sum(r[5] for r in want) > 8
    got = D.contamination(odd_docs, df).drop("h")
    assert sorted(map(tuple, got.collect()), key=str) == want
    hit = {(r[0], r[1]) for r in want if r[5]}
    kept = sorted(((r["doc_id"], r["text"], r["spans"]) for r in D.clean_documents(odd_docs, df).collect()), key=str)
    assert kept == sorted(((i, t, "clash") for i, t in docs if (i, len(words(t))) not in hit), key=str)


def test_shuffled_joins_give_the_same(spark, odd_docs, monkeypatch):
    df = spark.createDataFrame([(*r, 1, "clash") for r in items_for(odd_docs)], ITEM_SCHEMA)
    one = sorted(map(tuple, D.contamination(odd_docs, df).collect()), key=str)
    monkeypatch.setattr(D, "small_side", lambda x, n=0: x)
    assert sorted(map(tuple, D.contamination(odd_docs, df).collect()), key=str) == one


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], ITEM_SCHEMA)
    some = spark.createDataFrame([(1, "one two", 1, "x")], ITEM_SCHEMA)
    assert D.contamination(no_docs, some).count() == 0
    assert D.contamination(odd_docs, none).filter("contaminated").count() == 0
    assert D.contamination(odd_docs, none).count() == odd_docs.count()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "gamma y y y y y alpha beta")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    _, windows, index = D.build_index(docs, items)
    near = {(r["doc_id"], abs(r["start"] - r["other"])) for r in D.proximity_matches(index, windows, 1).collect()}
    assert (1, 0) in near and {d for d, _ in near} <= {1, 2, 3}
    wide = {r["doc_id"] for r in D.proximity_matches(index, windows, 20).collect()}
    assert wide == {1, 2, 3}
    assert {r["doc_id"] for r in D.phrase_matches(index, windows).collect()} == {1}


def test_index_is_native(spark, odd_docs):
    df = spark.createDataFrame([(1, "one two", 1, "x")], ITEM_SCHEMA)
    assert "Python" not in D.contamination(odd_docs, df)._jdf.queryExecution().toString()
