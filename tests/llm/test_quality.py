import random

import pytest
from pyspark.sql import functions as F

from ledgerwalk.llm import quality as Q


def test_marks():
    assert Q.marks("") == (0,) * 5
    assert Q.marks("one two three four five six") == (0,) * 5
    assert Q.marks("of%%% the&&& and$$$ it***")[0] == Q.BAD
    assert Q.marks("a | b | c |")[1] == Q.BAD
    assert Q.marks("THIS IS ALL VERY LOUD")[2] == Q.BAD
    assert Q.marks("no " * 40)[3] == Q.BAD
    assert Q.marks("you, Idiot!")[4] == Q.BAD


def test_em_finds_the_accuracies():
    """Votes drawn from known accuracies on known truth, human labels on a part."""
    rng = random.Random(2)
    counts, right = {}, {1: [0, 0], 2: [0, 0]}
    for _ in range(20_000):
        bad = rng.random() < 0.3
        v = [0] * len(Q.LABELLERS)
        if rng.random() < 0.3:
            v[0] = Q.BAD if bad else Q.GOOD
        for j, (hit, false) in ((1, (0.6, 0.02)), (2, (0.5, 0.2))):
            if rng.random() < (hit if bad else false):
                v[j] = Q.BAD
                right[j][0] += bad
                right[j][1] += 1
        p = sum(x * 3 ** i for i, x in enumerate(v))
        counts[p] = counts.get(p, 0) + 1
    posterior, accuracy = Q.fit_labellers(counts)
    assert accuracy["human"] > 0.9
    assert accuracy["symbols"] > accuracy["separators"]
    assert posterior[Q.BAD] > 0.9 > 0.1 > posterior[Q.GOOD]
    assert Q.fit_labellers({}) == ({}, {})


def test_held_out_accuracy(spark):
    """Trained without every fifth label, the classifier finds those documents."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = Q.classify(docs, labels.filter("doc_id % 5 <> 0")).join(labels.filter("doc_id % 5 = 0"), "doc_id")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    n = out.agg(F.sum(F.when(bad, 1)).alias("bad"), F.sum(F.when(bad & F.col("rejected"), 1)).alias("caught"),
                F.sum(F.when(~bad, 1)).alias("good"), F.sum(F.when(~bad & F.col("rejected"), 1)).alias("lost")).first()
    assert n["caught"] > 0.8 * n["bad"]
    assert (n["lost"] or 0) <= 0.01 * n["good"]


@pytest.fixture(scope="module")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, None, None), (None, 0, 1), (14, 0, 0), (8, 1, 0), (999, 0, 0)], "doc_id bigint, quality int, toxic int")


def test_odd_rows(spark, odd_docs, no_docs, odd_labels):
    got = Q.classify(odd_docs, odd_labels).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["rejected"])
    assert by[14] == {True} and by[5] == by[6] == by[8] == {False} and by[2] == {False}
    kept = Q.accepted(odd_docs, odd_labels)
    assert kept.columns == odd_docs.columns and 0 < kept.count() < odd_docs.count()
    assert Q.classify(no_docs, odd_labels).count() == 0
    assert Q.classify(odd_docs, odd_labels.limit(0)).filter("rejected").count() > 0  # the heuristics' own marks


def test_scores_do_not_depend_on_partitions(odd_docs, odd_labels):
    one = sorted(map(tuple, Q.classify(odd_docs, odd_labels).collect()), key=str)
    assert sorted(map(tuple, Q.classify(odd_docs.repartition(7), odd_labels).collect()), key=str) == one


def test_only_copies_are_left_out_of_the_fit(spark):
    """Unrelated texts that share their longest word and their long words all count; of
    equal and of nearly equal texts with the same votes one does."""
    rng = random.Random(8)

    def text(n=60):
        return " ".join(["incomprehensibilities"] + [f"w{rng.randrange(4000)}" for _ in range(n)])

    long = text(300)
    texts = [text() for _ in range(50)] + [long, long, long + " more", text()[:0], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id bigint, quality int, toxic int")
    some, copies = Q.training_texts(docs, Q.votes(docs, labels))
    assert some.count() == 54 and len(copies) == 1
    left = {r["text"] for r in some.collect() if (r["h"], r["pattern"]) not in copies}
    assert set(texts[:50]) <= left and len(left & {long, long + " more"}) == 1
    halves = spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))], "doc_id bigint, quality int, toxic int")
    some, copies = Q.training_texts(docs, Q.votes(docs, halves))
    assert some.filter(F.col("text") == long).count() == 2  # votes differ: both count


def test_a_long_good_text_may_quote_an_insult(spark):
    """Words that labels or the list call abuse reject short texts, not a long text,
    labelled good, that has each of them once."""
    rng = random.Random(9)

    def text(n, *more):
        words = [f"w{rng.randrange(4000)}" for _ in range(n)] + list(more)
        rng.shuffle(words)
        return " ".join(words)

    rows = [(i, text(60, "trash", "stupid"), 1, 1) for i in range(60)] + [(100 + i, text(60), 1, 0) for i in range(150)]
    rows += [(300, text(20_000, "trash", "stupid"), 1, 0), (301, text(60, "trash", "stupid"), None, None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id bigint, quality int, toxic int")
    rejected = {r["doc_id"] for r in Q.classify(docs, labels).filter("rejected").collect()}
    assert rejected == {*range(60), 301}


def test_refuted_marks_weigh_nothing(spark):
    """A heuristic that labels refute rejects nothing; one seen too rarely, or that no
    label can refute, still does."""
    rng = random.Random(10)

    def text(n):
        return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))

    rows = [(i, " | ".join(text(30).split()), 1) for i in range(40)]  # tables, labelled good
    rows += [(100 + i, "no " * 40 + text(20), 0) for i in range(40)] + [(200 + i, text(60), 1) for i in range(100)]
    rows += [(300, text(20).upper(), None)]  # the only one that shouts
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if q is not None], "doc_id bigint, quality int, toxic int")
    rejected = {r["doc_id"] for r in Q.classify(docs, labels).filter("rejected").collect()}
    assert rejected == {*range(100, 140), 300}
    alone = {r["doc_id"] for r in Q.classify(docs, labels.limit(0)).filter("rejected").collect()}
    assert alone >= {*range(40), *range(100, 140), 300}


def test_toxic_documents_are_caught_in_every_language(spark):
    """Every fifth label of the driver's table is left out of the fit and then asked for."""
    import os
    sf = "/root/testdata/sf0.1"
    if not os.path.exists(sf):
        pytest.skip("driver tables not present")
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    out = Q.classify(docs, labels.filter("doc_id % 5 <> 0")).join(labels.filter("doc_id % 5 = 0"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    rows = out.groupBy("lang").agg(F.count_if(F.expr("toxic = 1")).alias("toxic"), F.count_if(F.expr("toxic = 1 and rejected")).alias("caught"),
                                   F.count_if(F.expr("toxic = 0 and quality = 1")).alias("clean"), F.count_if(F.expr("toxic = 0 and quality = 1 and rejected")).alias("lost")).collect()
    assert {r.lang for r in rows} == {"de", "en", "es", "fr"}
    for r in rows:
        assert r.toxic and r.caught >= 0.9 * r.toxic and r.lost <= 0.01 * r.clean, r


def test_stems_are_shown_by_the_share_of_their_words():
    mark = Q.marks("x")
    shown = lambda text: Q.features(text, mark).get(Q.stem_bucket("bome"), 0.0)
    other = lambda n: " ".join(f"w{i}" for i in range(n))
    assert shown("bomente " + other(20)) == 0 and shown("bomente bomenar " + other(158)) == 1.0
    assert shown("bomente bomenar " + other(159)) == 0 and shown("bomente bomenar") == 1.5
    assert shown("bomente bomenar bomena " + other(20)) == 2.0 and shown("bome bome bome") == 0
