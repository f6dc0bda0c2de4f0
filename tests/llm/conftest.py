import random

import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, rid string, wid int"


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated
    rows and columns whose names clash with the operators' own."""
    rng = random.Random(5)
    base = prose(rng, 300)
    words = base.split()
    passage = prose(rng, 60)
    rows = [(1, base), (2, base), (2, base), (3, " ".join(words[:290])), (4, " ".join(words[40:] + words[:40])),
            (5, None), (6, ""), (7, " \t\n\x0b\x0c\r "), (8, "one two three"), (9, "One  TWO\tthree"), (10, "one two"),
            (None, "a row without id " * 30), (None, None), (11, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 40)),
            (12, prose(rng, 50) + " " + passage + " " + prose(rng, 10)), (13, prose(rng, 30_000, 50_000)), (14, "spam " * 3000),
            (15, "Ünïcödé ẞ İ ſ K " * 40), (16, "x" * 5000), (17, base.upper()), (18, base + " " + prose(rng, 5))]
    # a chain: each is close enough to the next one only
    chain = [f"c{i}" for i in range(200)]
    for i in range(6):
        rows.append((30 + i, " ".join(chain[12 * i:12 * i + 140])))
    rows += [(100 + i, prose(rng, rng.randrange(1, 120), 300)) for i in range(40)]
    sources = ["b", "a", None, "ä", "Z"]
    full = [(i, t, None, sources[k % 5], None, "clash", "clash", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]
