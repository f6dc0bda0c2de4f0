"""Each stage against plain Python over its own input."""

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from ledgerwalk.llm import quality as Q
from ledgerwalk.llm.common import stored

from .test_decontam import brute as contaminated
from .test_jaccard import shingles

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in P.STAGES:
        done = stored(f(spark, docs, SF), name)
        out.append((docs, done))
        docs = done
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    assert all(done.columns == COLUMNS for _, done in stages[:-1])
    assert stages[-1][1].columns == [*COLUMNS, "slot", "shard"]


def test_quality_stage(spark, stages):
    docs, kept = stages[0]
    rejected = {r["doc_id"] for r in Q.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("rejected").collect()}
    assert rejected and set(ids(kept)) == set(ids(docs)) - rejected


def test_near_duplicate_stage(stages):
    docs, kept = stages[1]
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            k = len(sets[a] & sets[b])
            if b < a and k and 100 * k >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {x: new if g == old else g for x, g in group.items()}
    assert set(ids(kept)) == {i for i, g in group.items() if i == g}


def test_decontamination_stage(spark, stages):
    docs, kept = stages[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in contaminated([(r["doc_id"], r["text"]) for r in docs.collect()], items) if r[5]}
    assert set(ids(kept)) == set(ids(docs)) - bad


def test_mixing_and_sharding_stages(stages):
    docs, mixed = stages[3]
    assert set(ids(mixed)) <= set(ids(docs)) and max(ids(mixed).values()) <= 3
    size = Counter()
    for r in mixed.collect():
        size[r["source"]] += len(r["text"].split())
    assert sum(size.values()) == pytest.approx(sum(len(r["text"].split()) for r in docs.collect()), rel=0.35)
    placed = stages[4][1]
    assert ids(placed) == ids(mixed)
    assert len({(r["doc_id"], r["shard"]) for r in placed.collect()}) == len(ids(placed))


def test_registered(spark):
    qs = entry.queries()
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in qs} and "pipeline" in qs
    assert qs["pipeline"](spark, SF).count() > 0


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        rows = docs.select(*COLUMNS, "spans", "rid", "wid")
        for name, f in P.STAGES:
            rows = stored(f(spark, rows, SF), name)
        assert {"spans", "rid", "wid", "shard"} <= set(rows.columns)
