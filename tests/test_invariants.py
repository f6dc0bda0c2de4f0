"""Invariants over the catalogues derived from the driver tables (sf0.001)."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import NOW
from ledgerwalk.operators import apply_hashes, build_plan, hash_content, needs_hash, organize_plan
from ledgerwalk.plans import views as V

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def docs(spark):
    return V.docs_tables(spark, SF)


def test_unique_store_path_and_ids(docs):
    f = docs["files"]
    assert f.groupBy("store", "path").count().filter("count > 1").count() == 0
    assert f.groupBy("id").count().filter("count > 1").count() == 0
    d = docs["directories"]
    assert d.groupBy("store", "path").count().filter("count > 1").count() == 0


def test_root_rollup_equals_live_totals(docs):
    live = docs["files"].filter(~F.col("missing")).groupBy("store").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    root = docs["directories"].filter(F.col("path") == ".").select(
        "store", F.col("file_count").alias("n"), F.col("total_size").alias("b"))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, root.collect()))


def test_plan_one_op_per_file_and_keepers_survive(docs):
    ops = build_plan(docs)
    assert ops.filter(F.col("file_id").isNotNull()).groupBy("file_id").count().filter("count > 1").count() == 0
    assert ops.groupBy("op_id").count().filter("count > 1").count() == 0
    trashed = ops.filter(F.col("file_id").isNotNull()).select(F.col("file_id").alias("id"))
    f = docs["files"]
    live_raw = f.filter((F.col("store") == "raw") & ~F.col("missing"))
    dedup_hashes = ops.filter(F.col("rule") == "dedup").join(f.select(F.col("id").alias("file_id"), "sha256"),
                                                            "file_id").select("sha256").distinct()
    survivors = live_raw.join(trashed, "id", "left_anti").groupBy("sha256").count()
    kept = dedup_hashes.join(survivors, "sha256", "left").collect()
    assert kept and all(r["count"] == 1 for r in kept)


def test_hashing_is_idempotent(spark, docs):
    items = needs_hash(docs["files"]).select("id").join(V.docs_content(spark, SF), "id")
    once = apply_hashes(docs, hash_content(items, "content", "path"), NOW)
    files = once["files"].checkpoint()
    assert needs_hash(files).count() == 0
    again = apply_hashes(dict(once, files=files), hash_content(needs_hash(files).select("id").join(
        V.docs_content(spark, SF), "id"), "content", "path"), NOW)
    assert sorted(map(tuple, again["files"].collect())) == sorted(map(tuple, files.collect()))


def test_organize_statuses_partition_candidates(spark):
    t = V.media_tables(spark, SF)
    plan = organize_plan(t, V.MEDIA_ZONE)
    assert plan.groupBy("file_id").count().filter("count > 1").count() == 0
    organized = plan.filter(F.col("status") == "organized")
    assert organized.groupBy("sha256").count().filter("count > 1").count() == 0
    assert organized.groupBy("dst_path").count().filter("count > 1").count() == 0
