from datetime import timedelta

from pyspark.sql import functions as F

from conftest import NOW, T0, files_df, tables
from ledgerwalk import schemas as S
from ledgerwalk.operators import (apply_walk, catalog_stats, directory_rollup, mark_missing, reconcile_marked,
                                  with_dense_ids)


def listing(spark, files=(), dirs=()):
    rows = [(s, p, False, size, T0, True) for s, p, size in files]
    rows += [(s, p, True, None, None, listed) for s, p, listed in dirs]
    return spark.createDataFrame(rows, S.LISTING)


def test_rollup_recursive_and_empty_dirs(spark):
    lst = listing(spark, files=[("raw", "a.txt", 5), ("raw", "sub/b.txt", 6), ("raw", "sub/c.txt", 4)],
                  dirs=[("raw", ".", True), ("raw", "sub", True), ("raw", "empty", True), ("raw", "also", True),
                        ("raw", "also/empty", True)])
    got = {r.path: (r.file_count, r.total_size) for r in directory_rollup(lst).collect()}
    assert got == {".": (3, 15), "sub": (2, 10), "empty": (0, 0), "also": (0, 0), "also/empty": (0, 0)}


def test_rollup_root_equals_totals_on_many_files(spark):
    rows = [("raw", f"d{i % 7}/e{i % 3}/f{i}", False, i, T0, True) for i in range(2000)]
    got = {r.path: (r.file_count, r.total_size)
           for r in directory_rollup(spark.createDataFrame(rows, S.LISTING)).collect()}
    assert got["."] == (2000, sum(range(2000)))
    assert sum(v[0] for k, v in got.items() if k.count("/") == 0 and k != ".") == 2000


def test_walk_insert_update_rediscover_and_stale_dirs(spark):
    t = tables(spark, files=[dict(id=1, store="raw", path="keep.txt", size=1, found_at=T0, sha256="h",
                                  hashed_at=T0),
                             dict(id=2, store="raw", path="gone.txt", missing=True),
                             dict(id=7, store="clean", path="c.txt")],
               dirs=[dict(id=1, store="raw", path=".", file_count=2), dict(id=2, store="raw", path="remove"),
                     dict(id=3, store="clean", path=".", file_count=1)])
    lst = listing(spark, files=[("raw", "keep.txt", 9), ("raw", "gone.txt", 3), ("raw", "new/b.txt", 4),
                                ("raw", "new/a.txt", 2)],
                  dirs=[("raw", ".", True), ("raw", "new", True)])
    out, stats = apply_walk(t, lst, NOW, ["raw"])
    f = {r.path: r for r in out["files"].collect()}
    assert f["keep.txt"].id == 1 and f["keep.txt"].size == 9 and f["keep.txt"].found_at == T0
    assert f["keep.txt"].reconciled_at == NOW and f["keep.txt"].sha256 == "h"
    assert f["gone.txt"].missing is False
    assert (f["new/a.txt"].id, f["new/b.txt"].id) == (8, 9)  # max(id)+1.. in path order
    assert f["new/a.txt"].found_at == NOW and f["c.txt"].reconciled_at == T0
    d = {(r.store, r.path): r for r in out["directories"].collect()}
    assert ("raw", "remove") not in d and ("clean", ".") in d
    assert d[("raw", ".")].id == 1 and d[("raw", ".")].file_count == 4
    assert d[("raw", "new")].id == 4
    s = stats.first()
    assert (s.files_found, s.dirs_upserted, s.dirs_deleted) == (4, 2, 1)


def test_walk_is_idempotent(spark):
    t = tables(spark)
    lst = listing(spark, files=[("raw", "a/x", 1)], dirs=[("raw", ".", True), ("raw", "a", True)])
    once, _ = apply_walk(t, lst, NOW, ["raw"])
    twice, _ = apply_walk({k: v.checkpoint() for k, v in once.items()}, lst, NOW, ["raw"])
    assert sorted(map(tuple, once["files"].collect())) == sorted(map(tuple, twice["files"].collect()))
    assert sorted(map(tuple, once["directories"].collect())) == sorted(map(tuple, twice["directories"].collect()))


def test_mark_missing_threshold(spark):
    old = NOW - timedelta(hours=72)
    f = files_df(spark, [dict(id=1, store="raw", path="a", reconciled_at=old),
                         dict(id=2, store="clean", path="b", reconciled_at=old),
                         dict(id=3, store="trash", path="c", reconciled_at=NOW - timedelta(hours=1)),
                         dict(id=4, store="raw", path="d", reconciled_at=old, missing=True),
                         dict(id=5, store="raw", path="e", reconciled_at=NOW - timedelta(hours=48))])
    assert reconcile_marked(f, NOW).first().marked == 2
    marked = mark_missing(f, NOW)
    assert {r.id for r in marked.filter("missing").collect()} == {1, 2, 4}
    assert reconcile_marked(marked, NOW).first().marked == 0


def test_catalog_stats_zero_and_counts(spark):
    assert tuple(catalog_stats(tables(spark)).first()) == (0, 0, 0, 0, 0)
    t = tables(spark, files=[dict(id=1, store="raw", path="a"), dict(id=2, store="raw", path="b", missing=True)],
               dirs=[dict(id=1, store="raw", path=".")])
    assert tuple(catalog_stats(t).first()) == (1, 1, 1, 0, 0)


def test_dense_ids_follow_order(spark):
    df = spark.range(0, 3000).select((F.col("id") * 7919 % 3001).alias("k"), F.lit("x").alias("v"))
    out = with_dense_ids(df, ["k"], 100).collect()
    pairs = sorted((r.id, r.k) for r in out)
    assert [p[0] for p in pairs] == list(range(100, 3100))
    assert [p[1] for p in pairs] == sorted(p[1] for p in pairs)
