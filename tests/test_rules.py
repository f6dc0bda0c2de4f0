from pyspark.sql import functions as F

from conftest import tables
from ledgerwalk.operators import (DedupRule, JunkRule, build_plan, execution_order, plan_report,
                                  report_text)
from ledgerwalk.operators.rules import rule_by_name
from ledgerwalk import schemas as S

import pytest


def ops_by_path(df):
    return {r.src_path: r for r in df.collect()}


def test_junk_file_names_raw_only(spark):
    t = tables(spark, files=[
        dict(id=1, store="raw", path="photos/.DS_Store"), dict(id=2, store="raw", path="documents/Thumbs.db"),
        dict(id=3, store="raw", path="photos/._IMG_1234.JPG"), dict(id=4, store="raw", path="photos/vacation.jpg"),
        dict(id=5, store="clean", path=".DS_Store"), dict(id=6, store="raw", path="x/.DS_Store", missing=True)])
    ops = ops_by_path(JunkRule().file_ops(t["files"], None))
    assert set(ops) == {"photos/.DS_Store", "documents/Thumbs.db", "photos/._IMG_1234.JPG"}
    o = ops["photos/.DS_Store"]
    assert (o.kind, o.dst_store, o.dst_path, o.reason, o.op_id) == ("TRASH", "trash", "photos/.DS_Store",
                                                                     "junk file: .DS_Store", 2)
    assert ops["photos/._IMG_1234.JPG"].reason == "macOS resource fork"


def test_junk_directory_and_empty_dirs(spark):
    t = tables(spark, files=[dict(id=1, store="raw", path="photos/@eaDir/thumb.jpg")], dirs=[
        dict(id=1, store="raw", path="photos/@eaDir", file_count=1), dict(id=2, store="raw", path="photos", file_count=2),
        dict(id=3, store="raw", path="sub/empty", file_count=0), dict(id=4, store="clean", path="old", file_count=0),
        dict(id=5, store="trash", path="gone", file_count=0), dict(id=6, store="raw", path="photos2", file_count=5),
        dict(id=7, store="raw", path=".", file_count=0), dict(id=8, store="raw", path="locked", file_count=0,
                                                              listed=False)])
    ops = ops_by_path(JunkRule().evaluate(t, None))
    assert ops["photos/@eaDir/thumb.jpg"].reason == "junk directory: @eaDir"
    dirs = {p: o.reason for p, o in ops.items() if o.kind == "RMDIR"}
    assert dirs == {"photos/@eaDir": "junk directory: @eaDir", "sub/empty": "empty directory",
                    "old": "empty directory", "gone": "empty directory"}


def _dedup(spark, files, claimed_ids=()):
    t = tables(spark, files=files)
    claimed = spark.createDataFrame([(i,) for i in claimed_ids], "file_id long") if claimed_ids else None
    return ops_by_path(DedupRule().evaluate(t, claimed))


def test_dedup_shortest_path_kept(spark):
    ops = _dedup(spark, [dict(id=1, store="raw", path="a.jpg", sha256="h" * 64),
                         dict(id=2, store="raw", path="sub/dir/a.jpg", sha256="h" * 64)])
    assert set(ops) == {"sub/dir/a.jpg"}
    assert ops["sub/dir/a.jpg"].reason == "duplicate of " + "h" * 12


def test_dedup_tie_breaks_by_path_and_ignores_other_stores(spark):
    assert set(_dedup(spark, [dict(id=1, store="raw", path="zzz.jpg", sha256="x"),
                              dict(id=2, store="raw", path="aaa.jpg", sha256="x")])) == {"zzz.jpg"}
    assert _dedup(spark, [dict(id=1, store="raw", path="a", sha256="x"), dict(id=2, store="clean", path="a", sha256="x"),
                          dict(id=3, store="trash", path="a", sha256="x")]) == {}


def test_dedup_claimed_keeper_skipped(spark):
    ops = _dedup(spark, [dict(id=1, store="raw", path="a", sha256="x"), dict(id=2, store="raw", path="b", sha256="x"),
                         dict(id=3, store="raw", path="c", sha256="x")], claimed_ids=[1])
    assert set(ops) == {"c"}


def test_dedup_missing_and_unhashed_ignored(spark):
    assert _dedup(spark, [dict(id=1, store="raw", path="a", sha256="x"),
                          dict(id=2, store="raw", path="bb", sha256="x", missing=True),
                          dict(id=3, store="raw", path="c"), dict(id=4, store="raw", path="d")]) == {}


def test_dedup_hot_hash_many_copies(spark):
    n = 5000
    rows = [(i, "raw", f"d{i % 50}/f{i:05d}", 0, None, None, None, False, "e3b0", None) for i in range(1, n + 1)]
    from conftest import T0
    rows = [(r[0], r[1], r[2], 0, T0, T0, T0, False, "e3b0", None) for r in rows]
    t = {"files": spark.createDataFrame(rows, S.FILES)}
    ops = DedupRule().evaluate(t, None)
    assert ops.count() == n - 1
    kept = t["files"].join(ops.select(F.col("file_id").alias("id")), "id", "left_anti").collect()
    assert [r.path for r in kept] == ["d0/f00050"]  # shortest, then smallest path


def test_build_plan_priority_and_order(spark):
    t = tables(spark, files=[dict(id=1, store="raw", path=".DS_Store", sha256="x"),
                             dict(id=2, store="raw", path="copy.jpg", sha256="x")],
               dirs=[dict(id=1, store="raw", path="a", file_count=0), dict(id=2, store="raw", path="a/b", file_count=0),
                     dict(id=3, store="raw", path="a/b/c", file_count=0)])
    ops = build_plan(t)
    rules = {r.src_path: r.rule for r in ops.collect()}
    assert rules == {".DS_Store": "junk", "a": "junk", "a/b": "junk", "a/b/c": "junk"}  # no dedup op
    order = [r.src_path for r in execution_order(ops).orderBy(
        "exec_rank", F.col("exec_depth").desc(), "rule_priority", "plan_key").collect()]
    assert order == [".DS_Store", "a/b/c", "a/b", "a"]
    assert [r.line for r in report_text(ops).collect()] == [
        "Rule: junk (4 ops)", "  TRASH  raw/.DS_Store -> trash/.DS_Store  (junk file: .DS_Store)",
        "  RMDIR  raw/a  (empty directory)", "  RMDIR  raw/a/b  (empty directory)",
        "  RMDIR  raw/a/b/c  (empty directory)"]


def test_empty_plan_report_and_rule_lookup(spark):
    t = tables(spark, files=[dict(id=1, store="raw", path="a.jpg", sha256="x")])
    ops = build_plan(t, ["dedup"])
    assert [r.line for r in report_text(ops).collect()] == ["No operations proposed."]
    assert plan_report(ops).count() == 1
    with pytest.raises(KeyError):
        rule_by_name("bogus")


def test_report_groups_rules_in_priority_order(spark):
    t = tables(spark, files=[dict(id=1, store="raw", path="b/.DS_Store", sha256="j"),
                             dict(id=2, store="raw", path="x.jpg", sha256="d"),
                             dict(id=3, store="raw", path="long/x.jpg", sha256="d")])
    lines = [r.line for r in report_text(build_plan(t)).collect()]
    assert lines == ["Rule: junk (1 ops)", "  TRASH  raw/b/.DS_Store -> trash/b/.DS_Store  (junk file: .DS_Store)",
                     "Rule: dedup (1 ops)", "  TRASH  raw/long/x.jpg -> trash/long/x.jpg  (duplicate of d)"]
