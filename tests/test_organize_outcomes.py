from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import NOW, tables
from ledgerwalk import schemas as S
from ledgerwalk.operators import apply_organize, apply_outcomes, build_plan, organize_plan, organize_stats

MT = datetime(2020, 5, 6, 7, 8, 9)


def media(spark, files, exif=None):
    t = tables(spark, files=files)
    hashes = sorted({f["sha256"] for f in files if f.get("sha256")})
    t["mime"] = spark.createDataFrame([(h, 1, NOW, "text/plain" if h.startswith("txt") else "image/jpeg")
                                       for h in hashes], S.enricher_schema(S.MIME_COLUMNS))
    t["exif"] = spark.createDataFrame([(h, 1, NOW, d, "v") for h, d in (exif or {}).items()],
                                      S.enricher_schema(S.EXIF_COLUMNS))
    return t


def statuses(plan):
    return {r.path: r.status for r in plan.collect()}


def test_organize_basic_flow_and_apply(spark):
    t = media(spark, [dict(id=1, store="raw", path="DSC.JPG", sha256="aaaaaaaa11", mod_time=MT),
                      dict(id=2, store="raw", path="notes.txt", sha256="txt1", mod_time=MT)],
              exif={"aaaaaaaa11": '{"EXIF:DateTimeOriginal": "2018:10:30 21:17:30"}'})
    plan = organize_plan(t, "UTC")
    r = plan.collect()
    assert len(r) == 1 and r[0].status == "organized"
    assert r[0].dst_path == "media/2018/10/20181030T211730Z-aaaaaaaa-DSC.jpg"
    assert r[0].reason == "source: EXIF:DateTimeOriginal"
    out = apply_organize(t, plan, spark.createDataFrame([(1, None, None)], "file_id long, error string, remove_error string"),
                         remove_originals=False, now=NOW)
    f = {(x.store, x.path): x for x in out["files"].collect()}
    assert ("raw", "DSC.JPG") in f
    clean = f[("clean", "media/2018/10/20181030T211730Z-aaaaaaaa-DSC.jpg")]
    assert (clean.id, clean.sha256, clean.hashed_at, clean.mod_time) == (3, "aaaaaaaa11", NOW, MT)
    op = out["operations"].first()
    assert (op.file_id, op.rule, op.reason, op.src_path) == (3, "organize", "source: EXIF:DateTimeOriginal", "DSC.JPG")
    # rerun: the hash is now in clean
    assert statuses(organize_plan(out, "UTC")) == {"DSC.JPG": "skipped"}


def test_remove_originals_and_mod_time_fallback(spark):
    t = media(spark, [dict(id=1, store="raw", path="a.jpg", sha256="h1", mod_time=MT)])
    plan = organize_plan(t, "UTC")
    assert plan.first().reason == "source: files.mod_time"
    out = apply_organize(t, plan, spark.createDataFrame([(1, None, None)], "file_id long, error string, remove_error string"),
                         remove_originals=True, now=NOW)
    assert [(x.store) for x in out["files"].collect()] == ["clean"]


def test_dry_run_duplicates_and_collisions(spark):
    dst = "media/2020/05/20200506T070809Z-h1-a.jpg"
    t = media(spark, [dict(id=1, store="raw", path="a.jpg", sha256="h1", mod_time=MT),
                      dict(id=2, store="raw", path="b/a.jpg", sha256="h1", mod_time=MT),
                      dict(id=3, store="raw", path="c.jpg", sha256="h1", mod_time=datetime(2021, 1, 1)),
                      dict(id=4, store="raw", path="x.jpg", sha256="h2", mod_time=MT),
                      dict(id=5, store="clean", path="media/2020/05/20200506T070809Z-h2-x.jpg", sha256="other")])
    assert set(statuses(organize_plan(t, "UTC", dry_run=True)).values()) == {"organize"}
    st = statuses(organize_plan(t, "UTC"))
    assert st == {"a.jpg": "organized", "b/a.jpg": "skipped", "c.jpg": "skipped", "x.jpg": "collided"}
    s = organize_stats(organize_plan(t, "UTC")).first()
    assert tuple(s) == (4, 1, 2, 1, 0)
    assert dst  # documented layout


def test_organize_errors(spark):
    t = media(spark, [dict(id=1, store="raw", path="a.jpg", sha256="h1")])
    for zone in ("", "Bogus/Zone"):
        with pytest.raises(ValueError):
            organize_plan(t, zone)
    del t["mime"]
    with pytest.raises(ValueError, match="mime"):
        organize_plan(t, "UTC")


def test_apply_outcomes_success_failure_rmdir_conflict(spark):
    t = tables(spark, files=[dict(id=1, store="raw", path="x/.DS_Store"), dict(id=2, store="raw", path="y/._a"),
                             dict(id=3, store="raw", path="z/Thumbs.db"), dict(id=4, store="trash", path="z/Thumbs.db")],
               dirs=[dict(id=1, store="raw", path="e", file_count=0), dict(id=2, store="raw", path="e/f", file_count=0)])
    ops = build_plan(t)
    outcomes = ops.select("op_id", F.when(F.col("file_id") == 2, F.lit("rename: permission denied")).alias("error"))
    out, stats = apply_outcomes(t, ops, outcomes, NOW)
    f = {r.id: (r.store, r.path) for r in out["files"].collect()}
    assert f[1] == ("trash", "x/.DS_Store") and f[2] == ("raw", "y/._a") and f[3] == ("raw", "z/Thumbs.db")
    assert out["directories"].count() == 0
    assert tuple(stats.first()) == (3, 2)
    opsrows = out["operations"].orderBy("id").collect()
    assert [(r.id, r.src_path) for r in opsrows] == [(1, "x/.DS_Store"), (2, "e/f"), (3, "e")]
    errs = {r.file_id: r.error for r in out["process_errors"].collect()}
    assert errs == {2: "rename: permission denied", 3: "destination already in catalogue: trash/z/Thumbs.db"}


def test_hot_hash_and_hot_destination_are_salted(spark):
    """One hash (and its destination) holds 90% of the candidates: results
    equal the unsalted plan, and the salted plan spreads the hot key."""
    n = 3000
    files = [dict(id=i, store="raw", path=f"d{i:05d}/IMG.JPG", sha256="hot" if i % 10 else f"h{i}", mod_time=MT)
             for i in range(1, n + 1)]
    t = media(spark, files)
    salted = organize_plan(t, "UTC", buckets=3).collect()
    plain = organize_plan(t, "UTC").collect()
    assert sorted(map(tuple, salted)) == sorted(map(tuple, plain))
    s = {}
    for r in salted:
        s[r.status] = s.get(r.status, 0) + 1
    assert s == {"organized": 1 + n // 10, "skipped": n - n // 10 - 1}
    assert [r.path for r in salted if r.sha256 == "hot" and r.status == "organized"] == ["d00001/IMG.JPG"]


def test_salted_join_spreads_hot_key(spark):
    from ledgerwalk.operators.skew import salted_join
    big = spark.range(0, 5000).select(F.col("id"), F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(-1).alias("k"))
    small = spark.range(-1, 5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    j = salted_join(big, small, "k", "left", buckets=8)
    assert j.count() == 5000 and j.filter(F.col("v").isNull()).count() == 0
    per_task = j.filter(F.col("k") == -1).groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 1


def test_hashes_that_share_a_destination(spark):
    """Two hashes with equal first digits, second and base name: the winner of a
    destination is the first row whose own hash is not organised elsewhere."""
    a, b = "0123456789aa", "0123456789bb"
    t = media(spark, [dict(id=1, store="raw", path="1/first.jpg", sha256=a, mod_time=MT),
                      dict(id=2, store="raw", path="2/same.jpg", sha256=a, mod_time=MT),
                      dict(id=3, store="raw", path="3/same.jpg", sha256=b, mod_time=MT),
                      dict(id=4, store="raw", path="4/same.jpg", sha256=b, mod_time=MT)])
    t["mime"] = spark.createDataFrame([(h, 0, MT, "image/jpeg") for h in (a, b)], t["mime"].schema)
    # row 2 is skipped (its hash is organised by row 1), so the destination is free for row 3
    assert {r.file_id: r.status for r in organize_plan(t, "UTC").collect()} == {1: "organized", 2: "skipped", 3: "organized", 4: "skipped"}
    t["files"] = t["files"].filter("id <> 1").withColumn("path", F.when(F.col("id") == 4, "5/other.jpg").otherwise(F.col("path")))
    # row 2 takes it, row 3 collides, and its hash's next row has a destination of its own
    assert {r.file_id: r.status for r in organize_plan(t, "UTC").collect()} == {2: "organized", 3: "collided", 4: "organized"}


@pytest.mark.parametrize("seed", [1, 2])
def test_organize_equals_one_by_one(spark, seed):
    """Contested destinations, taken and freed ones, errors: against the candidates
    taken one by one in path order."""
    import random
    rng = random.Random(seed)
    hashes = [f"{rng.randrange(3):08d}{i:04d}" for i in range(25)]
    files = [dict(id=i, store="raw", path=f"{rng.randrange(1000):04d}/{rng.choice('ab')}.jpg", sha256=rng.choice(hashes),
                  mod_time=None if rng.random() < 0.1 else datetime(2020, 1, 1, 0, 0, rng.randrange(2))) for i in range(1, 150)]
    files = list({f["path"]: f for f in files}.values())
    name = lambda f: f"media/2020/01/{f['mod_time']:%Y%m%dT%H%M%S}Z-{f['sha256'][:8]}-{f['path'][-5:]}"
    dated = [f for f in files if f["mod_time"]]
    clean = [dict(id=500 + k, store="clean", path=p, sha256=f"other{k}", missing=k % 3 == 0) for k, p in enumerate(sorted({name(f) for f in dated})[::3])]
    clean.append(dict(id=600, store="clean", path="elsewhere.jpg", sha256=hashes[0]))
    t = media(spark, [{**f, "mod_time": f["mod_time"] or MT} for f in files] + clean)
    t["mime"] = spark.createDataFrame([(h, 0, MT, "image/jpeg") for h in hashes], t["mime"].schema)
    t["files"] = t["files"].withColumn("mod_time", F.when(F.col("id").isin([f["id"] for f in files if not f["mod_time"]]), F.lit(None).cast("timestamp_ntz")).otherwise(F.col("mod_time")))
    here = {c["path"] for c in clean if not c.get("missing")}
    done = {c["sha256"] for c in clean if not c.get("missing")}
    want = {}
    for f in sorted(files, key=lambda f: f["path"]):
        if not f["mod_time"]:
            want[f["id"]] = "error"
        elif f["sha256"] in done:
            want[f["id"]] = "skipped"
        elif name(f) in here:
            want[f["id"]] = "collided"
        else:
            want[f["id"]] = "organized"
            here.add(name(f))
            done.add(f["sha256"])
    assert set(want.values()) == {"error", "skipped", "collided", "organized"}
    assert {r.file_id: r.status for r in organize_plan(t, "UTC").collect()} == want


def test_missing_clean_row_at_destination_is_revived(spark):
    dst = "media/2020/05/20200506T070809Z-h1-a.jpg"
    t = media(spark, [dict(id=1, store="raw", path="a.jpg", sha256="h1", mod_time=MT),
                      dict(id=7, store="clean", path=dst, sha256="old", missing=True)])
    plan = organize_plan(t, "UTC")
    assert statuses(plan) == {"a.jpg": "organized"}
    out = apply_organize(t, plan, spark.createDataFrame([(1, None, None)], "file_id long, error string, remove_error string"),
                         remove_originals=False, now=NOW)
    clean = [r for r in out["files"].collect() if r.store == "clean"]
    assert [(r.id, r.path, r.sha256, r.missing) for r in clean] == [(7, dst, "h1", False)]
    assert out["operations"].first().file_id == 7


def test_timestamp_error_precedes_already_clean(spark):
    t = media(spark, [dict(id=1, store="raw", path="a.jpg", sha256="h1"),
                      dict(id=2, store="clean", path="media/x.jpg", sha256="h1")])
    t["files"] = t["files"].withColumn("mod_time", F.lit(None).cast("timestamp_ntz"))
    plan = organize_plan(t, "UTC").collect()
    assert [(r.status, r.error) for r in plan] == [("error", "no usable timestamp (exif + mod_time both unparseable)")]


def test_parts_are_settled_as_a_stream():
    """Parts that go on in the next batch, and one that begins in the middle of one."""
    import pyarrow as pa
    from ledgerwalk.operators.organize import _settle
    rows = [("p", "a", 1, "1", "x"), ("p", "b", 2, "2", "x"), ("p", "a", 3, "3", "y"), ("p", "b", 4, "4", "y"),
            ("q", "a", 5, "1", "x"), ("q", "c", 6, "2", "y"), ("q", "c", 7, "3", "z")]
    names = ["part", "sha256", "file_id", "path", "dst_path"]
    for size in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i:i + size])], names=names) for i in range(0, len(rows), size)]
        got = [i for b in _settle(iter(batches)) for i in b.column("file_id").to_pylist()]
        assert got == [1, 4, 5, 6]


def test_applying_reads_the_plan_twice(spark):
    """Once for what the outcomes decide and once for its errors, however many results
    follow from them."""
    t = media(spark, [dict(id=i, store="raw", path=f"{i}.jpg", sha256=f"h{i}", mod_time=MT) for i in range(1, 21)])
    plan = organize_plan(t, "UTC").checkpoint()
    outcomes = plan.selectExpr("file_id", "if(file_id % 5 = 0, 'disk full', null) AS error", "if(file_id % 7 = 0, 'denied', null) AS remove_error")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    out = apply_organize(t, plan.mapInArrow(counted, plan.schema), outcomes, remove_originals=True, now=NOW)
    assert [out[k].count() for k in ("files", "operations", "process_errors")] == [22, 16, 6]
    assert seen.value == 40
