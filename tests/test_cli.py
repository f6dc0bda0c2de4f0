import os
import tempfile

import pytest

from ledgerwalk.cli import main, parse_duration


def test_parse_duration():
    from datetime import timedelta
    assert parse_duration("") == timedelta(hours=48)
    assert parse_duration("2h30m") == timedelta(hours=2, minutes=30)
    assert parse_duration("1.5h") == timedelta(minutes=90) and parse_duration("-250ms") == timedelta(milliseconds=-250)
    assert parse_duration(".5s1us") == timedelta(microseconds=500_001) and parse_duration("0") == timedelta(0)
    for bad in ("5", "h", "1 h", "1d", "--1h"):
        with pytest.raises(ValueError):
            parse_duration(bad)


def parts(path):
    """Lines of a text sink, in the order of its files."""
    import glob
    return [x for p in sorted(glob.glob(path + "/part-*")) for x in open(p).read().splitlines()]


def test_cli_walk_hash_plan_query(spark, capsys):
    base = tempfile.mkdtemp(prefix="lw-cli-")
    raw = os.path.join(base, "raw")
    os.makedirs(os.path.join(raw, "a"))
    for rel, data in [("a/x.jpg", b"same"), ("y.jpg", b"same"), ("a/.DS_Store", b"j")]:
        with open(os.path.join(raw, rel), "wb") as f:
            f.write(data)
    os.makedirs(os.path.join(base, "clean"))
    cat = os.path.join(base, "catalogue")
    common = ["--catalogue", cat, "--store", f"raw={raw}", "--store", f"clean={os.path.join(base, 'clean')}"]
    assert main(common + ["walk"]) == 0
    assert main(common + ["sha256"]) == 0
    assert main(common + ["plan"]) == 0
    out = capsys.readouterr().out
    assert "Rule: junk (1 ops)" in out and "Rule: dedup (1 ops)" in out and "raw/a/x.jpg -> trash/a/x.jpg" in out
    report, listed = os.path.join(base, "report"), os.path.join(base, "listed")
    assert main(common + ["plan", "--report", report]) == 0
    assert capsys.readouterr().out == "" and parts(report)[0] == "Rule: junk (1 ops)" and len(parts(report)) == 4
    assert main(common + ["query", "SELECT path FROM files ORDER BY path DESC", "--format", "csv", "--out", listed]) == 0
    assert parts(listed) == ["path", "y.jpg", "a/x.jpg", "a/.DS_Store"]
    assert main(common + ["query", "SELECT path FROM files ORDER BY path", "--preview", "1"]) == 0
    assert "only showing top 1 row" in capsys.readouterr().out
    assert main(common + ["query", "SELECT path, human_bytes(size) AS s FROM files WHERE path = 'y.jpg'",
                          "--format", "tsv"]) == 0
    assert capsys.readouterr().out.splitlines()[-2:] == ["path\ts", "y.jpg\t4 B"]


def test_cli_enrich_organize_process_status(spark, capsys):
    from pyspark.sql import functions as F
    base = tempfile.mkdtemp(prefix="lw-cli2-")
    raw = os.path.join(base, "raw")
    os.makedirs(os.path.join(raw, "p"))
    with open(os.path.join(raw, "p", "img.png"), "wb") as f:
        f.write(bytes.fromhex("89504E470D0A1A0A") + b"\0" * 16)
    with open(os.path.join(raw, "p", "Thumbs.db"), "wb") as f:
        f.write(b"junk")
    cat = os.path.join(base, "catalogue")
    common = ["--catalogue", cat, "--store", f"raw={raw}", "--store", f"trash={os.path.join(base, 'trash')}"]
    os.makedirs(os.path.join(base, "trash"))
    for cmd in (["walk"], ["sha256"], ["mime"], ["organize", "--timezone", "UTC", "--dry-run"]):
        assert main(common + cmd) == 0
    out = capsys.readouterr().out
    assert "considered" in out
    ops_dir, outcomes_dir = os.path.join(base, "ops"), os.path.join(base, "outcomes")
    assert main(common + ["plan", "--out", ops_dir]) == 0
    spark.read.parquet(ops_dir).select("op_id", F.lit(None).cast("string").alias("error")) \
        .write.parquet(outcomes_dir)
    assert main(common + ["process", "--ops", ops_dir, "--outcomes", outcomes_dir]) == 0
    assert main(common + ["reconcile", "--max-staleness", "1000h"]) == 0
    capsys.readouterr()
    assert main(common + ["query", "SELECT store, path FROM files ORDER BY path", "--format", "csv"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[-3:] == ["store,path", "trash,p/Thumbs.db", "raw,p/img.png"]
    assert main(common + ["status"]) == 0
    plan_dir, org_out = os.path.join(base, "orgplan"), os.path.join(base, "orgout")
    assert main(common + ["organize", "--timezone", "UTC", "--out", plan_dir]) == 0
    spark.read.parquet(plan_dir).filter("status = 'organized'").select(
        "file_id", F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("remove_error")) \
        .write.parquet(org_out)
    assert main(common + ["organize-apply", "--plan", plan_dir, "--outcomes", org_out]) == 0
    capsys.readouterr()
    assert main(common + ["query", "SELECT count(*) AS n FROM files WHERE store = 'clean'", "--format", "tsv",
                          "--no-header"]) == 0
    assert capsys.readouterr().out.splitlines()[-1] == "1"
