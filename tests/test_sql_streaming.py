import os
import tempfile

import pytest

from conftest import NOW, T0
from ledgerwalk import schemas as S
from ledgerwalk.functions import valid_mime
from ledgerwalk.operators import align_schema, apply_walk, query
from ledgerwalk.sources import manifest, read_tables, write_tables
from ledgerwalk.streaming import apply_snapshot, publish_snapshot, walk_stream


def test_valid_mime(spark):
    df = spark.createDataFrame([(" image/png\n", "/a"), ("regular file, no read permission", "/b")],
                               "raw string, p string")
    rows = df.select(valid_mime("raw", "p").alias("m")).collect()
    assert (rows[0].m.mime_type, rows[0].m.error) == ("image/png", None)
    assert (rows[1].m.mime_type, rows[1].m.error) == (None, "detecting mime for /b: regular file, no read permission")


def test_align_schema(spark):
    df = spark.createDataFrame([("h", 1, None, "{}", "old")], "hash string, file_id long, processed_at timestamp_ntz, "
                                                              "data string, stale_col string")
    out = align_schema(df, S.ENRICHER_BASE, [("data", "TEXT"), ("tags_version", "TEXT"), ("rating", "INTEGER")])
    assert out.columns == ["hash", "file_id", "processed_at", "data", "tags_version", "rating"]
    assert dict(out.dtypes)["rating"] == "bigint"
    for bad in [("bad-name", "TEXT"), ("ok", "VARCHAR(3)")]:
        with pytest.raises(ValueError):
            align_schema(df, S.ENRICHER_BASE, [bad])


def test_query_sql_surface(spark):
    t = {"directories": spark.createDataFrame([(1, "raw", ".", 3, 82854982, True)], S.DIRECTORIES)}
    r = query(spark, t, "SELECT human_ibytes(total_size) AS s, human_bytes(total_size) AS b FROM directories").first()
    assert (r.s, r.b) == ("79 MiB", "83 MB")
    assert query(spark, {}, "SELECT 1 AS n").collect()[0].n == 1
    with pytest.raises(ValueError):
        query(spark, t, "   ")


def test_queries_only_read(spark):
    t = {"directories": spark.createDataFrame([(1, "raw", ".", 3, 5, True)], S.DIRECTORIES)}
    out = os.path.join(tempfile.mkdtemp(prefix="lw-sql-"), "out")
    for text in (f"INSERT OVERWRITE DIRECTORY '{out}' USING parquet SELECT * FROM directories", "DROP VIEW directories",
                 f"WITH x AS (SELECT 1 AS a) INSERT OVERWRITE DIRECTORY '{out}' USING parquet SELECT * FROM x", "CREATE TABLE q AS SELECT 1 AS a",
                 "SET spark.sql.shuffle.partitions = 3"):
        with pytest.raises(ValueError, match="only queries"):
            query(spark, t, text)
    assert not os.path.exists(out)
    assert query(spark, t, "WITH x AS (SELECT * FROM directories) SELECT 'INSERT INTO t' AS s FROM x UNION ALL SELECT 'b'").count() == 2


def listing(spark, sizes, dirs=(".",)):
    rows = [("raw", d, True, None, None, True) for d in dirs] + [("raw", p, False, n, T0, True) for p, n in sizes.items()]
    return spark.createDataFrame(rows, S.LISTING)


def state(spark, cat):
    t = read_tables(spark, cat)
    return (sorted((r.id, r.path, r.size, r.reconciled_at) for r in t["files"].collect()),
            sorted((r.path, r.file_count, r.total_size) for r in t["directories"].collect()))


def test_walk_stream_applies_snapshots_once_and_in_order(spark):
    base = tempfile.mkdtemp(prefix="lw-stream-")
    snaps, cat, ck, alone = (os.path.join(base, x) for x in ("snaps", "catalogue", "ckpt", "alone"))
    first = listing(spark, {"a.txt": 5, "d/b.txt": 7}, (".", "d")).repartition(3)  # a snapshot of several files
    second = listing(spark, {"a.txt": 6, "c.txt": 1})
    publish_snapshot(first, snaps, 1, T0)
    publish_snapshot(second, snaps, 2, NOW)  # both in one micro-batch
    walk_stream(spark, snaps, cat, ck, ["raw"]).awaitTermination(240)
    for number, snapshot, at in ((1, first, T0), (2, second, NOW)):
        tables = read_tables(spark, alone)
        write_tables(apply_walk(tables, snapshot, at, ["raw"])[0], alone)
    assert state(spark, cat) == state(spark, alone)
    assert state(spark, cat)[1] == [(".", 2, 7)]
    # a batch that runs again applies nothing
    before = manifest(spark, cat)["version"]
    assert not apply_snapshot(spark, snaps, cat, 1, T0, ["raw"]) and not apply_snapshot(spark, snaps, cat, 2, NOW, ["raw"])
    walk_stream(spark, snaps, cat, os.path.join(base, "ckpt2"), ["raw"]).awaitTermination(240)
    assert manifest(spark, cat)["version"] == before
    # a snapshot that holds rows twice counts them once
    publish_snapshot(second.unionByName(second), snaps, 3, NOW)
    walk_stream(spark, snaps, cat, ck, ["raw"]).awaitTermination(240)
    assert state(spark, cat)[1] == [(".", 2, 7)] and manifest(spark, cat)["notes"]["last_snapshot"] == 3
