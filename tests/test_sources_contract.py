import os
import tempfile

import pytest

from pyspark.sql import functions as F

from conftest import NOW, tables
from ledgerwalk.operators import apply_walk
from ledgerwalk.sources import hash_files, list_stores, manifest, read_tables, write_tables
from ledgerwalk.operators import csv_lines, tsv_lines


def _tree():
    root = tempfile.mkdtemp(prefix="lw-tree-")
    raw = os.path.join(root, "raw")
    os.makedirs(os.path.join(raw, "photos", "@eaDir"))
    os.makedirs(os.path.join(raw, "empty", "deeper"))
    for rel, data in [("photos/a.jpg", b"12345"), ("photos/.DS_Store", b"x"), ("photos/@eaDir/t.jpg", b"abc"),
                      ("_underscore.txt", b"hello")]:
        with open(os.path.join(raw, rel), "wb") as f:
            f.write(data)
    os.symlink(os.path.join(raw, "photos", "a.jpg"), os.path.join(raw, "link.jpg"))
    clean = os.path.join(root, "clean")
    os.makedirs(clean)
    return root, raw, clean


def test_list_stores_hidden_empty_and_symlinks(spark):
    root, raw, clean = _tree()
    lst = list_stores(spark, {"raw": raw, "clean": clean})
    rows = {(r.store, r.path): r for r in lst.collect()}
    files = {p for (s, p), r in rows.items() if not r.is_dir}
    dirs = {(s, p) for (s, p), r in rows.items() if r.is_dir}
    assert files == {"photos/a.jpg", "photos/.DS_Store", "photos/@eaDir/t.jpg", "_underscore.txt"}
    assert dirs == {("raw", "."), ("raw", "photos"), ("raw", "photos/@eaDir"), ("raw", "empty"),
                    ("raw", "empty/deeper"), ("clean", ".")}
    assert rows[("raw", "photos/a.jpg")].size == 5
    out, stats = apply_walk(tables(spark), lst, NOW, ["raw", "clean"])
    d = {(r.store, r.path): (r.file_count, r.total_size) for r in out["directories"].collect()}
    assert d[("raw", ".")] == (4, 14) and d[("raw", "empty/deeper")] == (0, 0) and d[("clean", ".")] == (0, 0)
    items = out["files"].select("id", F.concat(F.lit(raw + "/"), "path").alias("abs_path"))
    items = items.unionByName(items.limit(1).select(F.lit(99).cast("long").alias("id"),
                                                    F.lit(raw + "/nope").alias("abs_path")))
    h = {r.id: r for r in hash_files(items).collect()}
    assert h[99].sha256 is None and h[99].error.startswith("hashing ")
    ids = {r.path: r.id for r in out["files"].collect()}
    assert h[ids["_underscore.txt"]].sha256 == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"


def test_missing_store_root_fails(spark):
    import pytest
    with pytest.raises(FileNotFoundError):
        list_stores(spark, {"raw": "/definitely/not/here"})


def test_versioned_tables_roundtrip(spark):
    root = tempfile.mkdtemp(prefix="lw-tables-")
    t = tables(spark, files=[dict(id=1, store="raw", path="a")])
    assert read_tables(spark, root)["files"].count() == 0  # nothing there yet
    assert write_tables(t, root) == 1
    back = read_tables(spark, root)
    assert back["files"].collect()[0].path == "a"
    # only what changed is written; the rest stays where it is
    more = {**back, "files": back["files"].withColumn("path", F.lit("b"))}
    assert write_tables(more, root, base=back) == 2
    assert sorted(x for x in os.listdir(os.path.join(root, "v=2")) if x[0] not in "._") == ["files"]
    assert manifest(spark, root)["tables"]["directories"] == 1
    assert read_tables(spark, root)["files"].first().path == "b" and read_tables(spark, root, 1)["files"].first().path == "a"


def test_table_versions_survive_crashes(spark):
    import shutil
    root = tempfile.mkdtemp(prefix="lw-crash-")
    t = tables(spark, files=[dict(id=1, store="raw", path="a")])
    write_tables(t, root)
    # a job that died between its tables and its manifest: invisible, and never overwritten
    t["files"].write.parquet(os.path.join(root, "v=2", "files"))
    os.makedirs(os.path.join(root, "versions", "2"))
    assert read_tables(spark, root)["files"].count() == 1
    assert write_tables(read_tables(spark, root), root) == 3
    # a table that the manifest names but that is gone is an error, not an empty table
    lost = tempfile.mkdtemp(prefix="lw-lost-")
    write_tables(t, lost)
    os.rename(os.path.join(lost, "v=1", "files"), os.path.join(lost, "elsewhere"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_tables(spark, lost)["files"].count()
    # tables without any manifest are an error too
    bare = tempfile.mkdtemp(prefix="lw-bare-")
    shutil.copytree(os.path.join(root, "v=1"), os.path.join(bare, "v=1"))
    with pytest.raises(ValueError, match="no committed version"):
        read_tables(spark, bare)


def _bytes_under(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_logs_are_written_by_their_new_rows(spark, monkeypatch):
    from ledgerwalk import schemas as S
    from ledgerwalk.operators import appended
    from ledgerwalk.sources import tables as TB
    root = tempfile.mkdtemp(prefix="lw-logs-")
    t = tables(spark, files=[dict(id=1, store="raw", path="a")])
    errors = lambda lo, hi: spark.range(lo, hi).select(
        F.col("id"), F.lit(1).cast("long").alias("file_id"), F.lit(None).cast("long").alias("dir_id"), F.lit("mime").alias("enricher"),
        F.lit(None).cast("string").alias("rule"), F.concat(F.lit("error "), F.sha2(F.col("id").cast("string"), 256)).alias("error"), F.lit(NOW).cast("timestamp_ntz").alias("occurred_at"))
    write_tables({**t, "process_errors": S.conform(errors(0, 20_000), S.PROCESS_ERRORS)}, root)
    large = _bytes_under(os.path.join(root, "v=1", "process_errors"))
    for n in (2, 3):
        base = read_tables(spark, root)
        more = appended(appended(base["process_errors"], S.conform(errors(n * 10 ** 6, n * 10 ** 6 + 5), S.PROCESS_ERRORS)),
                        S.conform(errors(n * 10 ** 6 + 5, n * 10 ** 6 + 10), S.PROCESS_ERRORS))
        assert write_tables({**base, "process_errors": more}, root, base=base) == n
        assert _bytes_under(os.path.join(root, f"v={n}")) < large / 20
    assert manifest(spark, root)["tables"]["process_errors"] == [1, 2, 3]
    assert read_tables(spark, root)["process_errors"].count() == 20_020 and read_tables(spark, root, 2)["process_errors"].count() == 20_010
    # no new rows: no new part; a changed table: written whole
    base = read_tables(spark, root)
    write_tables({**base, "process_errors": appended(base["process_errors"], S.empty(spark, S.PROCESS_ERRORS))}, root, base=base)
    assert manifest(spark, root)["tables"]["process_errors"] == [1, 2, 3]
    base = read_tables(spark, root)
    write_tables({**base, "process_errors": base["process_errors"].filter("id < 100")}, root, base=base)
    assert manifest(spark, root)["tables"]["process_errors"] == 5 and read_tables(spark, root)["process_errors"].count() == 100
    # too many parts: one again
    monkeypatch.setattr(TB, "MAX_PARTS", 2)
    for n in (6, 7):
        base = read_tables(spark, root)
        write_tables({**base, "process_errors": appended(base["process_errors"], S.conform(errors(n * 10 ** 6, n * 10 ** 6 + 1), S.PROCESS_ERRORS))}, root, base=base)
    assert manifest(spark, root)["tables"]["process_errors"] == 7 and read_tables(spark, root)["process_errors"].count() == 102
    # a job that died behind its part: invisible
    base = read_tables(spark, root)
    errors(1, 2).write.parquet(os.path.join(root, "v=8", "process_errors"))
    assert read_tables(spark, root)["process_errors"].count() == 102
    assert write_tables({**base, "process_errors": appended(base["process_errors"], S.conform(errors(8, 9), S.PROCESS_ERRORS))}, root, base=base) == 9
    assert manifest(spark, root)["tables"]["process_errors"] == [7, 9]


def test_vacuum_keeps_what_kept_versions_need(spark):
    from ledgerwalk.sources import vacuum
    root = tempfile.mkdtemp(prefix="lw-vacuum-")
    write_tables(tables(spark, files=[dict(id=1, store="raw", path="a")]), root)
    for n in range(4):
        base = read_tables(spark, root)
        write_tables({**base, "files": base["files"].withColumn("path", F.lit(f"p{n}"))}, root, base=base)
    os.makedirs(os.path.join(root, "v=9", "files"))  # a job that is still writing
    with pytest.raises(ValueError):
        vacuum(spark, root, 0)
    assert vacuum(spark, root, 10) == [] and vacuum(spark, root, 2) == [1, 2, 3]
    folders = {x for x in os.listdir(root) if x.startswith("v=")}
    assert folders == {"v=1", "v=4", "v=5", "v=9"}  # the first holds the tables that never changed
    assert [read_tables(spark, root, v)["files"].first().path for v in (4, 5)] == ["p2", "p3"]
    assert read_tables(spark, root)["directories"].count() == 0 and sorted(os.listdir(os.path.join(root, "versions"))) == ["4", "5"]


def test_text_formats(spark):
    df = spark.createDataFrame([(1, "a,b", None), (2, ' lead', 'q"x')], "n int, s string, t string")
    assert [r.line for r in tsv_lines(df).orderBy("ord", "line").collect()] == ["n\ts\tt", "1\ta,b\t", "2\t lead\tq\"x"]
    assert sorted(r.line for r in csv_lines(df).collect()) == ['1,"a,b",', '2," lead","q""x"', "n,s,t"]
    q = spark.createDataFrame([(1,)], "n int")
    assert [r.line for r in tsv_lines(q).orderBy("ord").collect()] == ["n", "1"]


def test_driver_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert {"op_id", "kind", "file_id", "rule", "reason"} <= set(df.columns)


def test_mime_from_files_reads_whole_texts(spark):
    from ledgerwalk.operators import MimeEnricher, run_enricher
    from ledgerwalk.sources import read_heads
    root = tempfile.mkdtemp(prefix="lw-mime-")
    png = bytes.fromhex("89504E470D0A1A0A") + b"\0" * 3_000_000
    for name, data in [("a.png", png), ("b.txt", b"hello world\n"), ("c.pdf", b"%PDF-1.4\n%%EOF\n")]:
        with open(os.path.join(root, name), "wb") as f:
            f.write(data)
    t = tables(spark, files=[dict(id=1, store="raw", path="a.png", sha256="h1"),
                             dict(id=2, store="raw", path="b.txt", sha256="h2"),
                             dict(id=3, store="raw", path="c.pdf", sha256="h3"),
                             dict(id=4, store="raw", path="gone.bin", sha256="h4")])
    out, stats = run_enricher(t, MimeEnricher(), NOW, stores={"raw": root})
    got = {r.hash: r.mime_type for r in out["mime"].collect()}
    assert got == {"h1": "image/png", "h2": "text/plain", "h3": "application/pdf", "h4": None}
    assert tuple(stats.first()) == (4, 3, 1)
    items = spark.createDataFrame([(os.path.join(root, "a.png"),)], "abs_path string")
    from ledgerwalk.sources.content import HEAD_BYTES
    assert len(read_heads(items).first().head) == HEAD_BYTES


def test_one_mime_answer_whatever_the_size(spark):
    """Content in a row and content in a file: characters across chunk ends, a control
    byte behind the first mebibyte."""
    from ledgerwalk.functions import sniff_mime
    from ledgerwalk.sources import read_heads
    root = tempfile.mkdtemp(prefix="lw-long-")
    data = {"long.txt": b"a" + "é".encode() * 600_000, "late.bin": b"x" * 2_000_000 + b"\x00", "cut.txt": b"a" * 100 + b"\xc3", "empty": b""}
    for name, content in data.items():
        with open(os.path.join(root, name), "wb") as f:
            f.write(content)
    rows = spark.createDataFrame([(os.path.join(root, n), bytearray(c)) for n, c in data.items()], "abs_path string, whole binary")
    got = read_heads(rows).select("abs_path", sniff_mime("head", F.col("is_text")).alias("a"), sniff_mime("whole").alias("b")).collect()
    assert {os.path.basename(r.abs_path): r.a for r in got} == {"long.txt": "text/plain", "late.bin": "application/octet-stream",
                                                                "cut.txt": "application/octet-stream", "empty": "inode/x-empty"}
    assert all(r.a == r.b for r in got)


def test_tiff_directories_behind_the_data(spark):
    """The first directory, or the maker's text, behind 100 KB of pixels: by file and by row."""
    import struct

    from ledgerwalk.functions import sniff_mime
    from ledgerwalk.sources import read_heads

    def late(order, tag, value, near=False):
        pixels, raw = b"\x00\xff" * 50_000, value.encode() + b"\0"
        first = 8 if near else 8 + len(pixels)
        at = 8 + 18 + len(pixels) if near else first + 18
        head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, first)
        entry = struct.pack(order + "HHHII", 1, tag, 2, len(raw), at) + b"\0" * 4
        return head + (entry + pixels + raw if near else pixels + entry + raw)

    root = tempfile.mkdtemp(prefix="lw-tiff-")
    data = {"a": (late("<", 0x10F, "NIKON CORPORATION"), "image/x-nikon-nef"), "b": (late(">", 0x10F, "SONY"), "image/x-sony-arw"),
            "c": (late("<", 0xC612, "1.4.0"), "image/x-adobe-dng"), "d": (late(">", 0x10F, "NIKON", near=True), "image/x-nikon-nef"),
            "e": (late("<", 0x10F, "Canon"), "image/tiff"), "f": (late("<", 0x10F, "SONY")[:90_000], "image/tiff"),
            "g": (b"II*\0\xff\xff\xff\xff", "image/tiff"), "h": (b"II*\0\x10\0\0\0CR\2\0", "image/x-canon-cr2"), "i": (b"MM\0*\0", "image/tiff")}
    for name, (content, _) in data.items():
        with open(os.path.join(root, name), "wb") as f:
            f.write(content)
    rows = spark.createDataFrame([(os.path.join(root, n), bytearray(c)) for n, (c, _) in data.items()], "abs_path string, whole binary")
    got = read_heads(rows).select("abs_path", sniff_mime("head", F.col("is_text")).alias("a"), sniff_mime("whole").alias("b")).collect()
    want = {n: (t, t) for n, (_, t) in data.items()}
    assert {os.path.basename(r.abs_path): (r.a, r.b) for r in got} == want


def test_walks_in_rows_and_in_files_agree(spark):
    """EBML elements and ISO boxes of any size before the one that tells the type, broken
    sizes, random bytes behind a mark."""
    import random

    from ledgerwalk.functions import sniff_mime
    from ledgerwalk.plans import views as V
    from ledgerwalk.sources import read_heads
    root = tempfile.mkdtemp(prefix="lw-walk-")
    filler = V.FILLER * V.FILLED
    data = {f"s{i}": (bytes.fromhex(h.replace("*", filler)), t) for i, (h, t) in enumerate(V.SIGNATURES)}
    doc = b"\x42\x82\x84webm"
    data |= {"many": (b"\x1aE\xdf\xa3\x01\xff\xff\xff\xff\xff\xff\xff" + b"\xec\x80" * 3000 + doc, "video/webm"),  # unknown size
             "padded": (b"\x1aE\xdf\xa3\x89\x42\x82\x86webm\0\0", "video/webm"),
             "outside": (b"\x1aE\xdf\xa3\x82\xec\x80" + doc, "video/x-matroska"),
             "long name": (b"\x1aE\xdf\xa3\xa3\x42\x82\xa0" + b"webm" * 8, "video/x-matroska"),
             "void of unknown size": (b"\x1aE\xdf\xa3\x89\xec\xff" + doc, "video/x-matroska"),
             "cut": (b"\x1aE\xdf\xa3\x87\x42\x82\x84we", "video/x-matroska"), "mark": (b"\x1aE\xdf\xa3", "video/x-matroska"),
             "large box": (b"\0\0\0\x01free" + (16 + 70_000).to_bytes(8, "big") + b"x" * 70_000 + b"\0\0\0\x10ftypisom\0\0\0\0", "video/mp4"),
             "to the end": (b"\0\0\0\0ftypisom\0\0\0\0" + b"none" * 400_000 + b"heic", "image/heic"),
             "endless": (b"\0\0\0\x08free" * 2000, "application/octet-stream"), "size 4": (b"\0\0\0\x04wide\0\0\0\x08moov", "application/octet-stream"),
             "huge": (b"\0\0\0\x01wide" + b"\xff" * 8, "application/octet-stream"), "text": (b"moov and mdat and free", "text/plain"), "named": (b"the free will", "text/plain")}
    rng = random.Random(6)
    for i in range(300):
        mark = rng.choice([b"\x1aE\xdf\xa3", b"\0\0\0\x08free", b"\0\0\0\x14ftyp", b"\0\0\0\x0cskip"])
        parts = [bytes((rng.randrange(256),)), b"\x42\x82", b"\x84webm", b"\xec", b"\x80", b"\x81", b"\0\0\0\x10", b"ftyp", b"heic", b"qt  ", b"isom", b"\0\0\0\x08", b"free", b"moov"]
        data[f"r{i}"] = (mark + b"".join(rng.choice(parts) for _ in range(rng.randrange(14))), None)
    for name, (content, _) in data.items():
        with open(os.path.join(root, name), "wb") as f:
            f.write(content)
    rows = spark.createDataFrame([(os.path.join(root, n), bytearray(c)) for n, (c, _) in data.items()], "abs_path string, whole binary")
    got = read_heads(rows).select("abs_path", F.length("head").alias("n"), sniff_mime("head", F.col("is_text")).alias("a"), sniff_mime("whole").alias("b")).collect()
    for r in got:
        name = os.path.basename(r.abs_path)
        assert r.a == r.b and r.n <= 100, (name, r.a, r.b, data[name][0][:60])
        assert data[name][1] in (None, r.a), (name, r.a)


def test_files_are_dealt_by_bytes(spark):
    from ledgerwalk.sources import spread_by_bytes
    mb = 1 << 20
    sizes = [mb] * 400 + [100 * mb] + [mb // 2] * 200 + [0, None, -5]
    items = spark.createDataFrame(list(enumerate(sizes)), "id long, size long").repartition(7, "id")
    dealt = spread_by_bytes(items, bytes_per_task=10 * mb).withColumn("task", F.spark_partition_id())
    rows = dealt.collect()
    assert sorted((r.id, r.size) for r in rows) == sorted(enumerate(sizes)) and dealt.columns == ["id", "size", "task"]
    load = {}
    for r in rows:
        load.setdefault(r.task, []).append(max(r["size"] or 0, 0))
    assert all(sum(x) <= 12 * mb for x in load.values() if 100 * mb not in x)
    assert sum(sum(x) > 8 * mb for x in load.values()) > 40
    assert min(sum(x) for x in load.values() if 100 * mb in x) <= 112 * mb
    # the same rows go the same way again; files without bytes are spread by their number
    assert sorted(map(tuple, rows)) == sorted(map(tuple, dealt.collect()))
    empty = spark.createDataFrame([(i, 0) for i in range(4000)], "id long, size long")
    assert spread_by_bytes(empty, bytes_per_task=100 * 65536).rdd.getNumPartitions() == 40
    assert spread_by_bytes(empty.limit(0)).collect() == []


def test_stores_by_uri(spark, monkeypatch):
    """A ``file://`` tree equals the local one; so does one listed, read and hashed through
    the client of other file systems."""
    import pandas as pd

    from ledgerwalk.sources import listing, read_heads, storage
    root, raw, clean = _tree()
    os.remove(os.path.join(raw, "link.jpg"))
    os.makedirs(os.path.join(raw, "with space"))
    with open(os.path.join(raw, "with space", "é#1.txt"), "w") as f:
        f.write("hello")
    by_path = {tuple(r) for r in list_stores(spark, {"raw": raw}).collect()}
    assert by_path == {tuple(r) for r in list_stores(spark, {"raw": "file://" + raw.replace(" ", "%20")}).collect()}
    with pytest.raises(FileNotFoundError, match="cannot be listed"):
        list_stores(spark, {"raw": "file:///definitely/not/here"})
    item = spark.createDataFrame([(1, "file://" + raw + "/_underscore.txt")], "id long, abs_path string")
    assert hash_files(item).first().sha256.startswith("2cf24dba") and bytes(read_heads(item).first().head) == b"hello"

    # the remote branch, over pyarrow's own local file system
    monkeypatch.setattr(listing, "local_path", lambda path: None)
    monkeypatch.setattr(storage, "_file_system", lambda base: __import__("pyarrow.fs").fs.LocalFileSystem())
    frontier, got = [("raw", "s3://" + raw, ".")], set()
    monkeypatch.setattr(storage, "file_system", lambda uri: (storage._file_system(""), uri.split("://", 1)[1]))
    while frontier:
        frames = list(listing._scan(iter([pd.DataFrame(frontier, columns=["store", "root", "rel"])])))
        rows = [r for f in frames for r in f.itertuples(index=False)]
        frontier = [(r.store, r.root, r.path) for r in rows if r.kind == "S"]
        got |= {(r.store, r.path, False, r.size, r.mod_time.to_pydatetime(), True) for r in rows if r.kind == "F" and r.stated}
        got |= {(r.store, r.path, True, None, None, r.kind == "D") for r in rows if r.kind in "DU"}
    assert got == by_path
    monkeypatch.setattr(storage, "local_path", lambda path: None)
    with storage.open_file("s3://" + raw + "/_underscore.txt") as f:
        assert f.read() == b"hello" and f.seek(1) == 1 and f.read(2) == b"el"


def test_costly_work_is_done_once(spark):
    """Listing, hash results and MIME results are evaluated once a row, however many
    outputs read them."""
    from ledgerwalk import schemas as S
    from ledgerwalk.operators import apply_hashes, apply_walk
    seen = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b
        return df.mapInArrow(run, df.schema)

    listing = spark.createDataFrame([("raw", ".", True, None, None, True)] + [("raw", f"d/{i}", False, i, NOW, True) for i in range(9)], S.LISTING)
    out, stats = apply_walk(tables(spark), listing, NOW, ["raw"])
    assert out["files"].count() == 9 and stats.first()[0] == 9
    results = counted(spark.createDataFrame([(i, f"h{i}" if i % 2 else None, None if i % 2 else "hashing: no") for i in range(1, 9)], "id long, sha256 string, error string"))
    done = apply_hashes(out, results, NOW)
    assert done["files"].filter("hashed_at is not null").count() == 8 and done["process_errors"].count() == 4
    assert seen.value == 8


def test_read_tags_from_files_and_text_sinks(spark):
    import glob
    from ledgerwalk.operators import write_csv, write_tsv
    from ledgerwalk.sources import read_tags
    d = tempfile.mkdtemp(prefix="lw-tags-")
    with open(os.path.join(d, "batch1.json"), "w") as f:
        f.write('[{"SourceFile": "/r/a.jpg", "EXIF:ISO": 100},\n {"SourceFile": "/r/b.jpg", "Error": "bad"}]\n')
    with open(os.path.join(d, "broken.json"), "w") as f:
        f.write("[{not json")
    rows = {r.source_file: r for r in read_tags(spark, d).collect()}
    assert set(rows) == {"/r/a.jpg", "/r/b.jpg", None} and rows[None].parse_error
    assert dict(rows["/r/a.jpg"].tags)["EXIF:ISO"] == "100" and rows["/r/b.jpg"].error == "bad"

    # items without a row are told that a part of the output is missing
    from ledgerwalk.operators import match_tags
    items = spark.createDataFrame([("h1", 1, "/r/a.jpg"), ("h2", 2, "/r/b.jpg"), ("h3", 3, "/r/c.jpg")], "hash string, file_id long, abs_path string")
    errors = {r.hash: r.error for r in match_tags(items, read_tags(spark, d), "v").collect()}
    assert errors["h1"] is None and errors["h2"] == "exif /r/b.jpg: bad"
    assert errors["h3"].startswith("exif: no result for /r/c.jpg (unparsed output: ")

    out = tempfile.mkdtemp(prefix="lw-sink-")
    values = ["a,b", None, 'q"x', "  lead and trail  ", " ", "tab\tin", "\u00a0nbsp", "two\nlines", "\\.", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, s string").orderBy("n")
    write_tsv(df, out + "/tsv")
    write_csv(df, out + "/csv")
    tsv = "".join(open(p, newline="").read() for p in sorted(glob.glob(out + "/tsv/part-*")))
    assert tsv == "n\ts\n" + "".join(f"{i}\t{v or ''}\n" for i, v in enumerate(values))
    csv = "".join(open(p, newline="").read() for p in sorted(glob.glob(out + "/csv/part-*")))
    quoted = ['"a,b"', "", '"q""x"', '"  lead and trail  "', '" "', "tab\tin", '"\u00a0nbsp"', '"two\nlines"', '"\\."', ""]
    assert csv == "n,s\n" + "".join(f"{i},{q}\n" for i, q in enumerate(quoted))


def _array_file(d, name, text):
    with open(os.path.join(d, name), "wb") as f:
        f.write(text.encode() if isinstance(text, str) else text)
    return os.path.join(d, name)


def test_arrays_are_read_by_range(spark, monkeypatch):
    """Every cut of an array gives its elements once, in their places: quotes, escapes,
    brackets in strings, nested values, wide characters, white space."""
    import json
    import random

    from ledgerwalk.functions.tags import parse_raw_objects
    from ledgerwalk.sources import json_arrays as J
    rng = random.Random(3)
    d = tempfile.mkdtemp(prefix="lw-arrays-")
    pieces = ['"', "\\", "\\\\", "[", "]", "{", "}", ",", ":", "é", "日本", "a", " ", "\n", "\u0001"]
    for case in range(25):
        objs = [{f"k{i}": rng.choice([rng.random(), None, True, ["x,", {"y": "]"}], "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))]) for i in range(rng.randrange(4))}
                for _ in range(rng.randrange(9))]
        text = json.dumps(objs, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        text = rng.choice(["", "  \n"]) + text + rng.choice(["", "\n \t"])
        path = _array_file(d, f"f{case}", text)
        size = len(text.encode())
        want = parse_raw_objects(text)
        monkeypatch.setattr(J, "_CHUNK", rng.choice([1, 2, 3, 7, 64]))
        monkeypatch.setattr(J, "ELEMENTS", rng.choice([1, 2, 100]))
        for step in (1, 2, 3, 5, 11, 40, size + 1):
            ranges = __import__("pandas").DataFrame([(path, s, min(s + step, size), size) for s in range(0, max(size, 1), step)], columns=["path", "start", "stop", "size"])
            placed = J._chain(next(J._scan_range(iter([ranges]))))
            got = {}
            for r in placed.itertuples(index=False):
                for first, part in J.elements(*r[:4], *r[4:]):
                    for i, x in enumerate(parse_raw_objects(part)):
                        assert first + i not in got
                        got[first + i] = x
            assert [got[i] for i in range(len(got))] == want, (text, step)


def test_broken_arrays_are_errors_at_every_cut(spark, monkeypatch):
    import pandas as pd

    from ledgerwalk.functions.tags import parse_raw_objects
    from ledgerwalk.sources import json_arrays as J
    d = tempfile.mkdtemp(prefix="lw-broken-")
    monkeypatch.setattr(J, "_CHUNK", 3)
    for i, text in enumerate(["", "  ", "x", "{}", '"a"', "[", "[{}", "[{},", "[{},]", "[,{}]", "[{},,{}]", "[{}] x", "[{}][{}]", "[{}}", "[{]]", "[1]", '[{"a":1}, {"b"}]', "]", "x[{}]", '[{"a":"']):
        with pytest.raises(ValueError):
            parse_raw_objects(text)
        path = _array_file(d, f"b{i}", text)
        for step in (1, 2, 4, 100):
            ranges = pd.DataFrame([(path, s, min(s + step, len(text)), len(text)) for s in range(0, max(len(text), 1), step)], columns=["path", "start", "stop", "size"])
            errors = 0
            for r in J._chain(next(J._scan_range(iter([ranges])))).itertuples(index=False):
                try:
                    for _, part in J.elements(*r):
                        parse_raw_objects(part)
                except ValueError:
                    errors += 1
            assert errors, (text, step)


def test_a_large_array_is_read_by_many_tasks(spark):
    from ledgerwalk.sources import json_arrays, read_tags
    d = tempfile.mkdtemp(prefix="lw-large-")
    n = 30_000
    body = ",\n".join('{"SourceFile": "/r/%d.jpg", "XMP:Title": "a \\"%s\\" [b], {c}", "EXIF:ISO": 1.50}' % (i, "é" * (i % 50)) for i in range(n))
    _array_file(d, "big one.json", f"[{body}]\n")
    _array_file(d, "small.json", '[{"SourceFile": "/r/0.jpg", "EXIF:ISO": 2}, null]')
    _array_file(d, "bad.json", f"[{body}] trailing")
    _array_file(d, "empty.json", "[]")
    assert json_arrays.file_ranges(spark, d, 1 << 18).filter("path like '%big one.json'").count() > 10
    rows = read_tags(spark, d, range_bytes=1 << 18)
    assert rows.filter("parse_error is null").count() == n + 2
    bad, = rows.filter("parse_error is not null").collect()
    assert bad.ordinal.doc.endswith("bad.json") and bad.parse_error == "trailing data after array"
    big = rows.filter("ordinal.doc like '%big one.json'")
    assert big.filter("source_file = concat('/r/', ordinal.pos, '.jpg') and tags['EXIF:ISO'] = '1.50'").count() == n
    assert big.select("ordinal.pos").distinct().count() == n
    whole = {(r.ordinal.doc, r.ordinal.pos, r.source_file) for r in read_tags(spark, d).collect()}
    assert whole == {(r.ordinal.doc, r.ordinal.pos, r.source_file) for r in rows.collect()}


def test_last_duplicate_wins_by_number(spark):
    from ledgerwalk.operators import match_tags
    from ledgerwalk.sources import parse_tag_batches
    docs = spark.createDataFrame([(i, '[{"SourceFile": "/p", "XMP:Rating": %d}]' % i) for i in (2, 10, 9)], "doc long, value string")
    items = spark.createDataFrame([("h", 1, "/p")], "hash string, file_id long, abs_path string")
    assert "10" in match_tags(items, parse_tag_batches(docs, "value", "doc"), "v").first().data


def test_two_results_for_one_hash_fail(spark):
    from ledgerwalk.operators import MimeEnricher, apply_enrichment
    t = tables(spark)
    t["mime"] = spark.createDataFrame([("h", 1, None, None)], "hash string, file_id long, processed_at timestamp_ntz, mime_type string")
    twice = spark.createDataFrame([("h", 1, "a/b", None), ("h", 1, "c/d", None)], "hash string, file_id long, mime_type string, error string")
    with pytest.raises(Exception, match="more than one result for h"):
        apply_enrichment(t, MimeEnricher(), twice, NOW)["mime"].collect()
