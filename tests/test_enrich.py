import json

import pytest

from conftest import NOW, T0, files_df, tables
from ledgerwalk import schemas as S
from ledgerwalk.functions.tags import parse_raw_objects, tags_version
from ledgerwalk.operators import (ExifEnricher, MimeEnricher, apply_enrichment, apply_hashes, hash_content,
                                  identify_all_hashes, identify_by_mime, needs_hash, pending_items, reset_stale,
                                  run_enricher)
from ledgerwalk.sources.exif_json import parse_tag_batches

HELLO = "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"


def test_hash_and_errors(spark):
    t = tables(spark, files=[dict(id=1, store="raw", path="hello.txt"), dict(id=2, store="raw", path="locked")])
    items = spark.createDataFrame([(1, "hello.txt", "hello"), (2, "locked", None)], "id long, path string, content string")
    out = apply_hashes(t, hash_content(items), NOW)
    f = {r.id: r for r in out["files"].collect()}
    assert f[1].sha256 == HELLO and f[1].hashed_at == NOW
    assert f[2].sha256 is None and f[2].hashed_at == NOW
    e = out["process_errors"].collect()
    assert [(r.file_id, r.enricher, r.id) for r in e] == [(2, "sha256", 1)]
    assert needs_hash(out["files"]).count() == 0


def test_needs_hash_strict_and_missing(spark):
    from datetime import timedelta
    f = files_df(spark, [dict(id=1, store="raw", path="a"), dict(id=2, store="raw", path="b", hashed_at=T0),
                         dict(id=3, store="raw", path="c", hashed_at=T0 - timedelta(seconds=1)),
                         dict(id=4, store="raw", path="d", missing=True)])
    assert sorted(r.id for r in needs_hash(f).collect()) == [1, 3]


def _media_tables(spark):
    return tables(spark, files=[dict(id=1, store="raw", path="a.jpg", sha256="hj"),
                                dict(id=2, store="raw", path="copy/a.jpg", sha256="hj"),
                                dict(id=3, store="raw", path="b.png", sha256="hp"),
                                dict(id=4, store="raw", path="c.txt", sha256="ht"),
                                dict(id=5, store="raw", path="gone", sha256="hg", missing=True)])


def test_mime_once_per_hash_and_idempotent(spark):
    t = _media_tables(spark)
    content = spark.createDataFrame([(1, bytearray(b"\xff\xd8\xff\xe0")), (2, bytearray(b"\xff\xd8\xff\xe0")),
                                     (3, bytearray(bytes.fromhex("89504E470D0A1A0A"))), (4, bytearray(b"hi\n"))],
                                    "id long, content binary")
    out, stats = run_enricher(t, MimeEnricher(content), NOW)
    mime = {r.hash: r for r in out["mime"].collect()}
    assert {h: r.mime_type for h, r in mime.items()} == {"hj": "image/jpeg", "hp": "image/png", "ht": "text/plain"}
    assert mime["hj"].file_id == 1 and all(r.processed_at == NOW for r in mime.values())
    assert tuple(stats.first()) == (3, 3, 0)
    out2 = dict(out, mime=out["mime"].checkpoint())
    assert identify_all_hashes(out2["files"], out2["mime"]).count() == 0


def test_exif_identify_by_mime_and_reset(spark):
    t = _media_tables(spark)
    mime = spark.createDataFrame([("hj", 1, NOW, "image/jpeg"), ("hp", 3, NOW, "image/png"),
                                  ("ht", 4, NOW, "text/plain")], S.enricher_schema(S.MIME_COLUMNS))
    empty = S.empty(spark, S.enricher_schema(S.EXIF_COLUMNS))
    assert sorted(r.hash for r in identify_by_mime(t["files"], mime, empty).collect()) == ["hj", "hp"]
    assert identify_by_mime(t["files"], mime, empty, []).count() == 0
    v = tags_version()
    exif = spark.createDataFrame([("a", 1, NOW, "{}", "stale"), ("b", 1, NOW, "{}", None), ("c", 1, NOW, "{}", v),
                                  ("d", 1, None, None, None)], S.enricher_schema(S.EXIF_COLUMNS))
    got = {r.hash: r.processed_at for r in reset_stale(exif, v).collect()}
    assert got == {"a": None, "b": None, "c": NOW, "d": None}


def test_pending_uses_lowest_live_copy(spark):
    t = tables(spark, files=[dict(id=9, store="raw", path="z", sha256="h"), dict(id=4, store="clean", path="y", sha256="h"),
                             dict(id=1, store="raw", path="x", sha256="h", missing=True),
                             dict(id=2, store="raw", path="w", sha256="lost", missing=True)])
    table = spark.createDataFrame([("h", 9, None, None), ("lost", 2, None, None)], S.enricher_schema(S.MIME_COLUMNS))
    items = pending_items(table, t["files"], {"raw": "/r", "clean": "/c"}).collect()
    assert [(r.hash, r.file_id, r.abs_path) for r in items] == [("h", 4, "/c/y")]


def test_unknown_result_column_rejected(spark):
    t = _media_tables(spark)
    res = spark.createDataFrame([("hj", 1, "x", None, "boom")], "hash string, file_id long, mime_type string, error string, bogus_col string")
    with pytest.raises(ValueError, match="unknown column 'bogus_col'"):
        apply_enrichment(t, MimeEnricher(), res, NOW)


def test_raw_json_parser_keeps_values_verbatim():
    text = '[{"SourceFile": "/a", "X:N": 1.50, "X:E": 1e5, "X:L": [1, 2], "X:S": "s\\u00e9", "X:Z": null}, null]'
    objs = parse_raw_objects(text)
    assert objs[0] == {"SourceFile": '"/a"', "X:N": "1.50", "X:E": "1e5", "X:L": "[1, 2]",
                       "X:S": '"s\\u00e9"', "X:Z": "null"}
    assert objs[1] is None
    for bad in ("{}", "[1]", '[{"a" 1}]', "[{}] x"):
        with pytest.raises(ValueError):
            parse_raw_objects(bad)


def test_exif_process_policy_and_errors(spark):
    t = _media_tables(spark)
    t["mime"] = spark.createDataFrame([("hj", 1, NOW, "image/jpeg"), ("hp", 3, NOW, "image/png")],
                                      S.enricher_schema(S.MIME_COLUMNS))
    doc = json.dumps([
        {"SourceFile": "/raw/a.jpg", "ExifTool:ExifToolVersion": 12.5, "File:FileSize": "1 kB",
         "EXIF:Make": "Canon", "EXIF:ThumbnailImage": "(Binary data 5 bytes, use -b option to extract)",
         "EXIF:Null": None, "Composite:Aperture": 2.8},
    ])
    doc = doc.replace("2.8", "2.80")  # a number that json would normalise
    docs = spark.createDataFrame([(doc, 0), ('[{"SourceFile": "/raw/b.png", "Error": "bad file"}]', 1)],
                                 "value string, batch long")
    extracted = parse_tag_batches(docs, "value", "batch")
    out, stats = run_enricher(t, ExifEnricher(extracted), NOW, stores={"raw": "/raw"})
    ex = {r.hash: r for r in out["exif"].collect()}
    assert ex["hj"].data == '{"Composite:Aperture":2.80,"EXIF:Make":"Canon"}'
    assert ex["hj"].tags_version == tags_version()
    assert ex["hp"].data is None and ex["hp"].processed_at == NOW
    errs = {r.error for r in out["process_errors"].collect()}
    assert errs == {"exif /raw/b.png: bad file"}
    assert tuple(stats.first()) == (2, 1, 1)
