"""Scalar functions: inputs made for each rule and its edges."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerwalk.functions import (destination_path, extract_offset, filename_parts, human_bytes,
                                  human_ibytes, junk_dir_reason, junk_file_reason, parse_offset,
                                  register_sql_functions, rfc3339, sanitize_basename, sniff_mime)
from ledgerwalk.functions.timestamps import validate_zone, with_capture_time, with_exif_date


def column(spark, col, values, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r["r"] for r in df.select("i", col.alias("r")).orderBy("i").collect()]


SIZES = {0: ("0 B", "0 B"), 7: ("7 B", "7 B"), 10: ("10 B", "10 B"), 999: ("999 B", "999 B"), 2300: ("2.3 kB", "2.2 KiB"),
         9_940: ("9.9 kB", "9.7 KiB"), 9_960: ("10 kB", "9.7 KiB"), 3 * 1024 ** 2: ("3.1 MB", "3.0 MiB"),
         250_000_000_000: ("250 GB", "233 GiB"), 2 ** 62: ("4.6 EB", "4.0 EiB"), None: (None, None)}


def test_human_sizes(spark):
    got = column(spark, F.struct(human_bytes("v"), human_ibytes("v")), list(SIZES), "v long")
    assert [tuple(r) for r in got] == list(SIZES.values())


def test_human_sizes_in_sql(spark):
    register_sql_functions(spark)
    assert spark.sql("SELECT human_bytes(64000) AS a, human_ibytes(65536) AS b, human_ibytes(NULL) AS c").first() == ("64 kB", "64 KiB", None)
    with pytest.raises(Exception, match="negative byte count"):
        spark.sql("SELECT human_bytes(-20)").collect()
    with pytest.raises(Exception, match="not a whole number"):
        spark.sql("SELECT human_bytes(0.5)").collect()


@pytest.mark.parametrize("kind,value", [("double", 0.5), ("string", "1500"), ("double", 12.0)])
def test_human_sizes_take_whole_numbers(spark, kind, value):
    df = spark.createDataFrame([(value,)], f"n {kind}")
    with pytest.raises(Exception, match="not a whole number"):
        df.select(human_bytes("n")).collect()


def test_filename_parts(spark):
    want = {"scan 7.tiff": ("scan 7", ".tiff"), "x/y/z.MOV": ("z", ".MOV"), "x.y/Makefile": ("Makefile", ""), "v1.2.tgz": ("v1.2", ".tgz"),
            ".profile": (".profile", ""), "d/.env.local": (".env", ".local"), "trailing.": ("trailing", "."), "ä ö.Ü": ("ä ö", ".Ü")}
    got = column(spark, filename_parts(F.col("v")), list(want))
    assert [(r["base"], r["ext"]) for r in got] == list(want.values())


def test_sanitize_basename(spark):
    want = {"one/two": "one_two", "c:\\x": "c:_x", "bell\x07": "bell_", "\x7f": "_", "\n edge \t": "edge", "\u00a0\u2003in\u3000": "in",
            "\u200bzero": "\u200bzero", " ": "_", "": "_", "a\tb": "a_b"}
    assert column(spark, sanitize_basename(F.col("v")), list(want)) == list(want.values())


def test_destination_path(spark):
    df = spark.createDataFrame([(datetime(1999, 1, 2, 3, 4, 5, 678000), "0f1e2d3c4b5a", "in/Roll 3/No. 9.TIF")], "ts timestamp_ntz, sha string, path string")
    r = df.select(destination_path("ts", "sha", "path").alias("d"), rfc3339("ts").alias("t")).first()
    assert r["d"] == "media/1999/01/19990102T030405Z-0f1e2d3c-No. 9.tif"
    assert r["t"] == "1999-01-02T03:04:05Z"


def test_junk_reasons(spark):
    files = {"m/.DS_Store": "junk file: .DS_Store", "Thumbs.db": "junk file: Thumbs.db", "thumbs.db": None, "k/._song.mp3": "macOS resource fork",
             "k/.notes": None, "nas/@eaDir/p/q.png": "junk directory: @eaDir", "__MACOSX": None, "u/.Trashes/1": "junk directory: .Trashes"}
    assert column(spark, junk_file_reason(F.col("v")), list(files)) == list(files.values())
    dirs = {"nas/@eaDir": "junk directory: @eaDir", "nas/@eaDirs": None, "vol/.Spotlight-V100": "junk directory: .Spotlight-V100", "": None, ".": None}
    assert column(spark, junk_dir_reason(F.col("v")), list(dirs)) == list(dirs.values())


def capture(spark, data, mod_time=None, zone="UTC"):
    df = spark.createDataFrame([(data, mod_time)], "data string, mod_time timestamp_ntz")
    return tuple(with_capture_time(df, "data", "mod_time", zone).select("capture_ts", "source").first())


def test_capture_time_priority(spark):
    data = ('{"EXIF:CreateDate": "2001:01:01 01:01:01", "EXIF:DateTimeOriginal": "2002:02:02 02:02:02",'
            ' "Composite:SubSecDateTimeOriginal": "2003:03:03 03:03:03.25"}')
    assert capture(spark, data) == (datetime(2003, 3, 3, 3, 3, 3, 250000), "Composite:SubSecDateTimeOriginal")
    broken = data.replace("2003:03:03", "2003:13:03")
    assert capture(spark, broken) == (datetime(2002, 2, 2, 2, 2, 2), "EXIF:DateTimeOriginal")
    assert capture(spark, '{"QuickTime:CreateDate": "1998:07:06 05:04:03"}')[1] == "QuickTime:CreateDate"
    assert capture(spark, '{"RIFF:DateTimeOriginal": "1997:07:06 05:04:03"}')[1] == "RIFF:DateTimeOriginal"


def test_capture_time_offsets(spark):
    tag = '{"EXIF:DateTimeOriginal": "2015:11:05 22:30:00%s"%s}'
    assert capture(spark, tag % ("+09:00", ""))[0] == datetime(2015, 11, 5, 13, 30)
    assert capture(spark, tag % ("", ', "EXIF:OffsetTimeOriginal": "-03:30"'))[0] == datetime(2015, 11, 6, 2, 0)
    # the offset in the value wins over its companion, and any over the zone
    assert capture(spark, tag % ("Z", ', "EXIF:OffsetTimeOriginal": "-03:30"'), zone="+05:00")[0] == datetime(2015, 11, 5, 22, 30)
    assert capture(spark, tag % ("", ""), zone="+05:45")[0] == datetime(2015, 11, 5, 16, 45)


def test_capture_time_beyond_eighteen_hours(spark):
    tag = '{"EXIF:DateTimeOriginal": "2015:11:05 12:00:00%s"}'
    assert capture(spark, tag % "+18:00")[0] == datetime(2015, 11, 4, 18)
    assert capture(spark, tag % "-19:00")[0] == datetime(2015, 11, 6, 7)


def test_capture_time_around_clock_changes(spark):
    tag = '{"EXIF:DateTimeOriginal": "%s"}'
    zone = "Europe/Berlin"
    assert capture(spark, tag % "2021:12:24 18:00:00", zone=zone)[0] == datetime(2021, 12, 24, 17)
    assert capture(spark, tag % "2021:06:24 18:00:00", zone=zone)[0] == datetime(2021, 6, 24, 16)
    assert capture(spark, tag % "2021:03:28 02:30:00", zone=zone)[0] == datetime(2021, 3, 28, 1, 30)  # no such time: moved forward
    assert capture(spark, tag % "2021:10:31 02:30:00", zone=zone)[0] == datetime(2021, 10, 31, 0, 30)  # twice: the earlier


@pytest.mark.parametrize("data", [
    None, "", "[1]", "{", '{"EXIF:DateTimeOriginal": ""}', '{"EXIF:DateTimeOriginal": 5}', '{"XMP:Date": "2010:10:10 10:10:10"}',
    '{"EXIF:DateTimeOriginal": "2010:06:31 10:10:10"}', '{"EXIF:DateTimeOriginal": "2010:10:10 25:10:10"}', '{"EXIF:DateTimeOriginal": "2010-10-10 10:10:10"}'])
def test_capture_time_falls_back(spark, data):
    at = datetime(2010, 9, 8, 7, 6, 5)
    assert capture(spark, data, at, "+02:00") == (at, "files.mod_time")
    assert capture(spark, data) == (None, None)


DATES = [("1985:10:26 01:21:00Z", None, datetime(1985, 10, 26, 1, 21)), ("1985:10:26 01:21:00.000001Z", None, datetime(1985, 10, 26, 1, 21, 0, 1)),
         ("1985:10:26 01:21:00.1234567", None, datetime(1985, 10, 26, 1, 21, 0, 123456)), ("1985:10:26 1:21:00", "+01:00", datetime(1985, 10, 26, 0, 21)),
         ("1985:10:26 01:21:00", "east", datetime(1985, 10, 26, 1, 21)), ("1985:10:26 01:21:00+ab:cd", None, None), ("1985:10:26 01:21:00-1:00", None, None),
         ("\u20031985:10:26 01:21:00\n", None, datetime(1985, 10, 26, 1, 21)), ("1985:00:26 01:21:00", None, None), ("", None, None), (None, "+01:00", None)]


def test_exif_dates(spark):
    df = spark.createDataFrame([(i, s, h) for i, (s, h, _) in enumerate(DATES)], "i int, s string, h string")
    got = with_exif_date(df, "s", "h", "UTC").orderBy("i").collect()
    assert [r["ts"] for r in got] == [w for _, _, w in DATES]


def test_offsets(spark):
    got = column(spark, extract_offset("v"), ["12:00Z", "12:00+11:15", "12:00-1:15", ""])
    assert [tuple(r) for r in got] == [("+00:00", "12:00"), ("+11:15", "12:00"), (None, "12:00-1:15"), (None, "")]
    assert column(spark, parse_offset("v"), ["-00:30", "+14:00", "+24:61", "14:00", "+1400", None]) == [-1800, 50400, 24 * 3600 + 61 * 60, None, None, None]


def test_validate_zone():
    assert [validate_zone(z) for z in ("Asia/Kathmandu", "+05:45", "UTC")] == ["Asia/Kathmandu", "+05:45", "UTC"]
    for bad in ("", None, "Mars/Base"):
        with pytest.raises(ValueError):
            validate_zone(bad)


def tiff(order, entries):
    """A TIFF file of one directory; entries are (tag, text or number)."""
    import struct
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    at = 8 + 2 + 12 * len(entries) + 4
    directory, data = struct.pack(order + "H", len(entries)), b""
    for tag, value in entries:
        raw = value.encode() + b"\0" if isinstance(value, str) else struct.pack(order + "I", value)
        if len(raw) <= 4:
            directory += struct.pack(order + "HHI", tag, 2 if isinstance(value, str) else 4, len(raw) if isinstance(value, str) else 1) + raw.ljust(4, b"\0")
        else:
            directory += struct.pack(order + "HHII", tag, 2, len(raw), at + len(data))
            data += raw
    return head + directory + b"\0" * 4 + data


def ebml(doc_type):
    name = doc_type.encode()
    body = b"\x42\x86\x81\x01\x42\xf7\x81\x01" + b"\xec" + bytes([0x80 | 60]) + b"\0" * 60 + b"\x42\x82" + bytes([0x80 | len(name)]) + name
    return b"\x1a\x45\xdf\xa3" + bytes([0x80 | len(body)]) + body


def ftyp(brand):
    return b"\0\0\0\x20ftyp" + brand + b"\0\0\0\0"


TYPES = [
    (b"", "inode/x-empty"), ("plain é text\n".encode(), "text/plain"), (b"text with \x00", "application/octet-stream"), (b"\xff\xfe", "application/octet-stream"),
    (b"\xff\xd8\xff\xdb", "image/jpeg"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF87a", "image/gif"), (b"%PDF-2.0", "application/pdf"),
    (b"RIFF\1\2\3\4WEBP", "image/webp"), (b"RIFF\1\2\3\4AVI ", "video/x-msvideo"), (b"RIFF\1\2\3\4WAVE\0", "application/octet-stream"),
    (ftyp(b"heix"), "image/heic"), (ftyp(b"mif1"), "image/heif"), (ftyp(b"qt  "), "video/quicktime"), (ftyp(b"M4V "), "video/x-m4v"),
    (ftyp(b"3gp5"), "video/3gpp"), (ftyp(b"mp42"), "video/mp4"), (ebml("webm"), "video/webm"), (ebml("matroska"), "video/x-matroska"),
    (b"\0\0\1\xba", "video/mpeg"), (b"II*\0\x10\0\0\0CR\2\0", "image/x-canon-cr2"), (tiff("<", [(0x100, 4000)]), "image/tiff"),
    (tiff(">", [(0x100, 4000), (0x10F, "NIKON CORPORATION")]), "image/x-nikon-nef"), (tiff("<", [(0x10F, "SONY"), (0x110, "ILCE")]), "image/x-sony-arw"),
    (tiff("<", [(0x10F, "NIKON CORPORATION"), (0xC612, 0x0401)]), "image/x-adobe-dng"), (b"MM\0*\0\0\0\x08\xff\xff", "image/tiff"), (b"II*\0", "image/tiff"),
]


def test_sniff_mime(spark):
    assert column(spark, sniff_mime("v"), [bytearray(c) for c, _ in TYPES], "v binary") == [t for _, t in TYPES]
