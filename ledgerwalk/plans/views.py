"""Catalogue tables derived from the driver's tables.

No driver table holds a file system, so the registered queries run over
catalogues that Spark derives from ``documents`` (real text content, exact
and near copies, junk names) and ``orders`` (bulk media-like files with tag
JSON).  Everything is a deterministic function of the input rows, so the
work grows with the tables.  ``oracle.py`` holds the same derivations in
DuckDB SQL.
"""

from __future__ import annotations

import struct
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.paths import ancestors, dirname
from ..functions.tags import tags_version
from ..operators.catalog import _ts, directory_rollup
from ..operators.ids import with_dense_ids
from ..sources.storage import write_file

DOCS_NOW = datetime(2024, 3, 4, 0, 0, 0)
MEDIA_NOW = datetime(2002, 1, 1, 0, 0, 0)
MEDIA_ZONE = "America/New_York"
STORE_ROOTS = {"raw": "/stores/raw", "clean": "/stores/clean", "trash": "/stores/trash"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ----------------------------------------------------------------- documents

def docs_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files columns + ``content`` (the text, NULL for simulated unreadable files)."""
    d = table(spark, sf_dir, "documents")
    return d.selectExpr(
        "doc_id + 1 AS id",
        "CASE WHEN doc_id % 10 = 9 THEN 'clean' ELSE 'raw' END AS store",
        """CASE WHEN doc_id % 23 = 0 THEN concat(source, '/', lang, '/d', doc_id, '/.DS_Store')
                WHEN doc_id % 29 = 0 THEN concat(source, '/@eaDir/d', doc_id, '.txt')
                WHEN doc_id % 31 = 0 THEN concat(source, '/', lang, '/._d', doc_id, '.txt')
                ELSE concat(source, '/', lang, '/d', doc_id, '.txt') END AS path""",
        "CAST(octet_length(text) AS BIGINT) AS size",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id) AS mod_time",
        "timestamp_ntz'2024-01-01 00:00:00' AS found_at",
        "timestamp_ntz'2024-03-02 00:00:00' + make_dt_interval(0, CAST(doc_id % 97 AS INT) - 48, 0, 0) AS reconciled_at",
        "doc_id % 37 = 0 AS missing",
        "sha2(text, 256) AS sha256",
        """CASE doc_id % 7 WHEN 0 THEN CAST(NULL AS TIMESTAMP_NTZ)
                WHEN 1 THEN timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id - 1)
                WHEN 2 THEN timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id)
                ELSE timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 1, 0, doc_id) END AS hashed_at""",
        "CASE WHEN doc_id % 41 = 0 THEN CAST(NULL AS STRING) ELSE text END AS content",
        "lang", "source",
    )


def docs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.conform(docs_base(spark, sf_dir), S.FILES)


def listing_from_files(files: DataFrame) -> DataFrame:
    """A walk's view of a catalogue: live files, and every directory holding
    any catalogued file (missing ones too, so emptied directories show up)."""
    f = files.filter(~F.col("missing")).select(
        "store", "path", F.lit(False).alias("is_dir"), "size", "mod_time", F.lit(True).alias("listed"))
    d = files.select("store", F.explode(ancestors(dirname("path"))).alias("path")).distinct().select(
        "store", "path", F.lit(True).alias("is_dir"), F.lit(None).cast("long").alias("size"),
        F.lit(None).cast("timestamp_ntz").alias("mod_time"), F.lit(True).alias("listed"))
    return S.conform(f.unionByName(d), S.LISTING)


def directories_of(files: DataFrame) -> DataFrame:
    """directories table of a catalogue; ids follow (store, path) order from 1."""
    rolled = directory_rollup(listing_from_files(files))
    return S.conform(with_dense_ids(rolled, ["store", "path"], 1), S.DIRECTORIES)


def docs_tables(spark: SparkSession, sf_dir: str, with_dirs: bool = True) -> dict[str, DataFrame]:
    files = docs_files(spark, sf_dir)
    if not with_dirs:
        return {"files": files}
    files = files.checkpoint()  # read by the rollup and by every rule
    return {
        "files": files,
        "directories": directories_of(files),
        "operations": S.empty(spark, S.OPERATIONS),
        "process_errors": S.empty(spark, S.PROCESS_ERRORS),
    }


def docs_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_base(spark, sf_dir).select("id", "path", "content")


def docs_mime_partial(files: DataFrame) -> DataFrame:
    """An earlier mime run covered the hashes whose lowest live id is divisible by 3."""
    per = files.filter(~F.col("missing")).groupBy(F.col("sha256").alias("hash")).agg(F.min("id").alias("file_id"))
    return S.conform(per.filter(F.col("file_id") % 3 == 0).select(
        "hash", "file_id", _ts(DOCS_NOW).alias("processed_at"),
        F.lit("text/plain").alias("mime_type")), S.enricher_schema(S.MIME_COLUMNS))


def _tiff_head(make: str = "", dng: bool = False) -> str:
    """Hex of a little-endian TIFF head whose directory has a width, a maker and
    perhaps a DNG version; the maker's text follows the directory."""
    count = 1 + bool(make) + dng
    at = 8 + 2 + 12 * count + 4
    entries = struct.pack("<HHII", 0x0100, 4, 1, 4000)
    if make:
        entries += struct.pack("<HHII", 0x010F, 2, len(make) + 1, at)
    if dng:
        entries += struct.pack("<HHII", 0xC612, 1, 4, 0x0401)
    return (b"II*\0" + struct.pack("<IH", 8, count) + entries + b"\0" * 4 + make.encode() + b"\0").hex()


def _ftyp(brand: str) -> str:
    return "00000020" + (b"ftyp" + brand.encode()).hex()


def _box(kind: str, payload: str = "") -> str:
    return f"{8 + len(payload) // 2:08x}" + kind.encode().hex() + payload


def _brands(major: str, *others: str) -> str:
    return _box("ftyp", (major + "\0\0\0\1" + "".join(others)).encode().hex())


#: 100 KB inside elements that a reader has to pass over: another file's document type,
#: over and over.  ``*`` in a signature stands for it.
FILLER, FILLED = "4282847765626d", 14_286


def _ebml(doc_type: str) -> str:
    """An EBML header whose document type stands behind the filler."""
    name = doc_type.encode().hex()
    void = f"ec{0x10000000 + 7 * FILLED:08x}*"
    tail = f"4282{0x80 + len(doc_type):02x}{name}"
    size = 4 + 5 + 7 * FILLED + len(tail) // 2
    return f"1a45dfa3{0x10000000 + size:08x}42868101{void}{tail}"


#: Leading bytes (hex) of each detectable type, with a document's text behind them.
SIGNATURES = (
    ("ffd8ffe0", "image/jpeg"), ("89504e470d0a1a0a", "image/png"), (b"GIF89a".hex(), "image/gif"), (b"%PDF-1.7\n".hex(), "application/pdf"),
    (b"RIFF0000WEBP".hex(), "image/webp"), (b"RIFF0000AVI ".hex(), "video/x-msvideo"), (_ftyp("heic"), "image/heic"), (_ftyp("mif1"), "image/heif"),
    (_ftyp("qt  "), "video/quicktime"), (_ftyp("M4V "), "video/x-m4v"), (_ftyp("3gp4"), "video/3gpp"), (_ftyp("isom"), "video/mp4"),
    ("1a45dfa3a34286810142f7810142f2810442f381084282847765626d", "video/webm"),
    ("1a45dfa3a34286810142f7810142f2810442f3810842828" + "86d6174726f736b61", "video/x-matroska"),
    ("000001ba", "video/mpeg"), ("49492a001000000043520200", "image/x-canon-cr2"), (_tiff_head(), "image/tiff"), (_tiff_head("Canon"), "image/tiff"),
    (_tiff_head("NIKON CORPORATION"), "image/x-nikon-nef"), (_tiff_head("SONY"), "image/x-sony-arw"), (_tiff_head("Leica", True), "image/x-adobe-dng"),
    (_ebml("webm"), "video/webm"), (_ebml("matroska"), "video/x-matroska"), (_brands("isom", "isom", "qt  "), "video/quicktime"),
    (_brands("isom", "iso2", "mif1", "heic"), "image/heic"), (_brands("mp42", "isom", "mp42"), "video/mp4"), (_brands("avif", "mif1"), "image/heif"),
    (f"{8 + 7 * FILLED:08x}66726565*" + _brands("qt  "), "video/quicktime"), (_box("wide") + "000000006d646174", "video/quicktime"),
    (_box("free") + "00000000", "application/octet-stream"),
    ("00", "application/octet-stream"), ("fffe", "application/octet-stream"), ("efbbbf", "text/plain"),
)


def signed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content): every document's text behind the signature that its id picks."""
    heads = F.array(*[F.lit(h) for h, _ in SIGNATURES])
    head = F.element_at(heads, (F.pmod(F.col("doc_id"), F.lit(len(SIGNATURES))) + 1).cast("int"))
    head = F.replace(head, F.lit("*"), F.repeat(F.lit(FILLER), FILLED))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.unhex(head), F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("content"))


def docs_new_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second walk of the docs catalogue: every file whose id is not
    divisible by 13 is seen again (ids divisible by 11 with one more byte),
    plus the pages as new files under ``web/``; directories as visited."""
    files = docs_files(spark, sf_dir)
    seen = files.filter(F.col("id") % 13 != 0).select(
        "store", "path", F.when(F.col("id") % 11 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.col("mod_time"))
    pages = table(spark, sf_dir, "pages").selectExpr(
        "'raw' AS store", "concat('web/p', page_id, '.html') AS path",
        "CAST(octet_length(html) AS BIGINT) AS size", "timestamp_ntz'2024-03-01 00:00:00' AS mod_time")
    entries = seen.unionByName(pages)
    f = entries.select("store", "path", F.lit(False).alias("is_dir"), "size", "mod_time", F.lit(True).alias("listed"))
    d = entries.select("store", F.explode(ancestors(dirname("path"))).alias("path")).distinct().select(
        "store", "path", F.lit(True).alias("is_dir"), F.lit(None).cast("long").alias("size"),
        F.lit(None).cast("timestamp_ntz").alias("mod_time"), F.lit(True).alias("listed"))
    return S.conform(f.unionByName(d), S.LISTING)


# -------------------------------------------------------------------- orders

_DAY = "replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', ':')"
MEDIA_DATA_SQL = f"""CASE
  WHEN o_orderkey % 5 = 0 THEN '{{}}'
  WHEN o_orderkey % 7 = 0 THEN '{{"EXIF:DateTimeOriginal":"0000:00:00 00:00:00"}}'
  WHEN o_orderkey % 11 = 0 THEN concat('{{"Composite:SubSecDateTimeOriginal":"', {_DAY}, ' 10:11:12.345","EXIF:DateTimeOriginal":"', {_DAY}, ' 00:00:00"}}')
  WHEN o_orderkey % 13 = 0 THEN concat('{{"QuickTime:CreateDate":"', {_DAY}, ' 08:00:00Z"}}')
  WHEN o_orderkey % 17 = 0 THEN concat('{{"XMP:CreateDate":"', {_DAY}, ' 23:30:00+05:30"}}')
  WHEN o_orderkey % 19 = 0 THEN concat('{{"EXIF:CreateDate":"', {_DAY}, ' 12:00:00","EXIF:OffsetTime":"bogus"}}')
  WHEN o_orderkey % 23 = 0 THEN concat('{{"RIFF:DateTimeOriginal":"', {_DAY}, ' 07:08:09-99:99"}}')
  WHEN o_orderkey % 29 = 0 THEN '{{"EXIF:DateTimeOriginal":123,"XMP:CreateDate":" "}}'
  WHEN o_orderkey % 31 = 0 THEN concat('{{"EXIF:DateTimeOriginal":"', {_DAY}, ' 9:05:06.1234567"}}')
  ELSE concat('{{"EXIF:DateTimeOriginal":"', {_DAY}, ' 00:00:00","EXIF:OffsetTimeOriginal":"-04:00"}}')
END"""


def media_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.selectExpr(
        "o_orderkey + 1 AS id",
        "CASE WHEN o_orderkey % 53 = 0 THEN 'clean' ELSE 'raw' END AS store",
        "concat('y', year(o_orderdate), '/c', o_custkey % 97, '/o', o_orderkey, '.JPG') AS path",
        "CAST(floor(o_totalprice) AS BIGINT) AS size",
        "o_orderdate AS mod_time", "o_orderdate AS found_at", "o_orderdate AS reconciled_at",
        "false AS missing",
        "sha2(CAST(o_custkey AS STRING), 256) AS sha256",
        "o_orderdate + make_dt_interval(0, 1, 0, 0) AS hashed_at",
        "o_custkey AS ck",
        f"{MEDIA_DATA_SQL} AS data",
    )


def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.conform(media_base(spark, sf_dir), S.FILES)


def media_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = media_base(spark, sf_dir)
    per = b.groupBy(F.col("sha256").alias("hash")).agg(F.min("id").alias("file_id"), F.min("ck").alias("ck"))
    return S.conform(per.selectExpr(
        "hash", "file_id",
        "CASE WHEN ck % 9 = 0 THEN CAST(NULL AS TIMESTAMP_NTZ) ELSE timestamp_ntz'2001-09-01 00:00:00' END AS processed_at",
        """CASE WHEN ck % 9 = 0 THEN CAST(NULL AS STRING)
                ELSE CASE ck % 10 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'image/png'
                                  WHEN 3 THEN 'application/pdf' ELSE 'image/jpeg' END END AS mime_type"""),
        S.enricher_schema(S.MIME_COLUMNS))


def media_exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = media_base(spark, sf_dir).filter(F.col("ck") % 3 != 0)
    per = b.groupBy(F.col("sha256").alias("hash")).agg(
        F.min("id").alias("file_id"), F.min("ck").alias("ck"), F.min_by("data", "id").alias("data"))
    return S.conform(per.selectExpr(
        "hash", "file_id",
        "CASE WHEN ck % 8 = 5 THEN CAST(NULL AS TIMESTAMP_NTZ) ELSE timestamp_ntz'2001-09-02 00:00:00' END AS processed_at",
        "data",
        f"CASE ck % 4 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'stale' ELSE '{tags_version()}' END AS tags_version"),
        S.enricher_schema(S.EXIF_COLUMNS))


def media_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    files = media_files(spark, sf_dir)
    return {
        "files": files,
        "mime": media_mime(spark, sf_dir),
        "exif": media_exif(spark, sf_dir),
        "operations": S.empty(spark, S.OPERATIONS),
        "process_errors": S.empty(spark, S.PROCESS_ERRORS),
    }


def media_extractor_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractor output documents built from orders: one JSON array per
    batch of four order files, one object per file, with the tag kinds the policy has to
    handle (excluded groups, nulls, binary placeholders, verbatim numbers) and
    an ``Error`` for every 17th order."""
    b = media_base(spark, sf_dir).filter(F.col("store") == "raw")
    obj = F.expr(f"""CASE WHEN id % 17 = 0 THEN concat('{{"SourceFile":"{STORE_ROOTS['raw']}/', path, '","Error":"File format error"}}')
      ELSE concat('{{"SourceFile":"{STORE_ROOTS['raw']}/', path, '",',
        '"ExifTool:ExifToolVersion":12.76,"File:FileSize":"', size, ' bytes",',
        '"EXIF:Make":"Maker', ck % 5, '","EXIF:ExposureTime":', CASE WHEN id % 2 = 0 THEN '1.50' ELSE '1e5' END, ',',
        '"EXIF:ThumbnailImage":"(Binary data ', size % 1000, ' bytes, use -b option to extract)",',
        '"EXIF:UserComment":null,"XMP:Subject":["a", "b"],"EXIF:ISO":', ck % 800, '}}') END""")
    # batches of at most 4 files (ids are unique, so the group size is bounded)
    return b.groupBy(F.floor(F.col("id") / 4).alias("batch")).agg(
        F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(F.struct("id", obj.alias("o")))).o, ","),
                 F.lit("]")).alias("value"))


# ------------------------------------------------------- contested destinations

#: Three customers share the first 8 characters of their hash; times are whole years and
#: names one of two, so hashes contest destinations.  Every 25th order has no time.
#: Clean files lie at the destination their own order would get, every other one missing.
CLASH_SQL = """SELECT o_orderkey + 1 AS id,
  CASE WHEN o_orderkey % 53 = 0 THEN 'clean' ELSE 'raw' END AS store,
  CASE WHEN o_orderkey % 53 = 0 THEN concat('media/', {year}, '-', {sha8}, '-img', o_orderkey % 2, '.jpg')
       ELSE concat('c', o_custkey, '/o', o_orderkey, '/img', o_orderkey % 2, '.JPG') END AS path,
  CAST(floor(o_totalprice) AS BIGINT) AS size,
  CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE {start} END AS mod_time,
  o_orderkey % 2 = 0 AND o_orderkey % 53 = 0 AS missing,
  CASE WHEN o_orderkey % 53 = 0 THEN {other} ELSE concat({sha8}, {rest}) END AS sha256"""


def clash_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = "CAST(date_trunc('year', CAST(o_orderdate AS TIMESTAMP)) AS TIMESTAMP_NTZ)"
    text = CLASH_SQL.format(
        start=start, year="date_format(o_orderdate, \"yyyy'/01/'yyyy'0101T000000Z'\")",
        sha8="substring(sha2(CAST(CAST(floor(o_custkey / 3) AS BIGINT) AS STRING), 256), 1, 8)",
        rest="substring(sha2(CAST(o_custkey AS STRING), 256), 9)", other="sha2(concat('clean', o_orderkey), 256)")
    table(spark, sf_dir, "orders").createOrReplaceTempView("_lw_clash_orders")
    rows = spark.sql(text + " FROM _lw_clash_orders")
    # a catalogue has a path once; the least id stays
    first = rows.filter("store = 'clean'").groupBy("path").agg(F.min("id").alias("id"))
    rows = rows.filter("store = 'raw'").unionByName(rows.join(first.select("id"), "id", "left_semi"))
    t = _ts(MEDIA_NOW)
    return S.conform(rows.withColumn("found_at", t).withColumn("reconciled_at", t).withColumn("hashed_at", t), S.FILES)


def clash_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    files = clash_files(spark, sf_dir).checkpoint()
    mime = files.groupBy(F.col("sha256").alias("hash")).agg(F.min("id").alias("file_id")).select(
        "hash", "file_id", _ts(MEDIA_NOW).alias("processed_at"), F.lit("image/jpeg").alias("mime_type"))
    return {"files": files, "mime": S.conform(mime, S.enricher_schema(S.MIME_COLUMNS)),
            "exif": S.empty(spark, S.enricher_schema(S.EXIF_COLUMNS)),
            "operations": S.empty(spark, S.OPERATIONS), "process_errors": S.empty(spark, S.PROCESS_ERRORS)}


# ------------------------------------------------------------------ files on disk

def write_tree(spark: SparkSession, sf_dir: str, root: str) -> dict[str, str]:
    """The readable documents as files under ``root``, a folder for each store."""
    rows = docs_base(spark, sf_dir).filter("content IS NOT NULL AND path IS NOT NULL").select(
        F.concat_ws("/", F.lit(root), "store", "path").alias("place"), F.col("content").cast("binary").alias("content"))

    def write(batches):
        for b in batches:
            for place, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                write_file(place, content)
            yield b.select([0])

    rows.mapInArrow(write, "place string").write.format("noop").mode("overwrite").save()
    return {store: f"{root}/{store}" for store in ("raw", "clean")}
