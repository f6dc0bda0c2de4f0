"""Registered queries: one per operator group of the inventory.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the operator over the
whole derived catalogue; ``ORACLE[name]`` is DuckDB SQL for the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..constants import NO_TIMESTAMP, UNICODE_SPACES
from ..functions import (basename, dirname, filename_parts, human_bytes, human_ibytes, junk_dir_reason,
                         junk_file_reason, path_depth, rfc3339, sanitize_basename, sniff_mime)
from ..operators import (DedupRule, ExifEnricher, JunkRule, MimeEnricher, align_schema, apply_hashes,
                         apply_organize, apply_outcomes, apply_walk, build_plan, catalog_stats,
                         csv_lines, directory_rollup, duplicate_hashes, execution_sequence, execution_stats,
                         hash_content, identify_all_hashes, identify_by_mime, live_raw, mark_missing,
                         needs_hash, organize_candidates, organize_plan, organize_stats, pending_items,
                         plan_report, query, reconcile_marked, reset_stale, run_enricher, tsv_lines)
from ..operators.plan import resolve_outcomes
from ..functions.tags import tags_version
from ..session import ensure_checkpoint_dir
from ..operators.enrich import resolve_path
from ..sources.content import hash_files, read_heads, spread_by_bytes
from ..sources.exif_json import parse_tag_batches
from ..sources.listing import list_stores
from ..sources.tables import read_tables, write_tables
from . import oracle as O
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _junk_claims(t):
    return JunkRule().file_ops(t["files"], None)


# ----------------------------------------------------------------- rules / plan

@register("dedup_ops", O.with_(*O.DOCS_CORE) + "SELECT * FROM dedup_ops")
def q_dedup_ops(spark, sf):
    t = V.docs_tables(spark, sf, with_dirs=False)
    claimed = _junk_claims(t).select("file_id")
    return DedupRule().evaluate(t, claimed)


@register("junk_file_ops", O.with_(*O.DOCS_CORE) + "SELECT * FROM junk_file_ops")
def q_junk_file_ops(spark, sf):
    return JunkRule().file_ops(V.docs_files(spark, sf), None)


@register("junk_dir_ops", O.with_(*O.DOCS_CORE) + "SELECT * FROM junk_dir_ops")
def q_junk_dir_ops(spark, sf):
    return JunkRule().dir_ops(V.docs_tables(spark, sf)["directories"])


@register("plan_ops", O.with_(*O.DOCS_CORE) + "SELECT * FROM plan_ops")
def q_plan_ops(spark, sf):
    return build_plan(V.docs_tables(spark, sf))


@register("plan_report", O.with_(*O.DOCS_CORE) + """
SELECT rule_priority, 0 AS is_op, '' AS plan_key, printf('Rule: %s (%d ops)', rule, count(*)) AS line
FROM plan_ops GROUP BY rule, rule_priority
UNION ALL
SELECT rule_priority, 1, plan_key,
  CASE WHEN kind = 'RMDIR' THEN printf('  %s  %s/%s  (%s)', kind, src_store, src_path, reason)
       ELSE printf('  %s  %s/%s -> %s/%s  (%s)', kind, src_store, src_path, dst_store, dst_path, reason) END
FROM plan_ops
UNION ALL
SELECT -1, 0, '', 'No operations proposed.' FROM (SELECT count(*) AS n FROM plan_ops) WHERE n = 0""")
def q_plan_report(spark, sf):
    return plan_report(build_plan(V.docs_tables(spark, sf)))


@register("execution_order", O.with_(*O.DOCS_CORE, O.EXEC_OPS) + """
SELECT *, row_number() OVER (ORDER BY exec_rank, exec_depth DESC, rule_priority, plan_key) AS seq FROM exec_ops""")
def q_execution_order(spark, sf):
    return execution_sequence(build_plan(V.docs_tables(spark, sf)))


@register("live_raw", O.with_(O.DOCS_BASE, O.DOCS_FILES) +
          "SELECT id, path FROM docs_files WHERE store = 'raw' AND NOT missing")
def q_live_raw(spark, sf):
    return live_raw(V.docs_files(spark, sf)).select("id", "path")


@register("file_junk_reasons", O.with_(O.DOCS_BASE, O.DOCS_FILES) + f"""
SELECT id, path, {O.basename('path')} AS basename, {O.dirname('path')} AS dirname,
  {O.depth('path')} AS depth, {O.junk_file_reason('path')} AS reason
FROM docs_files""")
def q_file_junk_reasons(spark, sf):
    f = V.docs_files(spark, sf)
    return f.select("id", "path", basename("path").alias("basename"), dirname("path").alias("dirname"),
                    path_depth("path").alias("depth"), junk_file_reason("path").alias("reason"))


@register("dir_junk_reasons", O.with_(O.DOCS_BASE, O.DOCS_FILES, O.DOCS_DIRS) + f"""
SELECT id, store, path, {O.depth('path')} AS depth, {O.junk_component('path')} AS reason FROM docs_dirs""")
def q_dir_junk_reasons(spark, sf):
    d = V.docs_tables(spark, sf)["directories"]
    return d.select("id", "store", "path", path_depth("path").alias("depth"), junk_dir_reason("path").alias("reason"))


@register("duplicate_hashes", O.with_(O.DOCS_BASE, O.DOCS_FILES) + """
SELECT sha256, count(*) AS n FROM docs_files
WHERE store = 'raw' AND NOT missing AND sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) > 1""")
def q_duplicate_hashes(spark, sf):
    return duplicate_hashes(V.docs_files(spark, sf))


# ------------------------------------------------------------------ catalogue

@register("directory_rollup", O.with_(O.DOCS_BASE, O.DOCS_FILES, O.DOCS_DIRS) + "SELECT * FROM docs_dirs")
def q_directory_rollup(spark, sf):
    return V.docs_tables(spark, sf)["directories"]


@register("directory_rollup_media", O.with_(*O.MEDIA_CORE, O.dirs_of("media_files", "media_dirs")) +
          "SELECT store, path, file_count, total_size FROM media_dirs")
def q_directory_rollup_media(spark, sf):
    return directory_rollup(V.listing_from_files(V.media_files(spark, sf))) \
        .select("store", "path", "file_count", "total_size")


_STALE_CUTOFF = "TIMESTAMP '2024-03-02 00:00:00'"  # DOCS_NOW - 48h


@register("mark_missing", O.with_(O.DOCS_BASE, O.DOCS_FILES) + f"""
SELECT id, store, path, reconciled_at, missing OR reconciled_at < {_STALE_CUTOFF} AS missing FROM docs_files""")
def q_mark_missing(spark, sf):
    return mark_missing(V.docs_files(spark, sf), V.DOCS_NOW).select("id", "store", "path", "reconciled_at", "missing")


@register("reconcile_marked", O.with_(O.DOCS_BASE, O.DOCS_FILES) + f"""
SELECT CAST(count(*) FILTER (WHERE NOT missing AND reconciled_at < {_STALE_CUTOFF}) AS BIGINT) AS marked
FROM docs_files""")
def q_reconcile_marked(spark, sf):
    return reconcile_marked(V.docs_files(spark, sf), V.DOCS_NOW)


# a second walk: see views.docs_new_listing
_NEW_LISTING = f"""nl_entries AS (
  SELECT store, path, CASE WHEN id % 11 = 0 THEN size + 1 ELSE size END AS size, mod_time
  FROM docs_files WHERE id % 13 <> 0
  UNION ALL
  SELECT 'raw', concat('web/p', page_id, '.html'), CAST(octet_length(encode(html)) AS BIGINT),
         TIMESTAMP '2024-03-01 00:00:00' FROM pages),
nl_files AS (SELECT store, path, size, mod_time, false AS missing FROM nl_entries),
{O.dirs_of("nl_files", "nl_dirs")}"""

_NOW = "TIMESTAMP '2024-03-04 00:00:00'"


@register("upsert_files", O.with_(O.DOCS_BASE, O.DOCS_FILES, _NEW_LISTING) + f"""
SELECT f.id, f.store, f.path, coalesce(e.size, f.size) AS size, coalesce(e.mod_time, f.mod_time) AS mod_time,
  f.found_at, CASE WHEN e.path IS NOT NULL THEN {_NOW} ELSE f.reconciled_at END AS reconciled_at,
  CASE WHEN e.path IS NOT NULL THEN false ELSE f.missing END AS missing, f.sha256, f.hashed_at
FROM docs_files f LEFT JOIN nl_entries e USING (store, path)
UNION ALL
SELECT (SELECT max(id) FROM docs_files) + row_number() OVER (ORDER BY store, path), store, path, size, mod_time,
  {_NOW}, {_NOW}, false, NULL, NULL
FROM nl_entries e WHERE NOT EXISTS (SELECT 1 FROM docs_files f WHERE f.store = e.store AND f.path = e.path)""")
def q_upsert_files(spark, sf):
    t = V.docs_tables(spark, sf)
    out, _ = apply_walk(t, V.docs_new_listing(spark, sf), V.DOCS_NOW, ["raw", "clean", "trash"])
    return out["files"]


@register("upsert_directories", O.with_(O.DOCS_BASE, O.DOCS_FILES, O.DOCS_DIRS, _NEW_LISTING) + """
SELECT d.id, d.store, d.path, n.file_count, n.total_size, true AS listed
FROM docs_dirs d JOIN nl_dirs n USING (store, path)
UNION ALL
SELECT (SELECT max(id) FROM docs_dirs) + row_number() OVER (ORDER BY store, path), store, path, file_count,
  total_size, true
FROM nl_dirs n WHERE NOT EXISTS (SELECT 1 FROM docs_dirs d WHERE d.store = n.store AND d.path = n.path)""")
def q_upsert_directories(spark, sf):
    t = V.docs_tables(spark, sf)
    out, _ = apply_walk(t, V.docs_new_listing(spark, sf), V.DOCS_NOW, ["raw", "clean", "trash"])
    return out["directories"]


@register("walk_stats", O.with_(O.DOCS_BASE, O.DOCS_FILES, O.DOCS_DIRS, _NEW_LISTING) + """
SELECT (SELECT count(*) FROM nl_entries) AS files_found, (SELECT count(*) FROM nl_dirs) AS dirs_upserted,
  (SELECT count(*) FROM docs_dirs d WHERE NOT EXISTS
     (SELECT 1 FROM nl_dirs n WHERE n.store = d.store AND n.path = d.path)) AS dirs_deleted""")
def q_walk_stats(spark, sf):
    t = V.docs_tables(spark, sf)
    _, stats = apply_walk(t, V.docs_new_listing(spark, sf), V.DOCS_NOW, ["raw", "clean", "trash"])
    return stats


# ------------------------------------------------------------------- hashing

_NEEDS = "(hashed_at IS NULL OR hashed_at < mod_time) AND NOT missing"


@register("needs_hash", O.with_(O.DOCS_BASE, O.DOCS_FILES) +
          f"SELECT id, store, path, mod_time, hashed_at FROM docs_files WHERE {_NEEDS}")
def q_needs_hash(spark, sf):
    return needs_hash(V.docs_files(spark, sf)).select("id", "store", "path", "mod_time", "hashed_at")


def _hash_results(spark, sf):
    # hashed where the bytes lie: only the hashes meet the work list
    hashed = hash_content(V.docs_content(spark, sf), "content", "path")
    return hashed.join(needs_hash(V.docs_files(spark, sf)).select("id"), "id", "left_semi")


@register("hash_results", O.with_(O.DOCS_BASE) + f"""
SELECT id, sha256(content) AS sha256,
  CASE WHEN content IS NULL THEN 'hashing ' || path || ': unreadable' END AS error
FROM docs_base WHERE {_NEEDS}""")
def q_hash_results(spark, sf):
    return _hash_results(spark, sf)


@register("apply_hashes", O.with_(O.DOCS_BASE) + f"""
SELECT id, CASE WHEN {_NEEDS} THEN sha256(content) ELSE sha256 END AS sha256,
  CASE WHEN {_NEEDS} THEN {_NOW} ELSE hashed_at END AS hashed_at
FROM docs_base""")
def q_apply_hashes(spark, sf):
    t = V.docs_tables(spark, sf)
    out = apply_hashes(t, _hash_results(spark, sf), V.DOCS_NOW)
    return out["files"].select("id", "sha256", "hashed_at")


@register("hash_errors", O.with_(O.DOCS_BASE) + f"""
SELECT CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS id, id AS file_id, CAST(NULL AS BIGINT) AS dir_id,
  'sha256' AS enricher, CAST(NULL AS VARCHAR) AS rule, 'hashing ' || path || ': unreadable' AS error,
  {_NOW} AS occurred_at
FROM docs_base WHERE {_NEEDS} AND content IS NULL""")
def q_hash_errors(spark, sf):
    t = V.docs_tables(spark, sf)
    return apply_hashes(t, _hash_results(spark, sf), V.DOCS_NOW)["process_errors"]


# ---------------------------------------------------------------- enrichment

_DOCS_MIME_PARTIAL = """docs_mime AS (
  SELECT hash, file_id, TIMESTAMP '2024-03-04 00:00:00' AS processed_at, 'text/plain' AS mime_type
  FROM (SELECT sha256 AS hash, min(id) AS file_id FROM docs_files WHERE NOT missing GROUP BY sha256)
  WHERE file_id % 3 = 0)"""

_DOCS_MIME_CANDS = """mime_cands AS (
  SELECT sha256 AS hash, min(id) AS file_id, CAST(NULL AS TIMESTAMP) AS processed_at
  FROM docs_files WHERE NOT missing AND sha256 IS NOT NULL
    AND sha256 NOT IN (SELECT hash FROM docs_mime) GROUP BY sha256)"""


@register("identify_all_hashes", O.with_(O.DOCS_BASE, O.DOCS_FILES, _DOCS_MIME_PARTIAL, _DOCS_MIME_CANDS) +
          "SELECT * FROM mime_cands")
def q_identify_all_hashes(spark, sf):
    files = V.docs_files(spark, sf)
    return identify_all_hashes(files, V.docs_mime_partial(files))


_TEXT_RE = r"[\x00-\x08\x0E-\x1A\x1C-\x1F\x7F]"


def _sniff_sql(text: str) -> str:
    # documents are text: the binary signatures are checked on the hex prefix
    h = f"substr(hex(encode({text})), 1, 32)"
    return (f"(CASE WHEN {text} IS NULL THEN NULL WHEN octet_length(encode({text})) = 0 THEN 'inode/x-empty' "
            f"WHEN starts_with({h}, 'FFD8FF') THEN 'image/jpeg' "
            f"WHEN starts_with({h}, '89504E470D0A1A0A') THEN 'image/png' "
            f"WHEN starts_with({h}, '474946383761') OR starts_with({h}, '474946383961') THEN 'image/gif' "
            f"WHEN starts_with({h}, '255044462D') THEN 'application/pdf' "
            f"WHEN NOT regexp_matches({text}, '{_TEXT_RE}') THEN 'text/plain' "
            f"ELSE 'application/octet-stream' END)")


@register("sniff_mime", O.with_(O.DOCS_BASE) +
          f"SELECT id, {_sniff_sql('content')} AS mime_type FROM docs_base WHERE content IS NOT NULL")
def q_sniff_mime(spark, sf):
    c = V.docs_content(spark, sf).filter(F.col("content").isNotNull())
    return c.select("id", sniff_mime(F.col("content").cast("binary")).alias("mime_type"))


@register("sniff_signatures", f"""
SELECT doc_id AS id, list_value({", ".join(repr(t) for _, t in V.SIGNATURES)})[doc_id % {len(V.SIGNATURES)} + 1] AS mime_type FROM documents""")
def q_sniff_signatures(spark, sf):
    return V.signed_content(spark, sf).select("id", sniff_mime("content").alias("mime_type"))


@register("valid_mime", O.with_(O.DOCS_BASE) + f"""
SELECT id, CASE WHEN strpos(t, '/') > 0 THEN t END AS mime_type,
  CASE WHEN strpos(t, '/') = 0 THEN 'detecting mime for ' || path || ': ' || t END AS error
FROM (SELECT id, path, regexp_replace(regexp_replace(raw, '^{O._SP}+', ''), '{O._SP}+$', '') AS t
      FROM (SELECT id, path, CASE WHEN content IS NULL THEN 'regular file, no read permission'
                                  ELSE {_sniff_sql('content')} || chr(10) END AS raw FROM docs_base))""")
def q_valid_mime(spark, sf):
    from ..functions import valid_mime
    c = V.docs_content(spark, sf)
    # one detector output line per file: the detected type, or the detector's
    # text for a file it could not read
    raw = F.when(F.col("content").isNull(), F.lit("regular file, no read permission")) \
        .otherwise(F.concat(sniff_mime(F.col("content").cast("binary")), F.lit("\n")))
    v = c.select("id", valid_mime(raw, F.col("path")).alias("v"))
    return v.select("id", F.col("v.mime_type").alias("mime_type"), F.col("v.error").alias("error"))


def _mime_run(spark, sf):
    t = V.docs_tables(spark, sf)
    t["mime"] = V.docs_mime_partial(t["files"])
    return run_enricher(t, MimeEnricher(V.docs_content(spark, sf)), V.DOCS_NOW)


_MIME_RUN = f"""lowest AS (
  SELECT sha256 AS hash, arg_min(id, id) AS fid FROM docs_files WHERE NOT missing AND sha256 IS NOT NULL
  GROUP BY sha256),
mime_res AS (
  SELECT c.hash, l.fid AS file_id, {_sniff_sql('b.content')} AS mime_type,
    CASE WHEN b.content IS NULL THEN 'detecting mime for ' || b.path || ': unreadable' END AS error
  FROM mime_cands c JOIN lowest l USING (hash) JOIN docs_base b ON b.id = l.fid)"""


@register("mime_enrichment", O.with_(O.DOCS_BASE, O.DOCS_FILES, _DOCS_MIME_PARTIAL, _DOCS_MIME_CANDS, _MIME_RUN) +
          f"""SELECT hash, file_id, processed_at, mime_type FROM docs_mime
UNION ALL
SELECT c.hash, c.file_id, {_NOW}, r.mime_type FROM mime_cands c JOIN mime_res r USING (hash)""")
def q_mime_enrichment(spark, sf):
    out, _ = _mime_run(spark, sf)
    return out["mime"]


@register("enrichment_errors", O.with_(O.DOCS_BASE, O.DOCS_FILES, _DOCS_MIME_PARTIAL, _DOCS_MIME_CANDS, _MIME_RUN) +
          f"""SELECT CAST(row_number() OVER (ORDER BY hash) AS BIGINT) AS id, file_id, CAST(NULL AS BIGINT) AS dir_id,
  'mime' AS enricher, CAST(NULL AS VARCHAR) AS rule, error, {_NOW} AS occurred_at
FROM mime_res WHERE error IS NOT NULL""")
def q_enrichment_errors(spark, sf):
    out, _ = _mime_run(spark, sf)
    return out["process_errors"]


@register("work_stats", O.with_(O.DOCS_BASE, O.DOCS_FILES, _DOCS_MIME_PARTIAL, _DOCS_MIME_CANDS, _MIME_RUN) +
          """SELECT (SELECT count(*) FROM mime_cands) AS identified,
  (SELECT count(*) FROM mime_res WHERE error IS NULL) AS processed,
  (SELECT count(*) FROM mime_res WHERE error IS NOT NULL) AS errors""")
def q_work_stats(spark, sf):
    _, stats = _mime_run(spark, sf)
    return stats


_TV = tags_version()
_EXIF_RESET = f"""exif_reset AS (
  SELECT hash, file_id,
    CASE WHEN processed_at IS NOT NULL AND (tags_version IS NULL OR tags_version <> '{_TV}') THEN NULL
         ELSE processed_at END AS processed_at, data, tags_version
  FROM media_exif)"""

_EXIF_CANDS = f"""exif_cands AS (
  SELECT m.hash, min(f.id) AS file_id, CAST(NULL AS TIMESTAMP) AS processed_at
  FROM media_mime m JOIN media_files f ON f.sha256 = m.hash AND NOT f.missing
  WHERE m.mime_type IN {O.MEDIA_TYPES} AND m.hash NOT IN (SELECT hash FROM exif_reset)
  GROUP BY m.hash)"""


@register("stale_policy_reset", O.with_(*O.MEDIA_CORE, _EXIF_RESET) +
          "SELECT hash, processed_at, tags_version FROM exif_reset")
def q_stale_policy_reset(spark, sf):
    return reset_stale(V.media_exif(spark, sf), _TV).select("hash", "processed_at", "tags_version")


@register("identify_by_mime", O.with_(*O.MEDIA_CORE, _EXIF_RESET, _EXIF_CANDS) + "SELECT * FROM exif_cands")
def q_identify_by_mime(spark, sf):
    t = V.media_tables(spark, sf)
    return identify_by_mime(t["files"], t["mime"], reset_stale(t["exif"], _TV))


_PENDING = """pending AS (
  SELECT p.hash, f.id AS file_id, f.store, f.path, '/stores/' || f.store || '/' || f.path AS abs_path
  FROM (SELECT hash FROM exif_reset WHERE processed_at IS NULL UNION ALL SELECT hash FROM exif_cands) p
  JOIN media_files f ON f.id = (SELECT min(f2.id) FROM media_files f2 WHERE f2.sha256 = p.hash AND NOT f2.missing))"""


@register("pending_items", O.with_(*O.MEDIA_CORE, _EXIF_RESET, _EXIF_CANDS, _PENDING) + "SELECT * FROM pending")
def q_pending_items(spark, sf):
    t = V.media_tables(spark, sf)
    table = reset_stale(t["exif"], _TV)
    table = table.unionByName(identify_by_mime(t["files"], t["mime"], table).select(
        "hash", "file_id", "processed_at", F.lit(None).cast("string").alias("data"),
        F.lit(None).cast("string").alias("tags_version")))
    return pending_items(table, t["files"], V.STORE_ROOTS).drop("size")


# extractor output per raw file (see views.media_extractor_output)
_EXTRACTED = """extracted AS (
  SELECT '/stores/raw/' || path AS abs_path, id, size, ck FROM media_base WHERE store = 'raw')"""


@register("exif_enrichment", O.with_(*O.MEDIA_CORE, _EXIF_RESET, _EXIF_CANDS, _PENDING, _EXTRACTED) + f"""
SELECT e.hash, e.file_id,
  CASE WHEN p.hash IS NULL THEN e.processed_at ELSE TIMESTAMP '2002-01-01 00:00:00' END AS processed_at,
  CASE WHEN p.hash IS NULL THEN e.data
       WHEN x.abs_path IS NULL OR x.id % 17 = 0 THEN NULL
       ELSE '{{"EXIF:ExposureTime":' || CASE WHEN x.id % 2 = 0 THEN '1.50' ELSE '1e5' END ||
            ',"EXIF:ISO":' || CAST(x.ck % 800 AS VARCHAR) || ',"EXIF:Make":"Maker' || CAST(x.ck % 5 AS VARCHAR) ||
            '","XMP:Subject":["a", "b"]}}' END AS data,
  CASE WHEN p.hash IS NULL THEN e.tags_version WHEN x.abs_path IS NULL OR x.id % 17 = 0 THEN NULL
       ELSE '{_TV}' END AS tags_version
FROM (SELECT hash, file_id, processed_at, data, tags_version FROM exif_reset
      UNION ALL SELECT hash, file_id, processed_at, NULL, NULL FROM exif_cands) e
LEFT JOIN pending p USING (hash)
LEFT JOIN extracted x ON x.abs_path = p.abs_path""")
def q_exif_enrichment(spark, sf):
    t = V.media_tables(spark, sf)
    extracted = parse_tag_batches(V.media_extractor_output(spark, sf), "value", "batch")
    out, _ = run_enricher(t, ExifEnricher(extracted), V.MEDIA_NOW, stores=V.STORE_ROOTS)
    return out["exif"]


# ------------------------------------------------------------------ organize

_CANDS = f"""cands AS (
  SELECT f.id, f.sha256, f.path, f.size, f.mod_time, e.data
  FROM media_files f JOIN media_mime m ON m.hash = f.sha256 LEFT JOIN media_exif e ON e.hash = f.sha256
  WHERE f.store = 'raw' AND NOT f.missing AND f.sha256 IS NOT NULL AND m.mime_type IN {O.MEDIA_TYPES})"""


@register("organize_candidates", O.with_(*O.MEDIA_CORE, _CANDS) + "SELECT * FROM cands")
def q_organize_candidates(spark, sf):
    t = V.media_tables(spark, sf)
    return organize_candidates(t["files"], t["mime"], t["exif"])


_CAPTURE_ALL = O.capture_ctes("(SELECT id, data, mod_time FROM media_base)", V.MEDIA_ZONE)


@register("capture_times", O.with_(*O.MEDIA_CORE, *_CAPTURE_ALL) + "SELECT id, capture_ts, source FROM capture")
def q_capture_times(spark, sf):
    from ..functions.timestamps import with_capture_time
    b = V.media_base(spark, sf).select("id", "data", "mod_time")
    return with_capture_time(b, "data", "mod_time", V.MEDIA_ZONE).select("id", "capture_ts", "source")


_CAPTURE_C = O.capture_ctes("(SELECT id, data, mod_time FROM cands)", V.MEDIA_ZONE)
_ORG = f"""org AS (
  SELECT c.id AS file_id, c.sha256, c.path, c.size, c.mod_time, p.capture_ts, p.source,
    {O.dst_path('p.capture_ts', 'c.sha256', 'c.path')} AS dst_path,
    'source: ' || p.source AS reason,
    CASE WHEN p.capture_ts IS NULL THEN 'error'
         WHEN EXISTS (SELECT 1 FROM media_files k WHERE k.store = 'clean' AND NOT k.missing AND k.sha256 = c.sha256)
         THEN 'skipped' END AS first_status
  FROM cands c JOIN capture p USING (id)),
org_rank AS (
  SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS rn FROM org WHERE first_status IS NULL),
org_plan AS (
  SELECT file_id, sha256, path, size, mod_time, capture_ts, source, dst_path, reason, first_status AS status
  FROM org WHERE first_status IS NOT NULL
  UNION ALL
  SELECT file_id, sha256, path, size, mod_time, capture_ts, source, dst_path, reason,
    CASE WHEN EXISTS (SELECT 1 FROM media_files k WHERE k.store = 'clean' AND NOT k.missing AND k.path = dst_path)
         THEN 'collided' WHEN rn = 1 THEN 'organized' ELSE 'skipped' END
  FROM org_rank)"""


@register("destination_paths", O.with_(*O.MEDIA_CORE, _CANDS, *_CAPTURE_C) + f"""
SELECT c.id, {O.basename('c.path')} AS name, p.capture_ts,
  {O.dst_path('p.capture_ts', 'c.sha256', 'c.path')} AS dst_path,
  replace(strftime(p.capture_ts, '%Y-%m-%d %H:%M:%S'), ' ', 'T') || 'Z' AS capture_rfc3339
FROM cands c JOIN capture p USING (id)""")
def q_destination_paths(spark, sf):
    from ..functions import destination_path
    from ..functions.timestamps import with_capture_time
    t = V.media_tables(spark, sf)
    c = with_capture_time(organize_candidates(t["files"], t["mime"], t["exif"]), "data", "mod_time", V.MEDIA_ZONE)
    return c.select("id", basename("path").alias("name"), "capture_ts",
                    destination_path("capture_ts", "sha256", "path").alias("dst_path"),
                    rfc3339("capture_ts").alias("capture_rfc3339"))


@register("organize_plan", O.with_(*O.MEDIA_CORE, _CANDS, *_CAPTURE_C, _ORG) + f"""
SELECT *, CASE WHEN status = 'error' THEN '{NO_TIMESTAMP}' END AS error FROM org_plan""")
def q_organize_plan(spark, sf):
    return organize_plan(V.media_tables(spark, sf), V.MEDIA_ZONE)


@register("organize_dry_run", O.with_(*O.MEDIA_CORE, _CANDS, *_CAPTURE_C, _ORG) + f"""
SELECT file_id, sha256, path, size, mod_time, capture_ts, source, dst_path, reason,
  coalesce(first_status, 'organize') AS status,
  CASE WHEN first_status = 'error' THEN '{NO_TIMESTAMP}' END AS error FROM org""")
def q_organize_dry_run(spark, sf):
    return organize_plan(V.media_tables(spark, sf), V.MEDIA_ZONE, dry_run=True)


@register("organize_stats", O.with_(*O.MEDIA_CORE, _CANDS, *_CAPTURE_C, _ORG) + """
SELECT count(*) AS considered, count(*) FILTER (WHERE status = 'organized') AS organized,
  count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'collided') AS collided,
  count(*) FILTER (WHERE status = 'error') AS errors FROM org_plan""")
def q_organize_stats(spark, sf):
    return organize_stats(organize_plan(V.media_tables(spark, sf), V.MEDIA_ZONE))


def _organize_applied(spark, sf):
    t = V.media_tables(spark, sf)
    plan = organize_plan(t, V.MEDIA_ZONE).checkpoint()  # the mover and the report read it
    # mover report: every 19th copy fails; every 7th original cannot be removed
    outcomes = plan.filter(F.col("status") == "organized").select(
        "file_id", F.when(F.col("file_id") % 19 == 0, F.lit("disk full")).alias("error"),
        F.when(F.col("file_id") % 7 == 0, F.lit("permission denied")).alias("remove_error"))
    return apply_organize(t, plan, outcomes, remove_originals=True, now=V.MEDIA_NOW)


_ORG_APPLIED = """org_ok AS (
  SELECT *, (SELECT max(id) FROM media_files) + row_number() OVER (ORDER BY path) AS clean_id
  FROM org_plan WHERE status = 'organized' AND file_id % 19 <> 0)"""
_MNOW = "TIMESTAMP '2002-01-01 00:00:00'"


@register("apply_organize_files", O.with_(*O.MEDIA_CORE, _CANDS, *_CAPTURE_C, _ORG, _ORG_APPLIED) + f"""
SELECT * FROM media_files WHERE id NOT IN (SELECT file_id FROM org_ok WHERE file_id % 7 <> 0)
UNION ALL
SELECT clean_id, 'clean', dst_path, size, mod_time, {_MNOW}, {_MNOW}, false, sha256, {_MNOW} FROM org_ok""")
def q_apply_organize_files(spark, sf):
    return _organize_applied(spark, sf)["files"]


@register("apply_organize_log", O.with_(*O.MEDIA_CORE, _CANDS, *_CAPTURE_C, _ORG, _ORG_APPLIED) + f"""
SELECT 'op' AS kind, file_id AS src_id, clean_id AS file_id, 'raw' AS src_store, path AS src_path,
  'clean' AS dst_store, dst_path, 'organize' AS rule, reason AS message
FROM org_ok
UNION ALL
SELECT 'err', file_id, file_id, NULL, path, NULL, NULL, 'organize',
  CASE WHEN status = 'error' THEN '{NO_TIMESTAMP}' ELSE 'copy: disk full' END
FROM org_plan WHERE status = 'error' OR (status = 'organized' AND file_id % 19 = 0)
UNION ALL
SELECT 'err', file_id, file_id, NULL, path, NULL, NULL, 'organize', 'remove raw original: permission denied'
FROM org_ok WHERE file_id % 7 = 0""")
def q_apply_organize_log(spark, sf):
    out = _organize_applied(spark, sf)
    ops = out["operations"].select(
        F.lit("op").alias("kind"), F.lit(None).cast("long").alias("src_id"), "file_id", "src_store", "src_path",
        "dst_store", "dst_path", "rule", F.col("reason").alias("message"))
    # src_id of an operation is the raw file it came from: recover it by source path
    raw = V.media_files(spark, sf).select(F.col("id").alias("raw_id"), F.col("path").alias("src_path"))
    ops = ops.join(raw, "src_path", "left").withColumn("src_id", F.col("raw_id")).drop("raw_id")
    errs = out["process_errors"].join(raw.withColumnRenamed("src_path", "path"),
                                      F.col("file_id") == F.col("raw_id"), "left").select(
        F.lit("err").alias("kind"), F.col("file_id").alias("src_id"), "file_id",
        F.lit(None).cast("string").alias("src_store"), F.col("path").alias("src_path"),
        F.lit(None).cast("string").alias("dst_store"), F.lit(None).cast("string").alias("dst_path"),
        "rule", F.col("error").alias("message"))
    return ops.select(*errs.columns).unionByName(errs)


_CLASH = f"""clash_rows AS ({V.CLASH_SQL.format(
    start="date_trunc('year', o_orderdate::TIMESTAMP)::TIMESTAMP", year="strftime(o_orderdate, '%Y/01/%Y0101T000000Z')",
    sha8="substr(sha256((o_custkey // 3)::VARCHAR), 1, 8)", rest="substr(sha256(o_custkey::VARCHAR), 9)",
    other="sha256('clean' || o_orderkey)")} FROM orders),
clash_files AS (
  SELECT id, store, path, size, mod_time, {_MNOW} AS found_at, {_MNOW} AS reconciled_at, missing, sha256, {_MNOW} AS hashed_at
  FROM clash_rows QUALIFY store = 'raw' OR row_number() OVER (PARTITION BY store, path ORDER BY id) = 1),
clash_cands AS (
  SELECT *, 'media/' || strftime(mod_time, '%Y/%m/%Y%m%dT%H%M%SZ') || '-' || substr(sha256, 1, 8) || '-img' || (id - 1) % 2 || '.jpg' AS dst_path,
    row_number() OVER (PARTITION BY substr(sha256, 1, 8) ORDER BY path) AS step
  FROM clash_files WHERE store = 'raw' AND mod_time IS NOT NULL),
-- one by one, in path order, with what was organised and taken so far
clash_walk AS (
  SELECT substr(c.sha256, 1, 8) AS part, 0::BIGINT AS step, 0::BIGINT AS id, '' AS status, []::VARCHAR[] AS done,
    coalesce(list(k.path) FILTER (k.path IS NOT NULL), []) AS taken
  FROM clash_cands c LEFT JOIN clash_files k ON k.store = 'clean' AND NOT k.missing AND k.path = c.dst_path GROUP BY 1
  UNION ALL
  SELECT part, step, id, status, CASE WHEN status = 'organized' THEN list_append(done, sha256) ELSE done END,
    CASE WHEN status = 'organized' THEN list_append(taken, dst_path) ELSE taken END
  FROM (SELECT w.part, c.step, c.id, c.sha256, c.dst_path, w.done, w.taken,
          CASE WHEN list_contains(w.done, c.sha256) THEN 'skipped' WHEN list_contains(w.taken, c.dst_path) THEN 'collided' ELSE 'organized' END AS status
        FROM clash_walk w JOIN clash_cands c ON substr(c.sha256, 1, 8) = w.part AND c.step = w.step + 1)),
clash_plan AS (
  SELECT f.id AS file_id, f.sha256, f.path, f.size, f.mod_time, c.dst_path, coalesce(w.status, 'error') AS status
  FROM clash_files f LEFT JOIN clash_cands c USING (id) LEFT JOIN clash_walk w ON w.id = f.id AND w.step > 0 WHERE f.store = 'raw')"""

@register("organize_clashes", "WITH RECURSIVE " + _CLASH + f"""
SELECT file_id, path, dst_path, status, CASE WHEN status = 'error' THEN '{NO_TIMESTAMP}' END AS error FROM clash_plan""")
def q_organize_clashes(spark, sf):
    return organize_plan(V.clash_tables(spark, sf), "UTC").select("file_id", "path", "dst_path", "status", "error")


@register("organize_clash_stats", "WITH RECURSIVE " + _CLASH + """
SELECT count(*) AS considered, count(*) FILTER (WHERE status = 'organized') AS organized, count(*) FILTER (WHERE status = 'skipped') AS skipped,
  count(*) FILTER (WHERE status = 'collided') AS collided, count(*) FILTER (WHERE status = 'error') AS errors FROM clash_plan""")
def q_organize_clash_stats(spark, sf):
    return organize_stats(organize_plan(V.clash_tables(spark, sf), "UTC"))


@register("organize_revived", "WITH RECURSIVE " + _CLASH + f""",
clash_ok AS (SELECT p.*, k.id AS old_id FROM clash_plan p LEFT JOIN clash_files k ON k.store = 'clean' AND k.path = p.dst_path
             WHERE status = 'organized' AND file_id % 19 <> 0),
clash_new AS (SELECT *, coalesce(old_id, (SELECT max(id) FROM clash_files) + row_number() OVER (PARTITION BY old_id IS NULL ORDER BY path)) AS clean_id FROM clash_ok)
SELECT id, store, path, size, mod_time, found_at, missing, sha256 FROM clash_files
WHERE id NOT IN (SELECT file_id FROM clash_ok WHERE file_id % 7 <> 0) AND id NOT IN (SELECT old_id FROM clash_ok WHERE old_id IS NOT NULL)
UNION ALL
SELECT clean_id, 'clean', dst_path, size, mod_time, {_MNOW}, false, sha256 FROM clash_new""")
def q_organize_revived(spark, sf):
    t = V.clash_tables(spark, sf)
    plan = organize_plan(t, "UTC").checkpoint()  # the mover and the report read it
    outcomes = plan.filter(F.col("status") == "organized").select(
        "file_id", F.when(F.col("file_id") % 19 == 0, F.lit("disk full")).alias("error"),
        F.when(F.col("file_id") % 7 == 0, F.lit("permission denied")).alias("remove_error"))
    out = apply_organize(t, plan, outcomes, remove_originals=True, now=V.MEDIA_NOW)
    return out["files"].select("id", "store", "path", "size", "mod_time", "found_at", "missing", "sha256")


# -------------------------------------------------------------- plan outcomes

def _outcomes_applied(spark, sf):
    t = V.docs_tables(spark, sf)
    ops = build_plan(t)
    outcomes = ops.select("op_id", F.when(F.col("op_id") % 17 == 0, F.lit("rename: permission denied"))
                          .alias("error"))
    return t, ops, outcomes


@register("apply_outcomes_files", O.with_(*O.DOCS_CORE, O.EXEC_OPS, O.OUTCOMES, O.RESOLVED) + """
SELECT f.id, coalesce(r.dst_store, f.store) AS store, coalesce(r.dst_path, f.path) AS path, f.size, f.mod_time,
  f.found_at, f.reconciled_at, f.missing, f.sha256, f.hashed_at
FROM docs_files f LEFT JOIN (SELECT * FROM resolved WHERE err IS NULL AND kind <> 'RMDIR') r ON r.file_id = f.id""")
def q_apply_outcomes_files(spark, sf):
    t, ops, outcomes = _outcomes_applied(spark, sf)
    out, _ = apply_outcomes(t, ops, outcomes, V.DOCS_NOW)
    return out["files"]


@register("apply_outcomes_dirs", O.with_(*O.DOCS_CORE, O.EXEC_OPS, O.OUTCOMES, O.RESOLVED) + """
SELECT * FROM docs_dirs WHERE id NOT IN (SELECT dir_id FROM resolved WHERE err IS NULL AND kind = 'RMDIR')""")
def q_apply_outcomes_dirs(spark, sf):
    t, ops, outcomes = _outcomes_applied(spark, sf)
    out, _ = apply_outcomes(t, ops, outcomes, V.DOCS_NOW)
    return out["directories"]


_ORDER = "exec_rank, exec_depth DESC, rule_priority, plan_key"


@register("apply_outcomes_log", O.with_(*O.DOCS_CORE, O.EXEC_OPS, O.OUTCOMES, O.RESOLVED) + f"""
SELECT CAST(row_number() OVER (ORDER BY {_ORDER}) AS BIGINT) AS id, file_id, dir_id, src_store, src_path, dst_store,
  dst_path, rule, reason, {_NOW} AS executed_at
FROM resolved WHERE err IS NULL""")
def q_apply_outcomes_log(spark, sf):
    t, ops, outcomes = _outcomes_applied(spark, sf)
    out, _ = apply_outcomes(t, ops, outcomes, V.DOCS_NOW)
    return out["operations"]


@register("apply_outcomes_errors", O.with_(*O.DOCS_CORE, O.EXEC_OPS, O.OUTCOMES, O.RESOLVED) + f"""
SELECT CAST(row_number() OVER (ORDER BY {_ORDER}) AS BIGINT) AS id, file_id, dir_id,
  CAST(NULL AS VARCHAR) AS enricher, rule, err AS error, {_NOW} AS occurred_at
FROM resolved WHERE err IS NOT NULL""")
def q_apply_outcomes_errors(spark, sf):
    t, ops, outcomes = _outcomes_applied(spark, sf)
    out, _ = apply_outcomes(t, ops, outcomes, V.DOCS_NOW)
    return out["process_errors"]


@register("outcome_conflicts", O.with_(*O.DOCS_CORE, O.OUTCOMES) + """,
catalogued AS (SELECT store, path FROM docs_files UNION ALL SELECT 'trash', path FROM docs_files WHERE (id - 1) % 46 = 0),
moves AS (SELECT p.op_id, p.kind, p.file_id, p.src_path, p.dst_store, o.error AS failed,
    CASE WHEN p.rule = 'dedup' AND p.file_id % 3 = 0 THEN 'duplicates/' || p.file_id % 7 ELSE p.dst_path END AS dst_path
  FROM plan_ops p JOIN outcomes o USING (op_id)),
facts AS (SELECT m.*, EXISTS (SELECT 1 FROM catalogued c WHERE c.store = m.dst_store AND c.path = m.dst_path) AS held,
    count(*) FILTER (failed IS NULL) OVER (PARTITION BY dst_store, dst_path) AS claims FROM moves m)
SELECT op_id, kind, file_id, src_path, dst_store, dst_path, coalesce(failed, CASE WHEN kind <> 'RMDIR' AND (held OR claims > 1)
  THEN 'destination already in catalogue: ' || dst_store || '/' || dst_path END) AS error FROM facts""")
def q_outcome_conflicts(spark, sf):
    t, ops, outcomes = _outcomes_applied(spark, sf)
    # copies of some paths lie in the trash already, and some duplicates are sent to one place
    copies = t["files"].filter((F.col("id") - 1) % 46 == 0).withColumn("store", F.lit("trash")).withColumn("id", F.col("id") + 1_000_000_000)
    shared = (F.col("rule") == "dedup") & (F.col("file_id") % 3 == 0)
    ops = ops.withColumn("dst_path", F.when(shared, F.concat(F.lit("duplicates/"), F.col("file_id") % 7)).otherwise(F.col("dst_path")))
    res = resolve_outcomes(t["files"].unionByName(copies), ops, outcomes)
    return res.select("op_id", "kind", "file_id", "src_path", "dst_store", "dst_path", "error")


@register("walked_files", O.with_(O.DOCS_BASE) + f""",
held AS (SELECT store, path, content, sha256 FROM docs_base WHERE content IS NOT NULL AND path IS NOT NULL)
SELECT store, path, false AS is_dir, octet_length(encode(content))::BIGINT AS size, sha256(content) AS sha256, {_sniff_sql('content')} AS mime_type FROM held
UNION ALL
SELECT DISTINCT store, CASE WHEN i = 0 THEN '.' ELSE array_to_string(string_split(path, '/')[1:i], '/') END, true, NULL, NULL, NULL
FROM (SELECT store, path, unnest(range(len(string_split(path, '/')))) AS i FROM held)""")
def q_walked_files(spark, sf):
    """The documents written as files, then listed, hashed and sniffed where they lie."""
    import uuid
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    stores = V.write_tree(spark, sf, root)
    listing = list_stores(spark, stores).withColumn("id", F.xxhash64("store", "path"))
    items = spread_by_bytes(resolve_path(listing.filter(~F.col("is_dir")), stores))
    hashes = hash_files(items).select("id", "sha256")
    types = read_heads(items).select("id", sniff_mime("head", F.col("is_text")).alias("mime_type"))
    out = listing.join(hashes, "id", "left").join(types, "id", "left")
    return out.select("store", "path", "is_dir", "size", "sha256", "mime_type")


@register("execution_stats", O.with_(*O.DOCS_CORE, O.EXEC_OPS, O.OUTCOMES, O.RESOLVED) + """
SELECT count(*) FILTER (WHERE err IS NULL) AS succeeded, count(*) FILTER (WHERE err IS NOT NULL) AS failed
FROM resolved""")
def q_execution_stats(spark, sf):
    t, ops, outcomes = _outcomes_applied(spark, sf)
    return execution_stats(resolve_outcomes(t["files"], ops, outcomes))


@register("catalog_stats", O.with_(*O.DOCS_CORE, O.EXEC_OPS, O.OUTCOMES, O.RESOLVED) + """
SELECT (SELECT count(*) FROM docs_files WHERE NOT missing) AS files,
  (SELECT count(*) FROM docs_files WHERE missing) AS missing,
  (SELECT count(*) FROM docs_dirs) - (SELECT count(*) FROM resolved WHERE err IS NULL AND kind = 'RMDIR')
    AS directories,
  (SELECT count(*) FROM resolved WHERE err IS NULL) AS operations,
  (SELECT count(*) FROM resolved WHERE err IS NOT NULL) AS errors""")
def q_catalog_stats(spark, sf):
    t, ops, outcomes = _outcomes_applied(spark, sf)
    out, _ = apply_outcomes(t, ops, outcomes, V.DOCS_NOW)
    return catalog_stats(out)


@register("progress_counts", O.with_(O.DOCS_BASE, O.DOCS_FILES, _DOCS_MIME_PARTIAL) + f"""
SELECT (SELECT count(*) FROM docs_files WHERE {_NEEDS}) AS pending_hash,
  (SELECT count(*) FROM docs_mime WHERE processed_at IS NULL) AS mime_pending,
  (SELECT count(*) FROM docs_mime WHERE processed_at IS NOT NULL) AS mime_complete,
  (SELECT count(DISTINCT sha256) FROM docs_files WHERE sha256 IS NOT NULL AND NOT missing
     AND sha256 NOT IN (SELECT hash FROM docs_mime)) AS unidentified,
  (SELECT count(*) FROM docs_files WHERE NOT missing AND reconciled_at < {_STALE_CUTOFF}) AS stale_files""")
def q_progress_counts(spark, sf):
    from ..operators.catalog import _ts, staleness_cutoff
    files = V.docs_files(spark, sf)
    mime = V.docs_mime_partial(files)
    cutoff = _ts(staleness_cutoff(V.DOCS_NOW))
    unident = files.filter(F.col("sha256").isNotNull() & ~F.col("missing")).select("sha256").join(
        mime.select(F.col("hash").alias("sha256")), "sha256", "left_anti")
    parts = (needs_hash(files).select(F.lit(1).alias("ph"))
             .unionByName(mime.select(F.when(F.col("processed_at").isNull(), 1).alias("mp"),
                                      F.when(F.col("processed_at").isNotNull(), 1).alias("mc")),
                          allowMissingColumns=True)
             .unionByName(unident.select(F.col("sha256").alias("un")), allowMissingColumns=True)
             .unionByName(files.filter(~F.col("missing") & (F.col("reconciled_at") < cutoff))
                          .select(F.lit(1).alias("st")), allowMissingColumns=True))
    return parts.agg(F.count("ph").alias("pending_hash"), F.count("mp").alias("mime_pending"),
                     F.count("mc").alias("mime_complete"), F.countDistinct("un").alias("unidentified"),
                     F.count("st").alias("stale_files"))


@register("ops_per_rule", O.with_(*O.DOCS_CORE) + "SELECT rule, count(*) AS n FROM plan_ops GROUP BY rule")
def q_ops_per_rule(spark, sf):
    return build_plan(V.docs_tables(spark, sf)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@register("stored_catalogue", O.with_(O.DOCS_BASE, O.DOCS_FILES) + f"""
SELECT id, store, path, size, missing OR reconciled_at < {_STALE_CUTOFF} AS missing, sha256 FROM docs_files""")
def q_stored_catalogue(spark, sf):
    """Two versions written and read back: the derived catalogue, then the same with
    stale files marked (only ``files`` is written again)."""
    root = f"{ensure_checkpoint_dir(spark)}/catalogue-{uuid.uuid4().hex}"
    write_tables(V.docs_tables(spark, sf), root)
    base = read_tables(spark, root)
    write_tables({**base, "files": mark_missing(base["files"], V.DOCS_NOW)}, root, base=base)
    return read_tables(spark, root)["files"].select("id", "store", "path", "size", "missing", "sha256")


# ------------------------------------------------------------------ SQL surface

@register("human_sizes", O.with_(O.DOCS_BASE, O.DOCS_FILES, O.DOCS_DIRS) + f"""
SELECT id, total_size, {O.human('total_size', 1000, O.SI)} AS human_bytes,
  {O.human('total_size', 1024, O.IEC)} AS human_ibytes FROM docs_dirs""")
def q_human_sizes(spark, sf):
    d = V.docs_tables(spark, sf)["directories"]
    return d.select("id", "total_size", human_bytes("total_size").alias("human_bytes"),
                    human_ibytes("total_size").alias("human_ibytes"))


_TOP_SQL = """SELECT store, path, file_count, total_size, human_ibytes(total_size) AS size
FROM directories ORDER BY total_size DESC, store, path LIMIT 30"""


def _media_dirs(spark, sf):
    return directory_rollup(V.listing_from_files(V.media_files(spark, sf)))


@register("top_directories", O.with_(*O.MEDIA_CORE, O.dirs_of("media_files", "media_dirs")) + f"""
SELECT store, path, file_count, total_size, {O.human('total_size', 1024, O.IEC)} AS size
FROM media_dirs ORDER BY total_size DESC, store, path LIMIT 30""")
def q_top_directories(spark, sf):
    return query(spark, {"directories": _media_dirs(spark, sf)}, _TOP_SQL)


@register("query_tsv", O.with_(*O.MEDIA_CORE, O.dirs_of("media_files", "media_dirs")) + f"""
SELECT 0 AS ord, 'store' || chr(9) || 'path' || chr(9) || 'file_count' || chr(9) || 'total_size' || chr(9) || 'size'
  AS line
UNION ALL
SELECT 1, concat_ws(chr(9), store, path, CAST(file_count AS VARCHAR), CAST(total_size AS VARCHAR),
  {O.human('total_size', 1024, O.IEC)})
FROM media_dirs""")
def q_query_tsv(spark, sf):
    text = "SELECT store, path, file_count, total_size, human_ibytes(total_size) AS size FROM directories"
    return tsv_lines(query(spark, {"directories": _media_dirs(spark, sf)}, text), header=True)


_EDGES = ["", " ", "\t", "\u00a0", "\u3000", "\n"]
_EDGED_SQL = (f"(list_value({', '.join('chr(' + str(ord(e)) + ')' if e else repr('') for e in _EDGES)})[doc_id % {len(_EDGES)} + 1] || source "
              f"|| list_value({', '.join('chr(' + str(ord(e)) + ')' if e else repr('') for e in _EDGES)})[doc_id % {len(_EDGES)} + 1])")


def _csv_sql(x: str) -> str:
    v = f"coalesce(CAST({x} AS VARCHAR), '')"
    # white space that starts a field, by code point
    needs = (f"({v} <> '' AND (regexp_matches({v}, '[,\"\\r\\n]') OR unicode({v}) IN ({', '.join(map(str, UNICODE_SPACES))}) "
             f"OR {v} = '\\.'))")
    return f"(CASE WHEN {needs} THEN '\"' || replace({v}, '\"', '\"\"') || '\"' ELSE {v} END)"


@register("query_csv", f"""
SELECT 0 AS ord, 'doc_id,lang,source,text' AS line
UNION ALL
SELECT 1, {_csv_sql('doc_id')} || ',' || {_csv_sql('lang')} || ',' || {_csv_sql(_EDGED_SQL)} || ',' || {_csv_sql('text')}
FROM documents""")
def q_query_csv(spark, sf):
    # sources with white space of several kinds before and behind them
    edge = F.element_at(F.array(*[F.lit(x) for x in _EDGES]), (F.pmod("doc_id", F.lit(len(_EDGES))) + 1).cast("int"))
    source = F.concat(edge, F.col("source"), edge).alias("source")
    return csv_lines(V.table(spark, sf, "documents").select("doc_id", "lang", source, "text"), header=True)


@register("align_schema", O.with_(*O.MEDIA_CORE) + """
SELECT hash, file_id, processed_at, data, CAST(NULL AS BIGINT) AS rating FROM media_exif""")
def q_align_schema(spark, sf):
    exif = V.media_exif(spark, sf).withColumn("legacy_col", F.lit("x"))
    return align_schema(exif, S.ENRICHER_BASE, [("data", "TEXT"), ("rating", "INTEGER")])


@register("sanitized_names", O.with_(O.DOCS_BASE) + f"""
SELECT id, regexp_extract({O.basename('path')}, '^(?s)(.+?)(\\.[^.]*)?$', 1) AS base,
  regexp_extract({O.basename('path')}, '^(?s)(.+?)(\\.[^.]*)?$', 2) AS ext,
  regexp_replace(regexp_replace(regexp_replace(' ' || lang || '/' || source || chr(1) || ' ',
    '^{O._SP}+', ''), '{O._SP}+$', ''), '[/\\\\\\x00-\\x1F\\x7F]', '_', 'g') AS sanitized
FROM docs_base""")
def q_sanitized_names(spark, sf):
    b = V.docs_base(spark, sf)
    parts = filename_parts("path")
    raw = F.concat(F.lit(" "), F.col("lang"), F.lit("/"), F.col("source"), F.lit("\x01 "))
    return b.select("id", parts["base"].alias("base"), parts["ext"].alias("ext"),
                    sanitize_basename(raw).alias("sanitized"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


__all__ = ["queries", "oracle_sql", "QUERIES", "ORACLE"]
