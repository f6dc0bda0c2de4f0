"""DuckDB SQL for the correctness oracle.

Plain SQL over the driver's views (``documents``, ``orders``, ``pages``),
written independently of the Spark code: the same derived catalogues, then
each operator stated the obvious way (windows, correlated filters), which is
fine for a checker that runs at small scale.
"""

from __future__ import annotations

from ..constants import (CAPTURE_TAG_PRIORITY, EXCLUDED_TAG_GROUPS, JUNK_DIR_NAMES, JUNK_FILE_NAMES,
                         MEDIA_MIME_TYPES, OFFSET_COMPANION_TAGS, UNICODE_SPACE_CLASS)
from ..functions.tags import tags_version


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(vals) -> str:
    return "(" + ", ".join(q(v) for v in vals) + ")"


def dirname(p: str) -> str:
    return f"(CASE WHEN strpos({p}, '/') > 0 THEN regexp_replace({p}, '/[^/]*$', '') ELSE '.' END)"


def basename(p: str) -> str:
    return f"(string_split({p}, '/')[-1])"


def depth(p: str) -> str:
    return f"(CASE WHEN {p} IN ('.', '') THEN 0 ELSE len(string_split({p}, '/')) END)"


def ancestors(d: str) -> str:
    return (f"(CASE WHEN {d} IN ('.', '') THEN ['.'] ELSE list_transform(range(0, len(string_split({d}, '/')) + 1), "
            f"lambda i: CASE WHEN i = 0 THEN '.' ELSE array_to_string(string_split({d}, '/')[1:i], '/') END) END)")


def junk_component(d: str) -> str:
    return (f"(CASE WHEN {d} IN ('.', '') THEN NULL ELSE 'junk directory: ' || "
            f"list_filter(string_split({d}, '/'), lambda c: c IN {lst(JUNK_DIR_NAMES)})[1] END)")


def junk_file_reason(p: str) -> str:
    b = basename(p)
    return (f"(CASE WHEN {b} IN {lst(JUNK_FILE_NAMES)} THEN 'junk file: ' || {b} "
            f"WHEN starts_with({b}, '._') THEN 'macOS resource fork' ELSE {junk_component(dirname(p))} END)")


def human(n: str, base: int, units: tuple[str, ...]) -> str:
    e = f"floor(ln(CAST({n} AS DOUBLE)) / ln({base}.0))"
    val = f"(floor(CAST({n} AS DOUBLE) / pow({base}.0, {e}) * 10 + 0.5) / 10)"
    unit = f"([{', '.join(q(u) for u in units)}][CAST({e} AS INTEGER) + 1])"
    return (f"(CASE WHEN {n} IS NULL THEN NULL WHEN {n} < 10 THEN CAST({n} AS VARCHAR) || ' B' "
            f"WHEN {val} < 10 THEN printf('%.1f', {val}) || ' ' || {unit} "
            f"ELSE CAST(CAST(round_even({val}, 0) AS BIGINT) AS VARCHAR) || ' ' || {unit} END)")


SI = ("B", "kB", "MB", "GB", "TB", "PB", "EB")
IEC = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")

# ------------------------------------------------------------------ documents

DOCS_BASE = """docs_base AS (
  SELECT doc_id + 1 AS id,
    CASE WHEN doc_id % 10 = 9 THEN 'clean' ELSE 'raw' END AS store,
    CASE WHEN doc_id % 23 = 0 THEN concat(source, '/', lang, '/d', doc_id, '/.DS_Store')
         WHEN doc_id % 29 = 0 THEN concat(source, '/@eaDir/d', doc_id, '.txt')
         WHEN doc_id % 31 = 0 THEN concat(source, '/', lang, '/._d', doc_id, '.txt')
         ELSE concat(source, '/', lang, '/d', doc_id, '.txt') END AS path,
    CAST(octet_length(encode(text)) AS BIGINT) AS size,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS mod_time,
    TIMESTAMP '2024-01-01 00:00:00' AS found_at,
    TIMESTAMP '2024-03-02 00:00:00' + to_hours(CAST(doc_id % 97 AS INTEGER) - 48) AS reconciled_at,
    doc_id % 37 = 0 AS missing,
    sha256(text) AS sha256,
    CASE doc_id % 7 WHEN 0 THEN CAST(NULL AS TIMESTAMP)
         WHEN 1 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id - 1)
         WHEN 2 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id)
         ELSE TIMESTAMP '2024-01-01 00:00:00' + to_hours(1) + to_seconds(doc_id) END AS hashed_at,
    CASE WHEN doc_id % 41 = 0 THEN NULL ELSE text END AS content,
    lang, source
  FROM documents)"""

DOCS_FILES = """docs_files AS (
  SELECT id, store, path, size, mod_time, found_at, reconciled_at, missing, sha256, hashed_at FROM docs_base)"""


def dirs_of(files: str, name: str) -> str:
    """rollup + visited directories + dense ids, for a files CTE."""
    return f"""{name}_visit AS (
  SELECT DISTINCT store, path FROM (SELECT store, unnest({ancestors(dirname('path'))}) AS path FROM {files})),
{name}_pd AS (
  SELECT store, {dirname('path')} AS dir, count(*) AS n, sum(size) AS bytes
  FROM {files} WHERE NOT missing GROUP BY ALL),
{name}_cred AS (SELECT store, unnest({ancestors('dir')}) AS path, n, bytes FROM {name}_pd),
{name}_roll AS (
  SELECT store, path, CAST(sum(n) AS BIGINT) AS file_count, CAST(sum(bytes) AS BIGINT) AS total_size
  FROM (SELECT store, path, n, bytes FROM {name}_cred UNION ALL SELECT store, path, 0, 0 FROM {name}_visit)
  GROUP BY ALL),
{name} AS (
  SELECT CAST(row_number() OVER (ORDER BY store, path) AS BIGINT) AS id, store, path, file_count, total_size,
         true AS listed
  FROM {name}_roll)"""


DOCS_DIRS = dirs_of("docs_files", "docs_dirs")

JUNK_FILE_OPS = f"""junk_file_ops AS (
  SELECT 2 * id AS op_id, 'TRASH' AS kind, id AS file_id, CAST(NULL AS BIGINT) AS dir_id,
    'raw' AS src_store, path AS src_path, 'trash' AS dst_store, path AS dst_path, 'junk' AS rule,
    reason, 0 AS rule_priority, '0' || path AS plan_key
  FROM (SELECT id, path, {junk_file_reason('path')} AS reason FROM docs_files WHERE store = 'raw' AND NOT missing)
  WHERE reason IS NOT NULL)"""

JUNK_DIR_OPS = f"""junk_dir_ops AS (
  SELECT 2 * id + 1 AS op_id, 'RMDIR' AS kind, CAST(NULL AS BIGINT) AS file_id, id AS dir_id,
    store AS src_store, path AS src_path, CAST(NULL AS VARCHAR) AS dst_store, CAST(NULL AS VARCHAR) AS dst_path,
    'junk' AS rule, reason, 0 AS rule_priority, '1' || store || '/' || path AS plan_key
  FROM (SELECT id, store, path,
          coalesce(CASE WHEN store = 'raw' THEN {junk_component('path')} END,
                   CASE WHEN file_count = 0 THEN 'empty directory' END) AS reason
        FROM docs_dirs WHERE path NOT IN ('.', ''))
  WHERE reason IS NOT NULL)"""

DEDUP_OPS = """dedup_ops AS (
  SELECT 2 * id AS op_id, 'TRASH' AS kind, id AS file_id, CAST(NULL AS BIGINT) AS dir_id,
    'raw' AS src_store, path AS src_path, 'trash' AS dst_store, path AS dst_path, 'dedup' AS rule,
    'duplicate of ' || substr(sha256, 1, 12) AS reason, 1 AS rule_priority,
    sha256 || lpad(CAST(length(path) AS VARCHAR), 10, '0') || path AS plan_key
  FROM (SELECT id, path, sha256, row_number() OVER (PARTITION BY sha256 ORDER BY length(path), path) AS rn
        FROM docs_files
        WHERE store = 'raw' AND NOT missing AND sha256 IS NOT NULL
          AND id NOT IN (SELECT file_id FROM junk_file_ops))
  WHERE rn > 1)"""

PLAN_OPS = """plan_ops AS (
  SELECT * FROM junk_file_ops UNION ALL SELECT * FROM junk_dir_ops UNION ALL SELECT * FROM dedup_ops)"""

EXEC_OPS = f"""exec_ops AS (
  SELECT *, CASE WHEN kind = 'RMDIR' THEN 1 ELSE 0 END AS exec_rank,
         CASE WHEN kind = 'RMDIR' THEN {depth('src_path')} ELSE 0 END AS exec_depth
  FROM plan_ops)"""

# outcomes reported by the mover: every 17th op failed; a conflicting move is refused
OUTCOMES = """outcomes AS (
  SELECT op_id, CASE WHEN op_id % 17 = 0 THEN 'rename: permission denied' END AS error FROM plan_ops)"""

RESOLVED = """resolved AS (
  SELECT e.*, coalesce(o.error, CASE WHEN e.kind <> 'RMDIR' AND o.error IS NULL AND (
        EXISTS (SELECT 1 FROM docs_files f WHERE f.store = e.dst_store AND f.path = e.dst_path)
        OR (SELECT count(*) FROM exec_ops e2 JOIN outcomes o2 USING (op_id)
            WHERE e2.kind <> 'RMDIR' AND o2.error IS NULL AND e2.dst_store = e.dst_store
              AND e2.dst_path = e.dst_path) > 1)
      THEN 'destination already in catalogue: ' || e.dst_store || '/' || e.dst_path END) AS err
  FROM exec_ops e JOIN outcomes o USING (op_id))"""

DOCS_CORE = [DOCS_BASE, DOCS_FILES, DOCS_DIRS, JUNK_FILE_OPS, JUNK_DIR_OPS, DEDUP_OPS, PLAN_OPS]


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ------------------------------------------------------------------- orders

_DAY = "replace(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '-', ':')"
MEDIA_DATA = f"""CASE
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

MEDIA_BASE = f"""media_base AS (
  SELECT o_orderkey + 1 AS id,
    CASE WHEN o_orderkey % 53 = 0 THEN 'clean' ELSE 'raw' END AS store,
    concat('y', year(o_orderdate), '/c', o_custkey % 97, '/o', o_orderkey, '.JPG') AS path,
    CAST(floor(o_totalprice) AS BIGINT) AS size,
    o_orderdate AS mod_time, o_orderdate AS found_at, o_orderdate AS reconciled_at,
    false AS missing, sha256(CAST(o_custkey AS VARCHAR)) AS sha256,
    o_orderdate + to_hours(1) AS hashed_at, o_custkey AS ck,
    {MEDIA_DATA} AS data
  FROM orders)"""

MEDIA_FILES = """media_files AS (
  SELECT id, store, path, size, mod_time, found_at, reconciled_at, missing, sha256, hashed_at FROM media_base)"""

MEDIA_MIME = """media_mime AS (
  SELECT hash, file_id,
    CASE WHEN ck % 9 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE TIMESTAMP '2001-09-01 00:00:00' END AS processed_at,
    CASE WHEN ck % 9 = 0 THEN NULL ELSE CASE ck % 10 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'video/mp4'
      WHEN 2 THEN 'image/png' WHEN 3 THEN 'application/pdf' ELSE 'image/jpeg' END END AS mime_type
  FROM (SELECT sha256 AS hash, min(id) AS file_id, min(ck) AS ck FROM media_base GROUP BY sha256))"""

MEDIA_EXIF = f"""media_exif AS (
  SELECT hash, file_id,
    CASE WHEN ck % 8 = 5 THEN CAST(NULL AS TIMESTAMP) ELSE TIMESTAMP '2001-09-02 00:00:00' END AS processed_at,
    data,
    CASE ck % 4 WHEN 0 THEN NULL WHEN 1 THEN 'stale' ELSE '{tags_version()}' END AS tags_version
  FROM (SELECT sha256 AS hash, min(id) AS file_id, min(ck) AS ck, arg_min(data, id) AS data
        FROM media_base WHERE ck % 3 <> 0 GROUP BY sha256))"""

MEDIA_CORE = [MEDIA_BASE, MEDIA_FILES, MEDIA_MIME, MEDIA_EXIF]

# --------------------------------------------------------------- timestamps

_SP = UNICODE_SPACE_CLASS
DATE_RE = r"^(\d{4}):(\d{2}):(\d{2}) (\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?$"
OFF_RE = r"^([+-])(\d{2}):(\d{2})$"


def off_seconds(x: str) -> str:
    return (f"(CASE WHEN regexp_full_match({x}, '{OFF_RE}') THEN "
            f"(CASE WHEN substr({x}, 1, 1) = '-' THEN -1 ELSE 1 END) * "
            f"(CAST(substr({x}, 2, 2) AS INTEGER) * 3600 + CAST(substr({x}, 5, 2) AS INTEGER) * 60) END)")


def capture_ctes(source: str, zone: str) -> list[str]:
    """Rows (id, v, hint, prio, tag) per priority tag -> parsed -> first hit per id.
    ``source`` has columns id, data, mod_time."""
    unions = []
    for prio, tag in enumerate(CAPTURE_TAG_PRIORITY):
        comp = OFFSET_COMPANION_TAGS.get(tag)
        hint = f"json_extract_string(data, '$.\"{comp}\"')" if comp else "CAST(NULL AS VARCHAR)"
        unions.append(f"SELECT id, json_extract_string(data, '$.\"{tag}\"') AS v, {hint} AS hint, "
                      f"{prio} AS prio, '{tag}' AS tag FROM ct_src")
    tagged = " UNION ALL ".join(unions)
    g = lambda i: f"regexp_extract(rest, '{DATE_RE}', {i})"
    return [
        f"ct_src AS (SELECT id, CASE WHEN json_valid(data) AND json_type(data) = 'OBJECT' THEN data END AS data, "
        f"mod_time FROM {source})",
        f"ct_tags AS ({tagged})",
        f"""ct_trim AS (
  SELECT id, prio, tag, hint,
    regexp_replace(regexp_replace(v, '^{_SP}+', ''), '{_SP}+$', '') AS s
  FROM ct_tags WHERE v IS NOT NULL AND v <> '')""",
        """ct_split AS (
  SELECT *,
    CASE WHEN ends_with(s, 'Z') THEN '+00:00'
         WHEN length(s) >= 6 AND substr(right(s, 6), 1, 1) IN ('+', '-') AND substr(right(s, 6), 4, 1) = ':'
         THEN right(s, 6) END AS emb,
    CASE WHEN ends_with(s, 'Z') THEN left(s, length(s) - 1)
         WHEN length(s) >= 6 AND substr(right(s, 6), 1, 1) IN ('+', '-') AND substr(right(s, 6), 4, 1) = ':'
         THEN left(s, length(s) - 6) ELSE s END AS rest
  FROM ct_trim)""",
        f"""ct_fields AS (
  SELECT *, regexp_full_match(rest, '{DATE_RE}') AS ok,
    TRY_CAST({g(1)} AS INTEGER) AS y, TRY_CAST({g(2)} AS INTEGER) AS mo, TRY_CAST({g(3)} AS INTEGER) AS d,
    TRY_CAST({g(4)} AS INTEGER) AS h, TRY_CAST({g(5)} AS INTEGER) AS mi, TRY_CAST({g(6)} AS INTEGER) AS se,
    TRY_CAST(rpad(substr({g(7)}, 1, 6), 6, '0') AS BIGINT) AS us
  FROM ct_split)""",
        f"""ct_local AS (
  SELECT *, CASE WHEN ok AND mo BETWEEN 1 AND 12 AND h < 24 AND mi < 60 AND se < 60 AND d >= 1
    THEN try(make_timestamp(y, mo, d, h, mi, CAST(se AS DOUBLE))) + to_microseconds(coalesce(us, 0)) END AS loc,
    {off_seconds('emb')} AS emb_s, {off_seconds('hint')} AS hint_s
  FROM ct_fields)""",
        f"""ct_parsed AS (
  SELECT id, prio, tag,
    CASE WHEN s = '' THEN NULL
         WHEN emb IS NOT NULL THEN CASE WHEN emb_s IS NOT NULL THEN loc - to_seconds(emb_s) END
         WHEN hint_s IS NOT NULL THEN loc - to_seconds(hint_s)
         ELSE timezone('UTC', timezone('{zone}', loc)) END AS ts
  FROM ct_local)""",
        """ct_first AS (
  SELECT id, arg_min(ts, prio) AS ts, arg_min(tag, prio) AS tag FROM ct_parsed WHERE ts IS NOT NULL GROUP BY id)""",
        """capture AS (
  SELECT s.id, coalesce(f.ts, s.mod_time) AS capture_ts,
    CASE WHEN f.ts IS NOT NULL THEN f.tag WHEN s.mod_time IS NOT NULL THEN 'files.mod_time' END AS source
  FROM ct_src s LEFT JOIN ct_first f USING (id))""",
    ]


def dst_path(ts: str, sha: str, path: str) -> str:
    name = basename(path)
    rex = r"^(?s)(.+?)(\.[^.]*)?$"
    base = f"regexp_extract({name}, '{rex}', 1)"
    ext = f"regexp_extract({name}, '{rex}', 2)"
    trimmed = f"regexp_replace(regexp_replace({base}, '^{_SP}+', ''), '{_SP}+$', '')"
    clean = f"(CASE WHEN {trimmed} = '' THEN '_' ELSE regexp_replace({trimmed}, '[/\\\\\\x00-\\x1F\\x7F]', '_', 'g') END)"
    t = f"strftime({ts}, '%Y%m%dT%H%M%SZ')"
    return (f"('media/' || strftime({ts}, '%Y') || '/' || strftime({ts}, '%m') || '/' || {t} || '-' || "
            f"substr({sha}, 1, 8) || '-' || {clean} || lower({ext}))")


MEDIA_TYPES = lst(MEDIA_MIME_TYPES)
EXCLUDED_GROUPS = lst(EXCLUDED_TAG_GROUPS)
