"""Content-keyed enrichment: candidates once per distinct hash, then values.

Two passes, as Spark jobs:

* ``identify``: one candidate row per hash not yet in the enricher table
  (an aggregate by hash, then an anti join — both one row per hash);
* ``process``: pending rows resolved to the lowest-id live copy of their
  hash, values computed on executors, applied with a left join by hash.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..constants import MEDIA_MIME_TYPES
from ..functions.mime import sniff_mime
from ..functions.tags import encode_tags, tag_group_exclude, tag_keep, tags_version
from ..session import ensure_checkpoint_dir
from .catalog import _ts
from .ids import with_dense_ids
from .logs import appended


def _live_hashed(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("missing") & F.col("sha256").isNotNull())


def _candidates(per_hash: DataFrame, table: DataFrame) -> DataFrame:
    return (per_hash.join(table.select("hash"), "hash", "left_anti")
            .select("hash", "file_id", F.lit(None).cast("timestamp_ntz").alias("processed_at")))


def identify_all_hashes(files: DataFrame, table: DataFrame) -> DataFrame:
    """Candidate (hash, lowest live file id) per hash missing from ``table``."""
    per_hash = _live_hashed(files).groupBy(F.col("sha256").alias("hash")).agg(F.min("id").alias("file_id"))
    return _candidates(per_hash, table)


def identify_by_mime(files: DataFrame, mime: DataFrame, table: DataFrame,
                     mime_types: Sequence[str] = MEDIA_MIME_TYPES) -> DataFrame:
    """As ``identify_all_hashes``, restricted to hashes whose MIME type is listed.
    Files are collapsed to one row per hash before the join (no skew)."""
    if not mime_types:
        return S.empty(files.sparkSession, S.ENRICHER_BASE)
    per_hash = _live_hashed(files).groupBy(F.col("sha256").alias("hash")).agg(F.min("id").alias("file_id"))
    typed = mime.filter(F.col("mime_type").isin(*mime_types)).select("hash")
    return _candidates(per_hash.join(typed, "hash", "left_semi"), table)


def lowest_live_copy(files: DataFrame) -> DataFrame:
    """(hash, file_id, store, path, size) of the lowest-id live copy of each hash."""
    return _live_hashed(files).groupBy(F.col("sha256").alias("hash")).agg(
        F.min_by(F.struct("id", "store", "path", "size"), "id").alias("f")).select(
        "hash", F.col("f.id").alias("file_id"), F.col("f.store").alias("store"), F.col("f.path").alias("path"),
        F.col("f.size").alias("size"))


def resolve_path(items: DataFrame, stores: Mapping[str, str] | None) -> DataFrame:
    """Attach ``abs_path``; rows of stores not in ``stores`` are dropped.  The
    store table has one row per configured store (a proven size bound)."""
    spark = items.sparkSession
    if stores is None:
        return items.withColumn("abs_path", F.col("path"))
    roots = spark.createDataFrame([(k, v.rstrip("/")) for k, v in stores.items()],
                                  "store string, root string")
    return items.join(F.broadcast(roots), "store", "inner") \
        .withColumn("abs_path", F.concat_ws("/", "root", "path")).drop("root")


def pending_items(table: DataFrame, files: DataFrame,
                  stores: Mapping[str, str] | None = None) -> DataFrame:
    """Unprocessed rows with the current lowest-id live copy of their hash (the
    stored file_id is historical and ignored); hashes without one stay pending."""
    pending = table.filter(F.col("processed_at").isNull()).select("hash")
    return resolve_path(pending.join(lowest_live_copy(files), "hash", "inner"), stores)


def reset_stale(table: DataFrame, version: str) -> DataFrame:
    """processed_at := NULL where processed under another (or no) policy version."""
    stale = F.col("processed_at").isNotNull() & ~F.col("tags_version").eqNullSafe(F.lit(version))
    return table.withColumn("processed_at",
                            F.when(stale, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("processed_at")))


class Enricher:
    """``columns`` declares the value columns; ``identify`` and ``process`` are
    DataFrame transforms.  ``process`` returns (hash, file_id, <columns>, error)
    with exactly one row per item."""

    name: str = ""
    table: str = ""
    columns: T.StructType = T.StructType([])

    def identify(self, tables: dict[str, DataFrame], table: DataFrame) -> DataFrame:
        raise NotImplementedError

    def process(self, items: DataFrame) -> DataFrame:
        raise NotImplementedError


class MimeEnricher(Enricher):
    """MIME type from the content.  ``content`` is a (id, content) frame of file
    bytes, sniffed where it lies: only the type meets the items.  Without it the
    files are read from ``abs_path`` on executors, chunk by chunk; a row holds the
    head and the outcome of the text test over the whole file."""

    name = "mime"
    table = "mime"
    columns = S.MIME_COLUMNS

    def __init__(self, content: DataFrame | None = None):
        self.content = content

    def identify(self, tables, table):
        return identify_all_hashes(tables["files"], table)

    def process(self, items):
        if self.content is not None:
            types = self.content.select(F.col("id").alias("file_id"), sniff_mime(F.col("content").cast("binary")).alias("mime_type"))
            data = items.join(types, "file_id", "left")
        else:
            from ..sources.content import read_heads, spread_by_bytes
            heads = read_heads(spread_by_bytes(items.withColumn("id", F.col("file_id"))))
            data = heads.withColumn("mime_type", sniff_mime(F.col("head"), F.col("is_text")))
        return data.select(
            "hash", "file_id", "mime_type",
            F.when(F.col("mime_type").isNull(),
                   F.concat(F.lit("detecting mime for "), F.col("abs_path"), F.lit(": unreadable"))).alias("error"))


class ExifEnricher(Enricher):
    """Media tags for hashes of media MIME types, from extractor output parsed
    by ``sources.exif_json.read_tags`` (SourceFile, error, raw tag map)."""

    name = "exif"
    table = "exif"
    columns = S.EXIF_COLUMNS

    def __init__(self, extracted: DataFrame, mime_types: Sequence[str] = MEDIA_MIME_TYPES):
        self.extracted = extracted
        self.mime_types = tuple(mime_types)

    def identify(self, tables, table):
        return identify_by_mime(tables["files"], tables["mime"], table, self.mime_types)

    def process(self, items):
        return match_tags(items, self.extracted, tags_version())


def match_tags(items: DataFrame, extracted: DataFrame, version: str) -> DataFrame:
    """Pair work items with extractor rows by path.  An ``Error`` -> ``exif <path>:
    <error>``; else the encoded tag object and the policy version.  Duplicate
    SourceFile rows: last wins.  No row -> ``exif: no result for <path>``, with the
    first parse error if a part of the output could not be parsed: the item may
    have been in it.  Policy and encoding are applied to the extractor's rows, so
    only the encoded text meets the items."""
    data = encode_tags(F.coalesce(tag_group_exclude(tag_keep(F.col("tags"))), F.create_map().cast("map<string,string>")))
    rows = extracted.select("source_file", "ordinal", "error", "parse_error",
                            F.when(F.coalesce("error", F.lit("")) == "", data).alias("data"))
    # the extractor's rows are parsed and encoded once: parts that failed have no source file
    whole = F.col("parse_error").isNull()
    per_file = rows.groupBy("source_file").agg(
        F.max_by(F.when(whole, F.struct("error", "data")), F.when(whole, F.col("ordinal"))).alias("r"),
        F.min_by("parse_error", F.when(~whole, F.col("ordinal"))).alias("x_broken"),
        F.min(F.when(~whole, F.col("ordinal"))).alias("at")).checkpoint()
    last = per_file.filter("r is not null").select(
        F.col("source_file").alias("abs_path"), F.col("r.error").alias("x_error"),
        F.col("r.data").alias("x_data"), F.lit(True).alias("x_hit"))
    broken = per_file.agg(F.min_by("x_broken", "at").alias("x_broken")).withColumn("one", F.lit(1))  # one row
    j = items.withColumn("one", F.lit(1)).join(F.broadcast(broken), "one").drop("one").join(last, "abs_path", "left")
    unparsed = F.coalesce(F.concat(F.lit(" (unparsed output: "), F.col("x_broken"), F.lit(")")), F.lit(""))
    err = (F.when(F.col("x_hit").isNull(), F.concat(F.lit("exif: no result for "), F.col("abs_path"), unparsed))
           .when(F.coalesce(F.col("x_error"), F.lit("")) != "",
                 F.concat(F.lit("exif "), F.col("abs_path"), F.lit(": "), F.col("x_error"))))
    return j.select("hash", "file_id",
                    F.when(err.isNull(), F.col("x_data")).alias("data"),
                    F.when(err.isNull(), F.lit(version)).alias("tags_version"),
                    err.alias("error"))


def check_result_columns(enricher: Enricher, results: DataFrame) -> None:
    """Driver-side check before anything is written: no undeclared value column."""
    allowed = {"hash", "file_id", "error", "abs_path", "store", "path", "size"} | set(enricher.columns.fieldNames())
    unknown = [c for c in results.columns if c not in allowed]
    if unknown:
        raise ValueError(f"enricher {enricher.name}: unknown column {unknown[0]!r} in result")


def apply_enrichment(tables: dict[str, DataFrame], enricher: Enricher, results: DataFrame,
                     now: datetime) -> dict[str, DataFrame]:
    """processed_at := now for every result; values on success, NULLs plus an
    error row on failure."""
    check_result_columns(enricher, results)
    n = _ts(now)
    table = tables.get(enricher.table)
    if table is None:
        table = S.empty(results.sparkSession, S.enricher_schema(enricher.columns))
    cols = enricher.columns.fieldNames()
    r = results.select("hash", F.col("error").alias("r_error"), F.lit(True).alias("r_hit"),
                       *[F.col(c).alias(f"r_{c}") for c in cols])
    # exactly one result per item: a second one fails the job
    r = r.groupBy("hash").agg(F.count(F.lit(1)).alias("r_n"), *[F.first(c).alias(c) for c in r.columns if c != "hash"])
    twice = F.raise_error(F.concat(F.lit(f"enricher {enricher.name}: more than one result for "), F.col("hash")))
    r = r.withColumn("r_hit", F.when(F.col("r_n") > 1, twice.cast("boolean")).otherwise(F.col("r_hit"))).drop("r_n")
    j = table.join(r, "hash", "left")
    hit = F.col("r_hit").isNotNull()
    updated = j.select(
        "hash", "file_id", F.when(hit, n).otherwise(F.col("processed_at")).alias("processed_at"),
        *[F.when(hit, F.when(F.col("r_error").isNull(), F.col(f"r_{c}"))).otherwise(F.col(c)).alias(c)
          for c in cols])
    errs = results.filter(F.col("error").isNotNull()).select(
        "file_id", F.lit(None).cast("long").alias("dir_id"), F.lit(enricher.name).alias("enricher"),
        F.lit(None).cast("string").alias("rule"), "error", n.alias("occurred_at"), "hash")
    errs = with_dense_ids(errs, ["hash"], after=tables["process_errors"])
    out = dict(tables)
    out[enricher.table] = S.conform(updated, S.enricher_schema(enricher.columns))
    out["process_errors"] = appended(tables["process_errors"], S.conform(errs, S.PROCESS_ERRORS))
    return out


def work_stats(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("error").isNull()).cast("long").alias("processed"),
                       F.count_if(F.col("error").isNotNull()).cast("long").alias("errors"))


def run_enricher(tables: dict[str, DataFrame], enricher: Enricher, now: datetime,
                 stores: Mapping[str, str] | None = None, identify_only: bool = False
                 ) -> tuple[dict[str, DataFrame], DataFrame]:
    """identify -> (optionally stop) -> pending items -> process -> apply.

    Returns new tables and a one-row (identified, processed, errors) frame."""
    spark = tables["files"].sparkSession
    table = tables.get(enricher.table)
    if table is None:
        table = S.empty(spark, S.enricher_schema(enricher.columns))
    if "tags_version" in enricher.columns.fieldNames():
        table = reset_stale(table, tags_version())
    ensure_checkpoint_dir(spark)
    cands = enricher.identify(tables, table).checkpoint()
    cand_cols = [F.lit(None).cast(f.dataType).alias(f.name) for f in enricher.columns.fields]
    table = table.unionByName(cands.select("hash", "file_id", "processed_at", *cand_cols))
    # candidates are fixed here; later steps must not re-run identify against
    # the table they were added to
    table = table.checkpoint()
    out = dict(tables)
    out[enricher.table] = table
    identified = cands.agg(F.count(F.lit(1)).cast("long").alias("identified"))
    if identify_only:
        return out, identified.select("identified", F.lit(0).cast("long").alias("processed"),
                                      F.lit(0).cast("long").alias("errors"))
    results = enricher.process(pending_items(table, tables["files"], stores)).checkpoint()
    out = apply_enrichment(out, enricher, results.select("hash", "file_id", *enricher.columns.fieldNames(),
                                                         "error"), now)
    return out, _one_row(identified, work_stats(results))


def _one_row(a: DataFrame, b: DataFrame) -> DataFrame:
    """Combine two one-row aggregates without a join."""
    ca, cb = a.columns, b.columns
    parts = a.select(*ca, *[F.lit(None).cast("long").alias(c) for c in cb]).unionByName(
        b.select(*[F.lit(None).cast("long").alias(c) for c in ca], *cb))
    return parts.agg(*[F.max(c).alias(c) for c in ca + cb])
