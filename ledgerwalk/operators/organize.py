"""Organise raw media into ``clean/media/YYYY/MM/`` by capture time.

The reference processes candidates one by one in path order.  Here every
candidate's status is decided in bulk:

1. ``error``   — no usable timestamp;
2. ``skipped`` — a live clean file already has the hash;
3. (dry run: everything else is ``organize``)
4. ``collided``— the destination is already a live clean path, or an earlier
   candidate (by path) of another hash was organised to it;
5. the first row by path of each hash that does not collide is ``organized``,
   and the rows of the hash behind it are ``skipped``.

Steps 4 and 5 depend on each other only where hashes share a destination.  A
destination names the hash's first 8 characters, so the graph of hashes and
contested destinations falls apart by them, and each part is settled on its own,
in path order: the rows stream by part and path, and only the part that is being
read is remembered (``_settle``).  Of a hash only the first row of each contested
destination before its first uncontested one enters its part: that one is free
whatever the others get.  There are no rounds.

Winners are aggregates (``min_by``), never windows, so a hash or destination
held by millions of copies is not pulled into one task, and they meet the
candidates in salted joins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..constants import (MEDIA_MIME_TYPES, NO_TIMESTAMP, RULE_ORGANIZE, STATUS_COLLIDED, STATUS_ERROR,
                         STATUS_ORGANIZE, STATUS_ORGANIZED, STATUS_SKIPPED)
from ..functions.paths import short_sha
from ..functions.timestamps import destination_path, validate_zone, with_capture_time
from .catalog import _ts
from .ids import with_dense_ids
from .logs import appended
from .skew import DEFAULT_BUCKETS, salted_join


def _per_hash(mime: DataFrame, exif: DataFrame | None, mime_types: Sequence[str],
              clean_files: DataFrame | None = None) -> DataFrame:
    """One row per listed-type hash: its tag JSON and whether a live clean copy
    exists.  Every input has at most one row per hash, so these joins cannot
    skew; the big file side then meets this table in a single join."""
    h = mime.filter(F.col("mime_type").isin(*mime_types)).select(F.col("hash").alias("sha256"))
    if exif is not None:
        h = h.join(exif.select(F.col("hash").alias("sha256"), "data"), "sha256", "left")
    else:
        h = h.withColumn("data", F.lit(None).cast("string"))
    if clean_files is not None:
        clean = clean_files.filter(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.lit(True).alias("in_clean"))
        h = h.join(clean, "sha256", "left")
    return h


def _live_raw_hashed(files: DataFrame) -> DataFrame:
    return files.filter((F.col("store") == "raw") & ~F.col("missing") & F.col("sha256").isNotNull()) \
        .select("id", "sha256", "path", "size", "mod_time")


def organize_candidates(files: DataFrame, mime: DataFrame, exif: DataFrame | None,
                        mime_types: Sequence[str] = MEDIA_MIME_TYPES) -> DataFrame:
    """Live raw hashed files whose hash has a listed MIME type, with the hash's
    tag JSON (NULL without an exif row)."""
    return salted_join(_live_raw_hashed(files), _per_hash(mime, exif, mime_types), "sha256", "inner")


def organize_plan(tables: dict[str, DataFrame], zone: str,
                  mime_types: Sequence[str] | None = None, dry_run: bool = False,
                  buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Per candidate: capture time and source, destination, reason, status.

    Shuffles of the candidate side: one join by hash (against the per-hash
    table) and one by hash (against the winners); its first rows of each hash and
    destination meet the taken destinations.  Each is salted over ``buckets`` tasks a
    key.  The plan is not stored: store it where it is read more than once."""
    zone = validate_zone(zone)
    if "mime" not in tables:
        raise ValueError("mime table not available: run the mime enricher first")
    files = tables["files"]
    live_clean = files.filter((F.col("store") == "clean") & ~F.col("missing"))
    per_hash = _per_hash(tables["mime"], tables.get("exif"), mime_types or MEDIA_MIME_TYPES, live_clean)
    cands = salted_join(_live_raw_hashed(files), per_hash, "sha256", "inner", spread_by=["id"], buckets=buckets)
    c = with_capture_time(cands, "data", "mod_time", zone, "capture_ts", "source").select(
        F.col("id").alias("file_id"), "sha256", "path", "size", "mod_time", "capture_ts", "source", "in_clean")
    c = c.withColumn("dst_path", F.when(F.col("capture_ts").isNotNull(),
                                        destination_path("capture_ts", "sha256", "path"))) \
         .withColumn("reason", F.when(F.col("source").isNotNull(), F.concat(F.lit("source: "), F.col("source"))))
    first = (F.when(F.col("capture_ts").isNull(), F.lit(STATUS_ERROR))
             .when(F.col("in_clean").isNotNull(), F.lit(STATUS_SKIPPED)))
    # materialise once: the status steps below read the candidates several times
    c = c.withColumn("status", first).drop("in_clean").checkpoint()
    if dry_run:
        return _finish(c.withColumn("status", F.coalesce("status", F.lit(STATUS_ORGANIZE))))

    todo = c.filter(F.col("status").isNull())
    winners = _hash_winners(todo, live_clean.select(F.col("path").alias("dst_path"), F.lit(True).alias("dst_taken")), buckets)
    decided = salted_join(todo, winners.select("sha256", F.col("path").alias("w_path")), "sha256", "left",
                          spread_by=["file_id"], buckets=buckets)
    status = (F.when(F.col("path") == F.col("w_path"), F.lit(STATUS_ORGANIZED))
              .when(F.col("path") > F.col("w_path"), F.lit(STATUS_SKIPPED))
              .otherwise(F.lit(STATUS_COLLIDED)))
    decided = decided.withColumn("status", status).drop("w_path")
    return _finish(c.filter(F.col("status").isNotNull()).unionByName(decided))


def _hash_winners(todo: DataFrame, taken: DataFrame, buckets: int) -> DataFrame:
    """(sha256, file_id, path, dst_path): the row of each hash that is organised, among
    rows whose destination no clean file holds."""
    # later rows of a hash for the same destination meet what the first one met
    firsts = todo.groupBy("sha256", "dst_path").agg(F.min_by(F.struct("file_id", "path"), "path").alias("w")) \
        .select("sha256", "dst_path", "w.file_id", "w.path")
    firsts = salted_join(firsts, taken, "dst_path", "left", spread_by=["file_id"], buckets=buckets) \
        .filter(F.col("dst_taken").isNull()).drop("dst_taken").checkpoint()
    claims = firsts.groupBy("dst_path").agg(F.count(F.lit(1)).alias("claims")).filter("claims > 1").checkpoint()
    if claims.isEmpty():
        return firsts.groupBy("sha256").agg(F.min_by(F.struct("file_id", "path", "dst_path"), "path").alias("w")) \
            .select("sha256", "w.file_id", "w.path", "w.dst_path")
    marked = salted_join(firsts, claims, "dst_path", "left", spread_by=["file_id"], buckets=buckets).checkpoint()
    own = F.col("claims").isNull()
    safe = marked.filter(own).groupBy("sha256").agg(F.min_by(F.struct("file_id", "path", "dst_path"), "path").alias("w")) \
        .select("sha256", "w.file_id", "w.path", "w.dst_path").checkpoint()
    limit = safe.select("sha256", F.col("path").alias("safe_path"))
    open_rows = salted_join(marked.filter(~own).drop("claims"), limit, "sha256", "left", spread_by=["file_id"], buckets=buckets)
    open_rows = open_rows.filter(F.col("safe_path").isNull() | (F.col("path") < F.col("safe_path"))).drop("safe_path").checkpoint()
    contested = open_rows.select("sha256").distinct()
    rows = open_rows.unionByName(safe.join(contested, "sha256", "left_semi"))
    dealt = rows.select(short_sha("sha256").alias("part"), "sha256", "file_id", "path", "dst_path") \
        .repartition("part").sortWithinPartitions("part", "path")
    settled = dealt.mapInArrow(_settle, "sha256 string, file_id long, path string, dst_path string")
    return safe.join(contested, "sha256", "left_anti").unionByName(settled)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, sha256, file_id, path, dst_path) by part and path: a row takes its
    destination unless its hash has one or another hash took it.  Holds what one part
    has settled so far."""
    part, done, taken = None, set(), set()
    for b in batches:
        keep = []
        for p, sha, dst in zip(*(b.column(c).to_pylist() for c in ("part", "sha256", "dst_path"))):
            if p != part:
                part, done, taken = p, set(), set()
            keep.append(sha not in done and dst not in taken)
            if keep[-1]:
                done.add(sha)
                taken.add(dst)
        yield b.select(["sha256", "file_id", "path", "dst_path"]).filter(pa.array(keep, pa.bool_()))


def _finish(c: DataFrame) -> DataFrame:
    return c.withColumn("error", F.when(F.col("status") == STATUS_ERROR, F.lit(NO_TIMESTAMP))) \
        .select("file_id", "sha256", "path", "size", "mod_time", "capture_ts", "source",
                "dst_path", "reason", "status", "error")


def organize_counts() -> list[Column]:
    """considered, organized, skipped, collided, errors: for ``agg``, or for ``observe``
    on the pass that writes the plan."""
    s = F.col("status")
    return [F.count(F.lit(1)).cast("long").alias("considered"),
            F.count_if(s.isin(STATUS_ORGANIZED)).cast("long").alias("organized"),
            F.count_if(s == STATUS_SKIPPED).cast("long").alias("skipped"),
            F.count_if(s == STATUS_COLLIDED).cast("long").alias("collided"),
            F.count_if(s == STATUS_ERROR).cast("long").alias("errors")]


def organize_stats(plan: DataFrame) -> DataFrame:
    """One row of ``organize_counts``."""
    return plan.agg(*organize_counts())


def apply_organize(tables: dict[str, DataFrame], plan: DataFrame, outcomes: DataFrame,
                   remove_originals: bool, now: datetime) -> dict[str, DataFrame]:
    """Apply a real run's copy outcomes.

    ``outcomes(file_id, error, remove_error)``: ``error`` non-NULL = the copy
    failed; ``remove_error`` non-NULL = the copy succeeded but the original
    could not be removed.  Success inserts the clean row (or revives a missing
    clean row at that path), appends an ``organize`` operation pointing at the
    clean id, and deletes the raw row when its original was removed.  Planning
    errors and failed copies append error rows.  What the outcomes decide is stored
    once; ``plan`` itself is read for that and for its errors, so a plan that is not
    stored is made twice.
    """
    n = _ts(now)
    files = tables["files"]
    done = plan.filter(F.col("status") == STATUS_ORGANIZED) \
        .select("file_id", "sha256", "path", "size", "mod_time", "dst_path", "reason").join(
        outcomes.select("file_id", F.col("error").alias("copy_error"), "remove_error"), "file_id", "inner")
    # a clean row already at the destination (necessarily missing) is revived
    dead = files.filter(F.col("store") == "clean").select(
        F.col("path").alias("dst_path"), F.col("id").alias("clean_id"))
    done = done.join(dead, "dst_path", "left").checkpoint()
    ok = done.filter(F.col("copy_error").isNull())
    revive = ok.filter(F.col("clean_id").isNotNull())
    fresh = with_dense_ids(ok.filter(F.col("clean_id").isNull()).drop("clean_id"), ["path"], after=files,
                           id_col="clean_id")
    ok_all = fresh.unionByName(revive.select(*fresh.columns))
    ok_all = ok_all.checkpoint()

    clean_rows = ok_all.select(
        F.col("clean_id").alias("id"), F.lit("clean").alias("store"), F.col("dst_path").alias("path"),
        "size", "mod_time", n.alias("found_at"), n.alias("reconciled_at"), F.lit(False).alias("missing"),
        "sha256", n.alias("hashed_at"))
    removed = ok_all.filter(F.lit(remove_originals) & F.col("remove_error").isNull()).select(
        F.col("file_id").alias("id"))
    # new ids are in no file yet: only revived rows are replaced
    replaced = revive.select(F.col("clean_id").alias("id"))
    kept = files.join(removed.unionByName(replaced), "id", "left_anti")
    new_files = kept.unionByName(S.conform(clean_rows, S.FILES))

    ops = ok_all.select(
        F.col("clean_id").alias("file_id"), F.lit(None).cast("long").alias("dir_id"),
        F.lit("raw").alias("src_store"), F.col("path").alias("src_path"), F.lit("clean").alias("dst_store"),
        "dst_path", F.lit(RULE_ORGANIZE).alias("rule"), "reason", n.alias("executed_at"))
    ops = with_dense_ids(ops, ["src_path"], after=tables["operations"])

    plan_errs = plan.filter(F.col("status") == STATUS_ERROR).select("file_id", "path", "error").checkpoint()
    copy_errs = done.filter(F.col("copy_error").isNotNull()).select(
        "file_id", "path", F.concat(F.lit("copy: "), F.col("copy_error")).alias("error"))
    rm_errs = ok_all.filter(F.lit(remove_originals) & F.col("remove_error").isNotNull()).select(
        "file_id", "path", F.concat(F.lit("remove raw original: "), F.col("remove_error")).alias("error"))
    errs = plan_errs.unionByName(copy_errs).unionByName(rm_errs).select(
        "file_id", F.lit(None).cast("long").alias("dir_id"), F.lit(None).cast("string").alias("enricher"),
        F.lit(RULE_ORGANIZE).alias("rule"), "error", n.alias("occurred_at"), "path")
    errs = with_dense_ids(errs, ["path", "error"], after=tables["process_errors"])

    out = dict(tables)
    out["files"] = S.conform(new_files, S.FILES)
    out["operations"] = appended(tables["operations"], S.conform(ops, S.OPERATIONS))
    out["process_errors"] = appended(tables["process_errors"], S.conform(errs, S.PROCESS_ERRORS))
    return out
