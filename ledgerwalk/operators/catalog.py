"""Catalogue jobs: directory rollup, walk upserts, staleness marking, stats.

Every job is ``old tables -> new tables`` with ``now`` passed in.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..constants import DEFAULT_MAX_STALENESS
from ..functions.paths import ancestors, dirname
from ..session import ensure_checkpoint_dir
from .ids import with_dense_ids


def _ts(now: datetime):
    """A ``TIMESTAMP_NTZ`` literal of ``now``'s UTC wall time, whole seconds.

    Built from text so neither the Python process zone nor the session zone
    can shift it.  An aware datetime is converted to UTC first."""
    if now.tzinfo is not None:
        from datetime import timezone
        now = now.astimezone(timezone.utc).replace(tzinfo=None)
    return F.expr(f"TIMESTAMP_NTZ'{now.replace(microsecond=0).isoformat(sep=' ')}'")


def directory_rollup(listing: DataFrame) -> DataFrame:
    """Recursive ``file_count`` / ``total_size`` of every directory.

    Files are first summed by their immediate directory (partial aggregation
    before the shuffle), then each directory's totals are credited to every
    ancestor.  The store root ``.`` is a hot key by construction; map-side
    combining keeps its shuffle volume to one row per task.  Visited
    directories join as zero rows through a union, not a join.
    """
    files = listing.filter(~F.col("is_dir")).select(
        "store", dirname("path").alias("dir"), F.col("size").cast("long").alias("size"))
    per_dir = files.groupBy("store", "dir").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    credited = per_dir.select(
        "store", F.explode(ancestors("dir")).alias("path"), "n", "bytes",
        F.lit(None).cast("boolean").alias("listed"))
    visited = listing.filter(F.col("is_dir")).select(
        "store", "path", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bytes"),
        F.col("listed"))
    return (credited.unionByName(visited)
            .groupBy("store", "path")
            .agg(F.sum("n").cast("long").alias("file_count"),
                 F.sum("bytes").cast("long").alias("total_size"),
                 F.coalesce(F.min("listed"), F.lit(True)).alias("listed")))


def _once(df: DataFrame) -> DataFrame:
    """Evaluated here, and read from the checkpoint by everything that follows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def upsert_files(files: DataFrame, listing: DataFrame, now: datetime) -> DataFrame:
    """Insert new (store, path); update size/mod_time/reconciled_at/missing of
    seen ones (id, found_at, sha256, hashed_at kept); leave unseen rows."""
    n = _ts(now)
    seen = listing.filter(~F.col("is_dir")).select(
        "store", "path", F.col("size").alias("n_size"), F.col("mod_time").alias("n_mod"))
    j = _once(files.join(seen, ["store", "path"], "full_outer"))
    hit = F.col("n_size").isNotNull()
    kept = j.filter(F.col("id").isNotNull()).select(
        "id", "store", "path",
        F.when(hit, F.col("n_size")).otherwise(F.col("size")).alias("size"),
        F.when(hit, F.col("n_mod")).otherwise(F.col("mod_time")).alias("mod_time"),
        "found_at",
        F.when(hit, n).otherwise(F.col("reconciled_at")).alias("reconciled_at"),
        F.when(hit, F.lit(False)).otherwise(F.col("missing")).alias("missing"),
        "sha256", "hashed_at")
    new = j.filter(F.col("id").isNull()).select(
        "store", "path", F.col("n_size").alias("size"), F.col("n_mod").alias("mod_time"),
        n.alias("found_at"), n.alias("reconciled_at"), F.lit(False).alias("missing"),
        F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("timestamp_ntz").alias("hashed_at"))
    new = with_dense_ids(new, ["store", "path"], after=files)
    return S.conform(kept.unionByName(new), S.FILES)


def upsert_directories(directories: DataFrame, rolled: DataFrame, stores: Sequence[str]) -> DataFrame:
    """Rows of the walked ``stores``: matched -> new counts, unmatched -> deleted
    (stale), new -> appended with fresh ids.  Other stores are untouched."""
    r = rolled.select("store", "path", F.col("file_count").alias("n_count"),
                      F.col("total_size").alias("n_size"), F.col("listed").alias("n_listed"))
    j = _once(directories.join(r, ["store", "path"], "full_outer"))
    hit = F.col("n_count").isNotNull()
    walked = F.col("store").isin(*stores)
    kept = j.filter(F.col("id").isNotNull() & (hit | ~walked)).select(
        "id", "store", "path",
        F.when(hit, F.col("n_count")).otherwise(F.col("file_count")).alias("file_count"),
        F.when(hit, F.col("n_size")).otherwise(F.col("total_size")).alias("total_size"),
        F.when(hit, F.col("n_listed")).otherwise(F.col("listed")).alias("listed"))
    new = j.filter(F.col("id").isNull()).select(
        "store", "path", F.col("n_count").alias("file_count"),
        F.col("n_size").alias("total_size"), F.col("n_listed").alias("listed"))
    new = with_dense_ids(new, ["store", "path"], after=directories)
    return S.conform(kept.unionByName(new), S.DIRECTORIES)


def stale_directories(directories: DataFrame, rolled: DataFrame, stores: Sequence[str]) -> DataFrame:
    """Directory rows of the walked stores that the new listing no longer has."""
    return (directories.filter(F.col("store").isin(*stores))
            .join(rolled.select("store", "path"), ["store", "path"], "left_anti"))


def walk_stats(listing: DataFrame, rolled: DataFrame, stale: DataFrame) -> DataFrame:
    """One row: files_found, dirs_upserted, dirs_deleted (no joins between them)."""
    parts = (listing.filter(~F.col("is_dir")).select(F.lit(1).alias("f"))
             .unionByName(rolled.select(F.lit(1).alias("d")), allowMissingColumns=True)
             .unionByName(stale.select(F.lit(1).alias("x")), allowMissingColumns=True))
    return parts.agg(F.count("f").alias("files_found"), F.count("d").alias("dirs_upserted"),
                     F.count("x").alias("dirs_deleted"))


def apply_walk(tables: dict[str, DataFrame], listing: DataFrame, now: datetime,
               stores: Sequence[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    rolled = _once(directory_rollup(listing))
    out = dict(tables)
    out["files"] = upsert_files(tables["files"], listing, now)
    out["directories"] = upsert_directories(tables["directories"], rolled, stores)
    stats = walk_stats(listing, rolled, stale_directories(tables["directories"], rolled, stores))
    return out, stats


def staleness_cutoff(now: datetime, max_staleness: timedelta | None = None) -> datetime:
    if now.tzinfo is not None:
        from datetime import timezone
        now = now.astimezone(timezone.utc).replace(tzinfo=None)
    return now.replace(microsecond=0) - (max_staleness or DEFAULT_MAX_STALENESS)


def mark_missing(files: DataFrame, now: datetime,
                 max_staleness: timedelta | None = None) -> DataFrame:
    """missing := true where reconciled_at < now - max_staleness (strict)."""
    cutoff = _ts(staleness_cutoff(now, max_staleness))
    return files.withColumn("missing", F.col("missing") | (F.col("reconciled_at") < cutoff))


def reconcile_marked(files: DataFrame, now: datetime,
                     max_staleness: timedelta | None = None) -> DataFrame:
    """One row: number of rows the marking changes."""
    cutoff = _ts(staleness_cutoff(now, max_staleness))
    return files.agg(F.count_if(~F.col("missing") & (F.col("reconciled_at") < cutoff))
                     .cast("long").alias("marked"))


def catalog_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: files (live), missing, directories, operations, errors; zeros on empty."""
    parts = tables["files"].select(
        F.when(~F.col("missing"), 1).alias("f_live"), F.when(F.col("missing"), 1).alias("f_missing"))
    for key, col in (("directories", "d"), ("operations", "o"), ("process_errors", "e")):
        if key in tables:
            parts = parts.unionByName(tables[key].select(F.lit(1).alias(col)), allowMissingColumns=True)
    cols = {c: F.count(c) if c in parts.columns else F.lit(0)
            for c in ("f_live", "f_missing", "d", "o", "e")}
    return parts.agg(
        cols["f_live"].cast("long").alias("files"), cols["f_missing"].cast("long").alias("missing"),
        cols["d"].cast("long").alias("directories"), cols["o"].cast("long").alias("operations"),
        cols["e"].cast("long").alias("errors"))
