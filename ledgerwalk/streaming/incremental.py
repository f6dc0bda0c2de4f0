"""Apply listing snapshots as they arrive, with the batch walk job.

A snapshot is published in two steps (``publish_snapshot``): its rows as a
Parquet directory, then one small announcement file.  The stream follows the
announcements, so a snapshot is only ever seen whole.  Snapshots of a
micro-batch are applied one at a time in order of their number; the number of
the last one is committed with the table version it made, so a batch that is
run again after a crash skips what has been applied.  The time of a walk is
the snapshot's, not the clock's: a replay gives the same tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.catalog import apply_walk
from ..sources.tables import manifest, read_tables, write_tables

ANNOUNCEMENT = "snapshot_id long, listed_at timestamp_ntz"
APPLIED = "last_snapshot"


def publish_snapshot(listing: DataFrame, listing_dir: str, snapshot_id: int, listed_at: datetime) -> None:
    """Write a whole listing, then announce it.  Numbers rise from walk to walk."""
    listing.write.mode("errorifexists").parquet(f"{listing_dir}/snapshots/{snapshot_id}")
    note = listing.sparkSession.range(1).select(F.lit(snapshot_id).cast("long").alias("snapshot_id"),
                                                F.lit(listed_at).cast("timestamp_ntz").alias("listed_at"))
    note.coalesce(1).write.mode("append").json(f"{listing_dir}/announced")


def apply_snapshot(spark: SparkSession, listing_dir: str, catalog_root: str, snapshot_id: int, listed_at: datetime,
                   stores: Sequence[str]) -> bool:
    """Apply one published snapshot unless it, or a later one, has been applied."""
    m = manifest(spark, catalog_root)
    if m is not None and m["notes"].get(APPLIED, -1) >= snapshot_id:
        return False
    tables = read_tables(spark, catalog_root)
    listing = spark.read.schema(S.LISTING).parquet(f"{listing_dir}/snapshots/{snapshot_id}").dropDuplicates(["store", "path"])
    new_tables, _ = apply_walk(tables, listing, listed_at, stores)
    write_tables(new_tables, catalog_root, base=tables, notes={APPLIED: snapshot_id})
    return True


def walk_stream(spark: SparkSession, listing_dir: str, catalog_root: str, checkpoint: str,
                stores: Sequence[str], available_now: bool = True):
    """Start a stream over the snapshots published under ``listing_dir``."""
    announced = spark.readStream.schema(ANNOUNCEMENT).json(f"{listing_dir}/announced")

    def apply(batch: DataFrame, batch_id: int) -> None:
        # one row per snapshot
        for r in batch.distinct().orderBy("snapshot_id").collect():
            apply_snapshot(spark, listing_dir, catalog_root, r["snapshot_id"], r["listed_at"], stores)

    writer = announced.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
