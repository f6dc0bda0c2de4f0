"""Parallel store lister (the ``listing`` table).

Spark's file sources cannot be used: they hide names starting with ``.`` or
``_`` (exactly the junk this catalogue looks for) and list no empty
directories.  Instead the listing walks level by level: the frontier of
directories is a DataFrame spread over tasks, each task reads its
directories in batches; sub-directories form the next frontier, and local
files found are redistributed before the ``stat`` calls.  The driver only loops over depth levels, never over entries.  Each
level is cut from its lineage with a reliable checkpoint.
"""

from __future__ import annotations

import errno
import os
from collections.abc import Iterator, Mapping
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import ensure_checkpoint_dir
from .storage import FILE, FOLDER, join, local_path, normal_root, remote_entries

_FRONTIER = "store string, root string, rel string"
# kind: 'D' visited directory, 'U' unreadable directory, 'S' sub-directory to
# visit next, 'F' regular file; size and mod_time where the listing carries them
_ENTRY = "store string, root string, path string, kind string, size long, mod_time timestamp_ntz, stated boolean"
_STATED = "store string, path string, size long, mod_time timestamp_ntz, ok boolean"
_SKIP = (errno.EACCES, errno.EPERM, errno.ENOENT)
_BATCH = 8192


def _utc_seconds(ts: float) -> datetime:
    return datetime.fromtimestamp(int(ts), tz=timezone.utc).replace(tzinfo=None)


def _local_entries(folder: str) -> Iterator[tuple[str, str, None, None]]:
    """Names and entry types of a mounted folder, no stat: cheap even for a directory
    holding a large share of all files, which one task must read in order.
    Symbolic links and devices are left out."""
    with os.scandir(folder) as it:
        for entry in it:
            try:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, FOLDER, None, None
                elif entry.is_file(follow_symlinks=False):
                    yield entry.name, FILE, None, None
            except OSError as exc:
                if exc.errno not in _SKIP:
                    raise


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of each directory, streamed in batches."""
    columns = ["store", "root", "path", "kind", "size", "mod_time", "stated"]

    def frame_of(rows: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(rows, columns=columns)
        return f.astype({"size": "Int64", "mod_time": "datetime64[us]"})

    rows: list[tuple] = []
    for frame in frames:
        for store, root, rel in frame.itertuples(index=False):
            local = local_path(root)
            listed = True
            try:
                entries = _local_entries(join(local, rel)) if local is not None else remote_entries(join(root, rel))
                for name, kind, size, when in entries:
                    rows.append((store, root, name if rel == "." else f"{rel}/{name}", kind, size, when, size is not None))
                    if len(rows) >= _BATCH:
                        yield frame_of(rows)
                        rows = []
            except OSError as exc:
                if not (isinstance(exc, (PermissionError, FileNotFoundError)) or exc.errno in _SKIP):
                    raise
                listed = False  # seen but unreadable: marked so it is not mistaken for empty
            rows.append((store, root, rel, "D" if listed else "U", None, None, False))
    if rows:
        yield frame_of(rows)


def _stat(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Size and whole-second UTC mtime; files that vanished or became
    unreadable since the scan are dropped (ok = false)."""
    for frame in frames:
        out = []
        for store, root, path in frame.itertuples(index=False):
            try:
                st = os.stat(join(local_path(root), path), follow_symlinks=False)
                out.append((store, path, st.st_size, _utc_seconds(st.st_mtime), True))
            except OSError as exc:
                if exc.errno in _SKIP:
                    out.append((store, path, None, None, False))
                    continue
                raise
        yield pd.DataFrame(out, columns=["store", "path", "size", "mod_time", "ok"])


def list_stores(spark: SparkSession, roots: Mapping[str, str], partitions: int | None = None) -> DataFrame:
    """Listing of every store: regular files (size, whole-second UTC mtime) and
    every visited directory (``.`` = root); symlinks and devices skipped.  Roots are
    local paths or URIs.  A store root that cannot be listed is an error.

    Per depth level: directories are spread over tasks and read; local files (names
    only so far) are then redistributed so the ``stat`` calls, the costly part on
    network storage, run on every task, whatever the directory sizes.  Object
    stores give size and time with the name, so their files are done."""
    ensure_checkpoint_dir(spark)
    parts = partitions or spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(s, normal_root(r), ".") for s, r in roots.items()], _FRONTIER)
    levels: list[DataFrame] = []
    while True:
        scanned = frontier.repartition(parts).mapInPandas(_scan, _ENTRY).checkpoint()
        if not levels:  # one row for each store
            lost = scanned.filter("kind = 'U' and path = '.'").select("store", "root").limit(1).collect()
            if lost:
                raise FileNotFoundError(f"store {lost[0].store!r}: root {lost[0].root!r} cannot be listed")
        dirs = scanned.filter(F.col("kind").isin("D", "U")).select(
            "store", "path", F.lit(True).alias("is_dir"), F.lit(None).cast("long").alias("size"),
            F.lit(None).cast("timestamp_ntz").alias("mod_time"), (F.col("kind") == "D").alias("listed"))
        found = scanned.filter(F.col("kind") == FILE)
        stated = found.filter(~F.col("stated")).select("store", "root", "path").repartition(parts).mapInPandas(_stat, _STATED).filter("ok")
        whole = stated.unionByName(found.filter("stated").select("store", "path", "size", "mod_time", F.lit(True).alias("ok")))
        files = whole.select("store", "path", F.lit(False).alias("is_dir"), "size", "mod_time", F.lit(True).alias("listed"))
        levels += [dirs, files]
        frontier = scanned.filter(F.col("kind") == FOLDER).select("store", "root", F.col("path").alias("rel"))
        if frontier.isEmpty():
            break
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return S.conform(out, S.LISTING).checkpoint()  # every file is stat-ed once
