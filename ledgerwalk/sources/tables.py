"""Catalogue tables as versioned Parquet directories.

``write_tables`` writes the tables of version ``n`` under
``<root>/v=<n>/<table>`` and then commits it by writing a manifest of its own,
``<root>/versions/<n>``, which says where each table of the version lies;
nothing that exists is ever replaced.  Readers take the highest version whose
manifest is complete, so a failed job leaves an unused directory and no visible
version.  Tables that a job did not change are not written again: the manifest
points at the version that has them.  A table that only grew (``operators.logs``)
lies in parts: a job writes its new rows, and the manifest names all versions that
hold a part, so ten new error rows cost ten rows however long the log is.  A log of
more than MAX_PARTS parts is written as one again.  ``files`` is partitioned by
``store`` for partition pruning.

Old versions stay until ``vacuum`` is asked to remove them.

Only a root without any version is an empty catalogue; whatever cannot be read
fails.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.logs import rows_since

TABLE_SCHEMAS = {
    "files": S.FILES, "directories": S.DIRECTORIES, "operations": S.OPERATIONS,
    "process_errors": S.PROCESS_ERRORS,
    "mime": S.enricher_schema(S.MIME_COLUMNS), "exif": S.enricher_schema(S.EXIF_COLUMNS),
}
PARTITION_BY = {"files": ["store"]}
MAX_PARTS = 64


def _children(spark: SparkSession, path: str) -> dict[str, object]:
    """Names under ``path`` on whatever file system it is; none if it is absent."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return {}
    return {s.getPath().getName(): s for s in fs.listStatus(p)}


def _numbers(names, prefix: str = "") -> list[int]:
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())


def committed_versions(spark: SparkSession, root: str) -> list[int]:
    """Versions whose manifest was written to its end."""
    return [n for n in _numbers(_children(spark, f"{root}/versions"))
            if "_SUCCESS" in _children(spark, f"{root}/versions/{n}")]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """{"version", "tables": {name: version that holds it, or a list of those that hold
    its parts}, "notes"} of the newest (or the given) version; None if the catalogue
    has none."""
    if version is None:
        done = committed_versions(spark, root)
        if not done:
            if _numbers(_children(spark, root), "v="):
                raise ValueError(f"catalogue {root!r} has tables but no committed version")
            return None
        version = done[-1]
    line = spark.read.text(f"{root}/versions/{version}", wholetext=True).first()  # one small row
    return json.loads(line["value"])


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: S.empty(spark, schema) for name, schema in TABLE_SCHEMAS.items()
            if name not in ("mime", "exif")}


def _parts(at: int | list[int]) -> list[int]:
    return at if isinstance(at, list) else [at]


def read_tables(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    m = manifest(spark, root, version)
    if m is None:
        return empty_tables(spark)
    return {name: S.conform(spark.read.schema(TABLE_SCHEMAS[name]).parquet(*[f"{root}/v={n}/{name}" for n in _parts(at)]), TABLE_SCHEMAS[name])
            for name, at in m["tables"].items()}


def write_tables(tables: Mapping[str, DataFrame], root: str, base: Mapping[str, DataFrame] | None = None,
                 notes: Mapping[str, object] | None = None) -> int:
    """Commit ``tables`` as the next version.  ``base`` is what ``read_tables``
    returned: a table that still is the same DataFrame is taken over from the
    newest version instead of being written.  ``notes`` are kept in the manifest
    (those of the version before stay unless replaced)."""
    spark = next(iter(tables.values())).sparkSession
    last = manifest(spark, root)
    used = _numbers(_children(spark, root), "v=") + _numbers(_children(spark, f"{root}/versions"))
    version = max(used, default=0) + 1  # also past versions that were never committed
    where = {}
    for name, df in tables.items():
        if base is not None and last is not None and base.get(name) is df and name in last["tables"]:
            where[name] = last["tables"][name]
            continue
        held = _parts(last["tables"][name]) if base is not None and last is not None and name in last["tables"] else []
        new = rows_since(df, base[name]) if held and name in base and len(held) < MAX_PARTS else None
        if new is not None:
            rows = new[0]
            for more in new[1:]:
                rows = rows.unionByName(more)
            seen = Observation()
            rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(f"{root}/v={version}/{name}")
            where[name] = held + [version] if seen.get["n"] else last["tables"][name]
            continue
        w = df.write.mode("errorifexists")
        if name in PARTITION_BY:
            w = w.partitionBy(*PARTITION_BY[name])
        w.parquet(f"{root}/v={version}/{name}")
        where[name] = version
    entry = {"version": version, "tables": where, "notes": {**((last or {}).get("notes") or {}), **(notes or {})}}
    spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1) \
        .write.mode("errorifexists").text(f"{root}/versions/{version}")
    return version


def vacuum(spark: SparkSession, root: str, keep: int = 10) -> list[int]:
    """Remove what only versions older than the newest ``keep`` need: their manifests
    first, then folders that no remaining manifest names.  A folder newer than the
    newest manifest may belong to a job that is still writing, and stays.  Returns the
    versions that can no longer be read."""
    if keep < 1:
        raise ValueError("vacuum keeps at least the newest version")
    done = committed_versions(spark, root)
    gone = done[:-keep]
    needed = {n for v in done[-keep:] for at in manifest(spark, root, v)["tables"].values() for n in _parts(at)}
    jvm = spark.sparkContext._jvm
    for path in [f"{root}/versions/{n}" for n in gone] + [
            f"{root}/v={n}" for n in _numbers(_children(spark, root), "v=") if done and n < done[-1] and n not in needed]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return gone
