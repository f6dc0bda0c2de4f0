"""Incremental content hashing: what needs a hash, computing it, applying it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import ensure_checkpoint_dir
from .catalog import _ts
from .ids import with_dense_ids
from .logs import appended

ENRICHER_NAME = "sha256"


def needs_hash(files: DataFrame) -> DataFrame:
    """``(hashed_at IS NULL OR hashed_at < mod_time) AND NOT missing``.

    Keyed on ``hashed_at`` (not ``sha256``): a failed file waits for a new
    mtime.  Strict ``<``: an edit within the hashing second is not seen."""
    return files.filter((F.col("hashed_at").isNull() | (F.col("hashed_at") < F.col("mod_time")))
                        & ~F.col("missing"))


def hash_content(items: DataFrame, content_col: str = "content", path_col: str = "path") -> DataFrame:
    """(id, sha256, error) for rows that already hold their bytes (string or
    binary).  NULL content is an unreadable file."""
    c = F.col(content_col)
    return items.select(
        "id",
        F.sha2(c, 256).alias("sha256"),
        F.when(c.isNull(), F.concat(F.lit("hashing "), F.col(path_col), F.lit(": unreadable"))).alias("error"))


def apply_hashes(tables: dict[str, DataFrame], results: DataFrame,
                 now: datetime) -> dict[str, DataFrame]:
    """Success: sha256 and hashed_at := now.  Failure: sha256 := NULL,
    hashed_at := now (no endless retry) and one error row."""
    n = _ts(now)
    ensure_checkpoint_dir(results.sparkSession)
    results = results.checkpoint()  # every file is read once, whatever reads the results
    r = results.select("id", F.col("sha256").alias("r_sha"), F.col("error").alias("r_err"),
                       F.lit(True).alias("r_hit"))
    files = tables["files"].join(r, "id", "left")
    hit = F.col("r_hit").isNotNull()
    new_files = files.select(*[
        F.when(hit, F.when(F.col("r_err").isNull(), F.col("r_sha"))).otherwise(F.col("sha256")).alias("sha256")
        if c == "sha256" else
        F.when(hit, n).otherwise(F.col("hashed_at")).alias("hashed_at") if c == "hashed_at" else F.col(c)
        for c in tables["files"].columns])
    errs = results.filter(F.col("error").isNotNull()).select(
        F.col("id").alias("file_id"), F.lit(None).cast("long").alias("dir_id"),
        F.lit(ENRICHER_NAME).alias("enricher"), F.lit(None).cast("string").alias("rule"),
        "error", n.alias("occurred_at"))
    errs = with_dense_ids(errs, ["file_id"], after=tables["process_errors"])
    out = dict(tables)
    out["files"] = S.conform(new_files, S.FILES)
    out["process_errors"] = appended(tables["process_errors"], S.conform(errs, S.PROCESS_ERRORS))
    return out
