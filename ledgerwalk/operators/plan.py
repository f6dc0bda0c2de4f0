"""Plan presentation, execution order, and applying reported outcomes.

The physical moves happen outside Spark (an external mover); it reports an
``outcomes(op_id, error)`` table (NULL error = done) that is applied here.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..constants import KIND_RMDIR, REPORT_EMPTY, REPORT_MOVE, REPORT_REMOVAL, REPORT_RULE
from ..functions.paths import path_depth
from ..session import ensure_checkpoint_dir
from .catalog import _ts
from .ids import with_dense_ids
from .logs import appended


def plan_report(ops: DataFrame) -> DataFrame:
    """Report lines with their sort keys ``(rule_priority, is_op, plan_key)``.

    ``Rule: r (n ops)`` headers, then one line per op; ``No operations
    proposed.`` when the plan is empty.  Use ``report_text`` for the ordered
    lines.
    """
    ensure_checkpoint_dir(ops.sparkSession)
    ops = ops.checkpoint()  # read three times below
    headers = ops.groupBy("rule", "rule_priority").agg(F.count(F.lit(1)).alias("n")).select(
        "rule_priority", F.lit(0).alias("is_op"), F.lit("").alias("plan_key"),
        F.format_string(REPORT_RULE, "rule", "n").alias("line"))
    reason = F.coalesce(F.col("reason"), F.lit(""))
    lines = ops.select(
        "rule_priority", F.lit(1).alias("is_op"), "plan_key",
        F.when(F.col("kind") == KIND_RMDIR,
               F.format_string(REPORT_REMOVAL, "kind", "src_store", "src_path", reason))
        .otherwise(F.format_string(REPORT_MOVE, "kind", "src_store", "src_path",
                                   "dst_store", "dst_path", reason)).alias("line"))
    empty = ops.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0).select(
        F.lit(-1).alias("rule_priority"), F.lit(0).alias("is_op"), F.lit("").alias("plan_key"),
        F.lit(REPORT_EMPTY).alias("line"))
    return headers.unionByName(lines).unionByName(empty)


def report_text(ops: DataFrame) -> DataFrame:
    return plan_report(ops).orderBy("rule_priority", "is_op", "plan_key").select("line")


def execution_order(ops: DataFrame) -> DataFrame:
    """Ops with ``exec_rank`` (0 file ops, 1 removals) and ``exec_depth``; sort by
    ``exec_rank, exec_depth DESC, rule_priority, plan_key`` — file ops first,
    deepest directories first, plan order otherwise (stable)."""
    rmdir = F.col("kind") == KIND_RMDIR
    return ops.withColumn("exec_rank", F.when(rmdir, 1).otherwise(0)) \
              .withColumn("exec_depth", F.when(rmdir, path_depth("src_path")).otherwise(0))


def _execution_keys() -> list:
    return ["exec_rank", F.col("exec_depth").desc(), "rule_priority", "plan_key"]


def execution_sequence(ops: DataFrame) -> DataFrame:
    """``execution_order`` with ``seq``, the position (from 1) at which a mover is to
    run each op; the numbers survive whatever order the rows are stored in."""
    return with_dense_ids(execution_order(ops), _execution_keys(), start=1, id_col="seq")


def resolve_outcomes(files: DataFrame, ops: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Pair each executed op with its outcome; refuse file moves whose
    destination (store, path) is already catalogued or claimed twice."""
    j = ops.join(outcomes.select("op_id", F.col("error").alias("fs_error")), "op_id", "inner")
    is_file = F.col("kind") != KIND_RMDIR
    dst = ["dst_store", "dst_path"]
    # (store, path) is unique in files, so this side has one row per key
    taken = files.select(F.col("store").alias("dst_store"), F.col("path").alias("dst_path"),
                         F.lit(True).alias("taken"))
    shared = j.filter(is_file & F.col("fs_error").isNull()).groupBy(*dst) \
        .agg(F.count(F.lit(1)).alias("n_dst")).filter(F.col("n_dst") > 1)
    j = j.join(taken, dst, "left").join(shared, dst, "left")
    conflict = is_file & F.col("fs_error").isNull() & (F.col("taken").isNotNull() | F.col("n_dst").isNotNull())
    err = F.coalesce(F.col("fs_error"), F.when(conflict, F.concat(
        F.lit("destination already in catalogue: "), F.col("dst_store"), F.lit("/"), F.col("dst_path"))))
    return execution_order(j.withColumn("error", err).drop("fs_error", "taken", "n_dst"))


def apply_outcomes(tables: dict[str, DataFrame], ops: DataFrame, outcomes: DataFrame,
                   now: datetime) -> tuple[dict[str, DataFrame], DataFrame]:
    """Apply executed ops: moved files change (store, path), removed directories
    are deleted, each success appends an operation row and each failure an
    error row.  Returns new tables and a one-row (succeeded, failed) frame."""
    n = _ts(now)
    files, dirs = tables["files"], tables["directories"]
    # every output below reads the resolved ops: materialise them once
    res = resolve_outcomes(files, ops, outcomes).checkpoint()
    ok = F.col("error").isNull()
    rmdir = F.col("kind") == KIND_RMDIR
    moved = res.filter(ok & ~rmdir).select(F.col("file_id").alias("id"), F.col("dst_store").alias("m_store"),
                                           F.col("dst_path").alias("m_path"))
    new_files = files.join(moved, "id", "left").select(
        *[F.coalesce(F.col("m_store"), F.col("store")).alias("store") if c == "store" else
          F.coalesce(F.col("m_path"), F.col("path")).alias("path") if c == "path" else F.col(c)
          for c in files.columns])
    removed = res.filter(ok & rmdir).select(F.col("dir_id").alias("id"))
    new_dirs = dirs.join(removed, "id", "left_anti")

    order = _execution_keys()
    done = res.filter(ok).select(
        "file_id", "dir_id", "src_store", "src_path", "dst_store", "dst_path", "rule", "reason",
        n.alias("executed_at"), "exec_rank", "exec_depth", "rule_priority", "plan_key")
    ops_rows = with_dense_ids(done, order, after=tables["operations"])
    failed = res.filter(~ok).select(
        "file_id", "dir_id", F.lit(None).cast("string").alias("enricher"), "rule", "error",
        n.alias("occurred_at"), "exec_rank", "exec_depth", "rule_priority", "plan_key")
    err_rows = with_dense_ids(failed, order, after=tables["process_errors"])

    out = dict(tables)
    out["files"] = new_files
    out["directories"] = new_dirs
    out["operations"] = appended(tables["operations"], S.conform(ops_rows, S.OPERATIONS))
    out["process_errors"] = appended(tables["process_errors"], S.conform(err_rows, S.PROCESS_ERRORS))
    return out, execution_stats(res)


def execution_stats(resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count_if(F.col("error").isNull()).cast("long").alias("succeeded"),
                        F.count_if(F.col("error").isNotNull()).cast("long").alias("failed"))
