"""Prioritised rules with first-claim-wins, and plan building.

Every rule returns an ``ops`` DataFrame (schema ``schemas.OPS``).  ``op_id`` is
deterministic: ``2*file_id`` for file operations, ``2*dir_id+1`` for
directory removals (a file is claimed at most once, so ids are unique).
``plan_key`` orders ops within a rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..constants import KIND_RMDIR, KIND_TRASH, RULE_DEDUP, RULE_JUNK
from ..functions.junk import junk_dir_reason, junk_file_reason
from .skew import salted_join


def live_raw(files: DataFrame) -> DataFrame:
    """``store = 'raw' AND NOT missing`` (pushed to the Parquet scan)."""
    return files.filter((F.col("store") == "raw") & ~F.col("missing"))


def unclaimed(df: DataFrame, claimed: DataFrame | Column | None, key: str = "id") -> DataFrame:
    """Drop rows that an earlier rule already claimed: by a condition on the row
    itself where the rules have one, else by an anti join on the file id."""
    if claimed is None:
        return df
    if isinstance(claimed, Column):
        return df.filter(~claimed)
    return df.join(claimed.select(F.col("file_id").alias(key)), key, "left_anti")


def _file_op(df: DataFrame, rule: str, priority: int, reason, plan_key) -> DataFrame:
    return S.conform(df.select(
        (F.col("id") * 2).alias("op_id"), F.lit(KIND_TRASH).alias("kind"),
        F.col("id").alias("file_id"), F.lit(None).cast("long").alias("dir_id"),
        F.lit("raw").alias("src_store"), F.col("path").alias("src_path"),
        F.lit("trash").alias("dst_store"), F.col("path").alias("dst_path"),
        F.lit(rule).alias("rule"), reason.alias("reason"),
        F.lit(priority).alias("rule_priority"), plan_key.alias("plan_key")), S.OPS)


class Rule:
    name: str = ""
    priority: int = 0

    def evaluate(self, tables: dict[str, DataFrame], claimed: DataFrame | Column | None) -> DataFrame:
        raise NotImplementedError

    def claims(self) -> Column | None:
        """What the rule claims, as a condition on a live raw file's own columns; None
        if it depends on other files."""
        return None


class JunkRule(Rule):
    """Trash OS junk in raw; remove junk directories (raw) and empty ones (any store)."""

    name = RULE_JUNK
    priority = 0

    def claims(self) -> Column:
        return junk_file_reason("path").isNotNull()

    def file_ops(self, files: DataFrame, claimed: DataFrame | Column | None) -> DataFrame:
        cand = unclaimed(live_raw(files).select("id", "path"), claimed)
        hits = cand.withColumn("reason", junk_file_reason("path")).filter(F.col("reason").isNotNull())
        return _file_op(hits, self.name, self.priority, F.col("reason"),
                        F.concat(F.lit("0"), F.col("path")))

    def dir_ops(self, directories: DataFrame) -> DataFrame:
        d = directories.filter(~F.col("path").isin(".", ""))
        listed = F.coalesce(F.col("listed"), F.lit(True)) if "listed" in d.columns else F.lit(True)
        reason = F.coalesce(
            F.when(F.col("store") == "raw", junk_dir_reason("path")),
            F.when((F.col("file_count") == 0) & listed, F.lit("empty directory")))
        hits = d.withColumn("reason", reason).filter(F.col("reason").isNotNull())
        return S.conform(hits.select(
            (F.col("id") * 2 + 1).alias("op_id"), F.lit(KIND_RMDIR).alias("kind"),
            F.lit(None).cast("long").alias("file_id"), F.col("id").alias("dir_id"),
            F.col("store").alias("src_store"), F.col("path").alias("src_path"),
            F.lit(None).cast("string").alias("dst_store"), F.lit(None).cast("string").alias("dst_path"),
            F.lit(self.name).alias("rule"), "reason", F.lit(self.priority).alias("rule_priority"),
            F.concat(F.lit("1"), F.col("store"), F.lit("/"), F.col("path")).alias("plan_key")), S.OPS)

    def evaluate(self, tables, claimed):
        return self.file_ops(tables["files"], claimed).unionByName(self.dir_ops(tables["directories"]))


def dedup_keepers(cand: DataFrame) -> DataFrame:
    """Per hash, the id of the copy with the shortest path (ties: smallest path), and
    the number of copies.

    An aggregate rather than a window: partial aggregation collapses a hot hash
    (say, every empty file) before the shuffle, so no task holds a whole group.
    """
    return cand.groupBy("sha256").agg(
        F.min_by("id", F.struct(F.length("path"), F.col("path"))).alias("id"), F.count(F.lit(1)).alias("copies"))


class DedupRule(Rule):
    """Trash every live raw copy of a hash except the keeper (first unclaimed
    copy by ``length(path), path``)."""

    name = RULE_DEDUP
    priority = 1

    def evaluate(self, tables, claimed):
        cand = unclaimed(live_raw(tables["files"]).filter(F.col("sha256").isNotNull())
                         .select("id", "path", "sha256"), claimed)
        # only hashes held more than once have losers: they meet their copies by hash, salted,
        # and Spark's runtime filter on that side drops the other copies before the shuffle
        groups = dedup_keepers(cand).filter("copies > 1").select("sha256", F.col("id").alias("keeper"))
        losers = salted_join(cand, groups, "sha256").filter("id <> keeper").drop("keeper")
        key = F.concat(F.col("sha256"), F.lpad(F.length("path").cast("string"), 10, "0"), F.col("path"))
        return _file_op(losers, self.name, self.priority,
                        F.concat(F.lit("duplicate of "), F.substring("sha256", 1, 12)), key)


RULES: tuple[Rule, ...] = (JunkRule(), DedupRule())


def rule_by_name(name: str) -> Rule:
    for r in RULES:
        if r.name == name:
            return r
    raise KeyError(f"unknown rule {name!r}")


def build_plan(tables: dict[str, DataFrame], rules: Sequence[Rule | str] | None = None) -> DataFrame:
    """Run rules in priority order; each sees what was claimed before it.  As long as
    the earlier rules' claims are conditions on a row, they are filters on the scan;
    after that the earlier ops are evaluated once and joined by id."""
    chosen = [rule_by_name(r) if isinstance(r, str) else r for r in (rules or RULES)]
    ops: DataFrame | None = None
    condition: Column | None = None
    for i, rule in enumerate(chosen):
        if ops is None:
            claimed = None
        elif condition is not None:
            claimed = condition
        else:
            ops = ops.checkpoint()
            claimed = ops.filter(F.col("file_id").isNotNull()).select("file_id")
        out = rule.evaluate(tables, claimed)
        ops = out if ops is None else ops.unionByName(out)
        own = rule.claims()
        condition = None if own is None or (i and condition is None) else own if condition is None else condition | own
    if ops is None:
        return S.empty(tables["files"].sparkSession, S.OPS)
    return ops


def duplicate_hashes(files: DataFrame) -> DataFrame:
    """Hashes with more than one live raw copy, with the copy count."""
    return (live_raw(files).filter(F.col("sha256").isNotNull())
            .groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))
