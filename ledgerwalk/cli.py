"""Command-line driver: ``python -m ledgerwalk <command> --catalogue DIR ...``.

Each command reads the current catalogue version, runs one job and writes
the next version (read-only commands write nothing).  Store roots are given
as ``--store raw=/path --store clean=/path --store trash=/path``.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from .constants import DEFAULT_MAX_STALENESS, STORES


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)


def parse_duration(text: str | None):
    """A sequence of decimal numbers with units, e.g. ``48h``, ``1.5h``, ``2h30m``,
    ``250ms`` (units h, m, s, ms, us, ns; a sign may lead; ``0`` alone is zero;
    empty -> default 48h)."""
    import re
    from datetime import timedelta
    from decimal import Decimal
    if not text:
        return DEFAULT_MAX_STALENESS
    units = {"h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1, "\u00b5s": 1, "\u03bcs": 1, "ns": Decimal("0.001")}
    body = text[1:] if text[0] in "+-" else text
    number = r"(?:\d+\.?\d*|\.\d+)"
    unit = "ns|us|\u00b5s|\u03bcs|ms|s|m|h"
    if body != "0" and not re.fullmatch(f"(?:{number}(?:{unit}))+", body):
        raise ValueError(f"invalid duration {text!r}")
    micros = sum((Decimal(n) * units[u] for n, u in re.findall(f"({number})({unit})", body)), Decimal(0))
    return timedelta(microseconds=int(-micros if text[0] == "-" else micros))


def _print_lines(lines) -> None:
    """Every line, in the order of the DataFrame, a partition at a time."""
    for r in lines.toLocalIterator():
        print(r.line)


def _stores(pairs: list[str]) -> dict[str, str]:
    out = {}
    for p in pairs or []:
        name, _, root = p.partition("=")
        if name not in STORES or not root:
            raise ValueError(f"--store expects one of {STORES} as name=path, got {p!r}")
        out[name] = root
    return out


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="ledgerwalk")
    ap.add_argument("--catalogue", required=True, help="versioned catalogue root (shared storage)")
    ap.add_argument("--store", action="append", default=[], help="name=root, repeatable")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("walk")
    p = sub.add_parser("reconcile")
    p.add_argument("--max-staleness", default="")
    sub.add_parser("sha256")
    sub.add_parser("mime")
    p = sub.add_parser("exif")
    p.add_argument("--extracted", help="directory of extractor JSON output")
    p.add_argument("--identify", action="store_true", help="stop after identifying candidates")
    p = sub.add_parser("plan")
    p.add_argument("--rule", action="append")
    p.add_argument("--out", help="write the ops table, in execution order by seq, here (Parquet)")
    p.add_argument("--report", help="write the whole report here (text) instead of printing it")
    p = sub.add_parser("process")
    p.add_argument("--ops", required=True)
    p.add_argument("--outcomes", required=True)
    p = sub.add_parser("organize")
    p.add_argument("--timezone", required=True)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--out", help="write the organise plan here (Parquet)")
    p = sub.add_parser("organize-apply")
    p.add_argument("--plan", required=True, help="organise plan written by `organize --out`")
    p.add_argument("--outcomes", required=True, help="Parquet (file_id, error, remove_error)")
    p.add_argument("--remove-originals", action="store_true")
    p = sub.add_parser("query")
    p.add_argument("sql", nargs="?")
    p.add_argument("--format", choices=["csv", "tsv"], default="tsv")
    p.add_argument("--no-header", action="store_true")
    p.add_argument("--out", help="write the whole result here (text) instead of printing it")
    p.add_argument("--preview", type=int, help="print the first N rows as an aligned table instead")
    sub.add_parser("status")
    p = sub.add_parser("vacuum")
    p.add_argument("--keep", type=int, default=10, help="versions that stay readable")
    a = ap.parse_args(argv)

    from . import operators as ops
    from .session import get_spark
    from .sources import hash_files, list_stores, read_tables, read_tags, spread_by_bytes, vacuum, write_tables
    spark = get_spark()
    base = read_tables(spark, a.catalogue)
    T = dict(base)
    stores = _stores(a.store)
    now = _now()

    if a.cmd == "walk":
        T, stats = ops.apply_walk(T, list_stores(spark, stores), now, list(stores))
        write_tables(T, a.catalogue, base=base)
        stats.show()
    elif a.cmd == "reconcile":
        marked = ops.reconcile_marked(T["files"], now, parse_duration(a.max_staleness))
        marked.show()
        T["files"] = ops.mark_missing(T["files"], now, parse_duration(a.max_staleness))
        write_tables(T, a.catalogue, base=base)
    elif a.cmd == "sha256":
        items = spread_by_bytes(ops.resolve_path(ops.needs_hash(T["files"]), stores))
        T = ops.apply_hashes(T, hash_files(items), now)
        write_tables(T, a.catalogue, base=base)
    elif a.cmd in ("mime", "exif"):
        if a.cmd == "mime":
            enricher = ops.MimeEnricher()
        else:
            if not a.identify and not a.extracted:
                raise SystemExit("exif needs --extracted (or --identify)")
            extracted = read_tags(spark, a.extracted) if a.extracted else spark.createDataFrame(
                [], "ordinal struct<doc:string,pos:bigint>, source_file string, error string, tags map<string,string>, parse_error string")
            enricher = ops.ExifEnricher(extracted)
        T, stats = ops.run_enricher(T, enricher, now, stores=stores, identify_only=getattr(a, "identify", False))
        write_tables(T, a.catalogue, base=base)
        stats.show()
    elif a.cmd == "plan":
        plan = ops.build_plan(T, a.rule)
        plan = plan.checkpoint()
        lines = ops.report_text(plan)
        if a.report:
            lines.write.mode("overwrite").text(a.report)
        else:
            _print_lines(lines)
        if a.out:
            ops.execution_sequence(plan).write.mode("overwrite").parquet(a.out)
    elif a.cmd == "process":
        plan = spark.read.parquet(a.ops)
        outcomes = spark.read.parquet(a.outcomes)
        T, stats = ops.apply_outcomes(T, plan, outcomes, now)
        write_tables(T, a.catalogue, base=base)
        stats.show()
    elif a.cmd == "organize":
        plan = ops.organize_plan(T, a.timezone, dry_run=a.dry_run)
        if a.out:
            from pyspark.sql import Observation
            counts = Observation()  # counted by the pass that writes
            plan.observe(counts, *ops.organize_counts()).write.mode("overwrite").parquet(a.out)
            spark.createDataFrame([counts.get]).select("considered", "organized", "skipped", "collided", "errors").show()
        else:
            ops.organize_stats(plan).show()
    elif a.cmd == "organize-apply":
        T = ops.apply_organize(T, spark.read.parquet(a.plan), spark.read.parquet(a.outcomes),
                               a.remove_originals, now)
        write_tables(T, a.catalogue, base=base)
    elif a.cmd == "query":
        text = a.sql if a.sql is not None else sys.stdin.read()
        df = ops.query(spark, T, text)
        if a.preview:
            df.show(a.preview, truncate=False)
        elif a.out:
            (ops.tsv_lines if a.format == "tsv" else ops.csv_lines)(df, not a.no_header).select("line") \
                .write.mode("overwrite").text(a.out)
        else:
            _print_lines((ops.tsv_lines if a.format == "tsv" else ops.csv_lines)(df, not a.no_header))
    elif a.cmd == "vacuum":
        print("removed versions:", ", ".join(map(str, vacuum(spark, a.catalogue, a.keep))) or "none")
    elif a.cmd == "status":
        ops.catalog_stats(T).show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
