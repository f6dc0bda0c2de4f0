"""Table jobs: each takes DataFrames (and a fixed ``now``) and returns DataFrames."""

from .catalog import (apply_walk, catalog_stats, directory_rollup, mark_missing, reconcile_marked,
                      stale_directories, upsert_directories, upsert_files, walk_stats)
from .enrich import (ExifEnricher, MimeEnricher, apply_enrichment, identify_all_hashes,
                     identify_by_mime, lowest_live_copy, match_tags, pending_items, reset_stale,
                     resolve_path, run_enricher, work_stats)
from .hashing import apply_hashes, hash_content, needs_hash
from .ids import next_id, with_dense_ids
from .logs import appended
from .organize import apply_organize, organize_candidates, organize_counts, organize_plan, organize_stats
from .plan import apply_outcomes, execution_order, execution_sequence, execution_stats, plan_report, report_text
from .rules import (RULES, DedupRule, JunkRule, build_plan, dedup_keepers, duplicate_hashes,
                    live_raw, rule_by_name)
from .sqlapi import align_schema, csv_lines, query, register_tables, tsv_lines, write_csv, write_tsv

__all__ = [n for n in dir() if not n.startswith("_")]
