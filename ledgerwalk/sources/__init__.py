"""Sources and sinks: store listing, table versions, file bytes, extractor JSON."""

from .content import hash_files, read_heads, spread_by_bytes
from .exif_json import parse_tag_batches, read_tags
from .listing import list_stores
from .tables import empty_tables, manifest, read_tables, vacuum, write_tables

__all__ = ["hash_files", "read_heads", "spread_by_bytes", "parse_tag_batches", "read_tags", "list_stores",
           "empty_tables", "manifest", "read_tables", "vacuum", "write_tables"]
