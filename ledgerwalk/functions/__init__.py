"""Scalar Column functions (native Catalyst expressions)."""

from .junk import junk_dir_reason, junk_file_reason
from .mime import sniff_mime, valid_mime
from .paths import (ancestors, basename, dirname, filename_parts, join_path, path_depth,
                    sanitize_basename, short_sha)
from .sizes import human_bytes, human_ibytes, register_sql_functions
from .tags import encode_tags, tag_group_exclude, tag_keep, tags_version
from .timestamps import (compact_utc, destination_path, extract_offset,
                         with_exif_date, parse_offset, rfc3339, validate_zone)

__all__ = [
    "junk_dir_reason", "junk_file_reason", "sniff_mime", "valid_mime", "ancestors", "basename",
    "dirname", "filename_parts", "join_path", "path_depth", "sanitize_basename", "short_sha",
    "human_bytes", "human_ibytes", "register_sql_functions", "encode_tags", "tag_group_exclude",
    "tag_keep", "tags_version", "compact_utc", "destination_path",
    "extract_offset", "with_exif_date", "parse_offset", "rfc3339", "validate_zone",
]
