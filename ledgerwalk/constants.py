"""Fixed values.

Everything in the block below must equal the values of the tool whose
behaviour this package reproduces, or rule output, capture times and
destination paths change.  They are listed plainly, in natural order.
"""

from __future__ import annotations

from datetime import timedelta

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference behaviour exactly)
# ---------------------------------------------------------------------------

STORES = ("raw", "clean", "trash")

JUNK_FILE_NAMES = (
    ".DS_Store",
    ".AppleDouble",
    ".AppleDesktop",
    ".LSOverride",
    ".localized",
    "Thumbs.db",
    "Thumbs.db:encryptable",
    "ehthumbs.db",
    "ehthumbs_vista.db",
    "desktop.ini",
)
RESOURCE_FORK_PREFIX = "._"

JUNK_DIR_NAMES = (
    "@eaDir",
    ".Spotlight-V100",
    ".Trashes",
    ".TemporaryItems",
    ".fseventsd",
    ".DocumentRevisions-V100",
    "__MACOSX",
)

MEDIA_MIME_TYPES = (
    "image/jpeg",
    "image/heic",
    "image/heif",
    "image/tiff",
    "image/png",
    "image/webp",
    "image/gif",
    "image/x-canon-cr2",
    "image/x-nikon-nef",
    "image/x-sony-arw",
    "image/x-adobe-dng",
    "video/mp4",
    "video/quicktime",
    "video/x-msvideo",
    "video/x-matroska",
    "video/webm",
    "video/x-m4v",
    "video/mpeg",
    "video/3gpp",
)

CAPTURE_TAG_PRIORITY = (
    "Composite:SubSecDateTimeOriginal",
    "EXIF:DateTimeOriginal",
    "EXIF:CreateDate",
    "QuickTime:CreateDate",
    "XMP:CreateDate",
    "RIFF:DateTimeOriginal",
)

OFFSET_COMPANION_TAGS = {
    "EXIF:DateTimeOriginal": "EXIF:OffsetTimeOriginal",
    "EXIF:CreateDate": "EXIF:OffsetTime",
}

MOD_TIME_SOURCE = "files.mod_time"

DEFAULT_MAX_STALENESS = timedelta(hours=48)

# Tag extraction policy: groups that do not describe content, and the
# extractor's stand-in text for binary values.
EXCLUDED_TAG_GROUPS = ("System", "File", "ExifTool")
BINARY_PLACEHOLDER_PATTERN = r"^\(Binary data \d+ bytes"

# Unit names of the two human-readable size formats.
SI_UNITS = ("B", "kB", "MB", "GB", "TB", "PB", "EB")
IEC_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")

# Operation kinds and rule names.
KIND_CLEAN = "CLEAN"
KIND_TRASH = "TRASH"
KIND_RMDIR = "RMDIR"
RULE_JUNK = "junk"
RULE_DEDUP = "dedup"
RULE_ORGANIZE = "organize"

# Statuses of organise candidates, and the error of one without a time.
STATUS_ERROR = "error"
STATUS_SKIPPED = "skipped"
STATUS_COLLIDED = "collided"
STATUS_ORGANIZED = "organized"
STATUS_ORGANIZE = "organize"
NO_TIMESTAMP = "no usable timestamp (exif + mod_time both unparseable)"

# Lines of the plan report.
REPORT_RULE = "Rule: %s (%d ops)"
REPORT_REMOVAL = "  %s  %s/%s  (%s)"
REPORT_MOVE = "  %s  %s/%s -> %s/%s  (%s)"
REPORT_EMPTY = "No operations proposed."

# Declared columns: what names and types must look like.
COLUMN_NAME_PATTERN = r"^[a-zA-Z_][a-zA-Z0-9_]*$"
COLUMN_TYPE_PATTERN = r"^[a-zA-Z]+$"

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------

# Unicode white space, by code point, and as a regex class that both Java regex
# and RE2 (DuckDB) accept.
UNICODE_SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                  0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
UNICODE_SPACE_CLASS = "[" + "".join(f"\\x{{{c:X}}}" for c in UNICODE_SPACES) + "]"
