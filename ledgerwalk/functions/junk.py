"""Junk classification of file and directory paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import JUNK_DIR_NAMES, JUNK_FILE_NAMES, RESOURCE_FORK_PREFIX
from .paths import _c, basename, dirname


def _component_reason(dir_path: Column) -> Column:
    """``junk directory: <part>`` for the leftmost junk component, else NULL."""
    parts = F.split(dir_path, "/")
    names = F.array(*[F.lit(n) for n in JUNK_DIR_NAMES])
    hit = F.try_element_at(F.filter(parts, lambda c: F.array_contains(names, c)), F.lit(1))
    return F.when((dir_path == ".") | (dir_path == ""), F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit("junk directory: "), hit))


def junk_file_reason(path: Column | str) -> Column:
    """Reason a file is junk, or NULL.  Order: exact name, ``._`` prefix, directory."""
    p = _c(path)
    base = basename(p)
    return F.coalesce(
        F.when(base.isin(*JUNK_FILE_NAMES), F.concat(F.lit("junk file: "), base)),
        F.when(base.startswith(RESOURCE_FORK_PREFIX), F.lit("macOS resource fork")),
        _component_reason(dirname(p)),
    )


def junk_dir_reason(path: Column | str) -> Column:
    """Reason a directory is (or is under) a junk directory, or NULL."""
    return _component_reason(_c(path))
