"""Path and file-name expressions (all native Catalyst expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import UNICODE_SPACE_CLASS


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: Column | str) -> Column:
    """Last path component."""
    return F.element_at(F.split(_c(path), "/"), -1)


def dirname(path: Column | str) -> Column:
    """Parent directory of a relative path; ``.`` for a top-level entry."""
    p = _c(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit("."))


def path_depth(path: Column | str) -> Column:
    """0 for the store root (``.`` or empty), else number of components."""
    p = _c(path)
    return F.when((p == ".") | (p == ""), F.lit(0)).otherwise(F.size(F.split(p, "/"))).cast("long")


def ancestors(dir_path: Column | str) -> Column:
    """Array of the directory itself and every ancestor, ``.`` included."""
    d = _c(dir_path)
    parts = F.split(d, "/")
    chain = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, i), "/")),
    )
    return F.when((d == ".") | (d == ""), F.array(F.lit("."))).otherwise(chain)


_NAME_RE = r"^(?s)(.+?)(\.[^.]*)?$"


def filename_parts(path: Column | str) -> Column:
    """struct(base, ext): split the last component at its last dot.

    A name that is only a dot-prefixed word (``.hidden``) is all base.
    """
    name = basename(path)
    return F.struct(
        F.regexp_extract(name, _NAME_RE, 1).alias("base"),
        F.regexp_extract(name, _NAME_RE, 2).alias("ext"),
    )


def sanitize_basename(s: Column | str) -> Column:
    """Trim Unicode space, map separators and control bytes to ``_``, empty -> ``_``."""
    x = _c(s)
    trimmed = F.regexp_replace(
        F.regexp_replace(x, "^" + UNICODE_SPACE_CLASS + "+", ""),
        UNICODE_SPACE_CLASS + "+$", "")
    cleaned = F.regexp_replace(trimmed, r"[/\\\x00-\x1F\x7F]", "_")
    return F.when(trimmed == "", F.lit("_")).otherwise(cleaned)


def short_sha(h: Column | str) -> Column:
    """First 8 characters of a hash (the whole string when shorter)."""
    return F.substring(_c(h), 1, 8)


def join_path(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[_c(p) for p in parts])
