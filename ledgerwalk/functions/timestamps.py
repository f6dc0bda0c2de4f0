"""Capture-time resolution and date-based destination paths.

All expressions are native; no Python runs per row.  Timestamps are
``TIMESTAMP_NTZ`` values holding UTC wall time.

Parsing is written as stages over an array of candidate structs
(``transform``): each stage reads fields of the previous stage's element, so
an intermediate value (trimmed text, offset split, date fields) is computed
once instead of being copied into every expression that uses it.
"""

from __future__ import annotations

from collections.abc import Callable
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (CAPTURE_TAG_PRIORITY, MOD_TIME_SOURCE, OFFSET_COMPANION_TAGS,
                         UNICODE_SPACE_CLASS, UNICODE_SPACES)
from .paths import _c, filename_parts, sanitize_basename, short_sha

DATE_RE = r"^(\d{4}):(\d{2}):(\d{2}) (\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?$"
OFFSET_RE = r"^([+-])(\d{2}):(\d{2})$"


def let(expr: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``expr`` once and use it (possibly many times) in ``body``."""
    return F.element_at(F.transform(F.array(expr), body), 1)


def validate_zone(zone: str | None) -> str:
    """Driver-side check: the zone must be a loadable IANA name (or UTC)."""
    if zone is None or zone.strip() == "":
        raise ValueError("organize requires a time zone (empty zone given)")
    if zone.rstrip() and __import__("re").fullmatch(r"[+-]\d{2}:\d{2}", zone):
        return zone  # fixed offset, accepted by Spark as a zone id
    try:
        ZoneInfo(zone)
    except Exception as exc:  # ZoneInfoNotFoundError, ValueError
        raise ValueError(f"invalid time zone {zone!r}: {exc}") from None
    return zone


# the characters of UNICODE_SPACE_CLASS, for a cheap first/last-character test
_SPACE_CHARS = [chr(c) for c in UNICODE_SPACES]


def trim_space(s: Column | str) -> Column:
    """Trim Unicode white space; the regex runs only when an end is white space."""
    x = _c(s)
    ends = F.substring(x, 1, 1).isin(*_SPACE_CHARS) | F.substring(x, -1, 1).isin(*_SPACE_CHARS)
    slow = F.regexp_replace(F.regexp_replace(x, "^" + UNICODE_SPACE_CLASS + "+", ""),
                            UNICODE_SPACE_CLASS + "+$", "")
    return F.when(ends, slow).otherwise(x)


def _offset_parts(x: Column) -> tuple[Column, Column]:
    n = F.length(x)
    tail = F.substring(x, -6, 6)
    has_z = x.endswith("Z")
    has_tail = (n >= 6) & F.substring(tail, 1, 1).isin("+", "-") & (F.substring(tail, 4, 1) == ":")
    offset = F.when(has_z, F.lit("+00:00")).when(has_tail, tail)
    rest = F.when(has_z, x.substr(F.lit(1), n - 1)).when(has_tail, x.substr(F.lit(1), n - 6)).otherwise(x)
    return offset, rest


def extract_offset(s: Column | str) -> Column:
    """struct(offset, rest): a trailing ``Z`` becomes ``+00:00``; a 6-char tail
    ``±??:??`` is split off; otherwise offset is NULL and rest is ``s``."""
    def body(x):
        offset, rest = _offset_parts(x)
        return F.struct(offset.alias("offset"), rest.alias("rest"))
    return let(_c(s), body)


def _offset_seconds(x: Column) -> Column:
    sign = F.when(F.substring(x, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    secs = sign * (F.substring(x, 2, 2).cast("int") * 3600 + F.substring(x, 5, 2).cast("int") * 60)
    return F.when(x.rlike(OFFSET_RE), secs)


def parse_offset(s: Column | str) -> Column:
    """``±HH:MM`` -> signed seconds east of UTC (no range check); NULL if malformed."""
    return let(_c(s), _offset_seconds)


def _shift(local: Column, offset_seconds: Column) -> Column:
    """local wall time at a fixed offset -> UTC wall time."""
    return local - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), offset_seconds.cast("decimal(18,6)"))


def _tag_schema() -> T.StructType:
    names = list(CAPTURE_TAG_PRIORITY) + list(OFFSET_COMPANION_TAGS.values())
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def compact_utc(ts: Column | str) -> Column:
    """``yyyyMMddTHHmmssZ`` of a UTC NTZ value (fraction dropped, zone-free)."""
    return F.concat(F.translate(F.substring(_c(ts).cast("string"), 1, 19), " -:", "T"), F.lit("Z"))


def rfc3339(ts: Column | str) -> Column:
    """RFC3339 UTC text with whole seconds, e.g. ``2024-01-01T00:00:00Z``."""
    return F.concat(F.replace(F.substring(_c(ts).cast("string"), 1, 19), F.lit(" "), F.lit("T")),
                    F.lit("Z"))


def destination_path(ts: Column | str, sha: Column | str, path: Column | str) -> Column:
    """``media/YYYY/MM/<yyyyMMddTHHmmssZ>-<sha8>-<base><lower ext>``."""
    def body(p: Column) -> Column:
        t = p["t"]
        return F.concat(
            F.lit("media/"), F.substring(t, 1, 4), F.lit("/"), F.substring(t, 6, 2), F.lit("/"),
            F.translate(F.substring(t, 1, 19), " -:", "T"), F.lit("Z-"), short_sha(p["sha"]), F.lit("-"),
            sanitize_basename(p["parts"]["base"]), F.lower(p["parts"]["ext"]))
    return let(F.struct(_c(ts).cast("string").alias("t"), _c(sha).alias("sha"),
                        filename_parts(path).alias("parts")), body)


# ------------------------------------------------------------------------
# Capture time: the first priority tag that is a non-empty string and parses,
# else ``mod_time``; staged projections (one column per tag and step).  Every intermediate is an
# attribute of the previous projection, so nothing is recomputed and the
# whole chain stays inside whole-stage code generation.
# ------------------------------------------------------------------------

_HOUR1 = r"^(\d{4}:\d{2}:\d{2} )(\d):"


_P = "_ct"  # prefix of the working columns


def _local_time(well_formed: Column, x: Column) -> Column:
    """The wall time of a date with a padded hour, so every field sits at a fixed position."""
    y, mo, d, h, mi = (F.substring(x, at, size).try_cast("int") for at, size in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2)))
    se, fr = F.substring(x, 18, 2), F.rpad(F.substring(x, 21, 6), 6, "0")
    ok = well_formed & mo.between(1, 12) & (h < 24) & (mi < 60) & (se.try_cast("int") < 60) & (d >= 1)
    return F.when(ok, F.try_make_timestamp_ntz(y, mo, d, h, mi, F.concat(se, F.lit("."), fr).try_cast("decimal(8,6)")))


def _to_utc(local: Column, embedded: Column, embedded_seconds: Column, hint_seconds: Column, zone: str | None) -> Column:
    by_zone = F.convert_timezone(F.lit(zone), F.lit("UTC"), local) if zone else F.lit(None).cast("timestamp_ntz")
    return (F.when(embedded.isNotNull(), F.when(embedded_seconds.isNotNull(), _shift(local, embedded_seconds)))
            .when(hint_seconds.isNotNull(), _shift(local, hint_seconds))
            .otherwise(by_zone))


def _parsed(df: DataFrame, pairs: list[tuple[Column, Column]], zone: str | None) -> DataFrame:
    """``df`` plus, for each (value, offset hint), a column ``_ct_t<i>``: the UTC time
    of the value (``YYYY:MM:DD HH:MM:SS[.frac][Z|±HH:MM]``) or NULL.  Offset
    precedence: embedded (a malformed one rejects the value) > valid hint (a
    malformed hint is ignored) > ``zone``."""
    n = range(len(pairs))
    col = lambda k, i: F.col(f"{_P}_{k}{i}")
    out = df.select("*", *[trim_space(v).alias(f"{_P}_s{i}") for i, (v, _) in enumerate(pairs)],
                    *[h.alias(f"{_P}_h{i}") for i, (_, h) in enumerate(pairs)])
    out = out.select("*", *[c.alias(f"{_P}_{k}{i}") for i in n for k, c in zip("er", _offset_parts(col("s", i)))])
    out = out.select("*", *[col("r", i).rlike(DATE_RE).alias(f"{_P}_ok{i}") for i in n],
                     *[F.regexp_replace(col("r", i), _HOUR1, "$10$2:").alias(f"{_P}_n{i}") for i in n])
    fields = [c for i in n for c in (_local_time(col("ok", i), col("n", i)).alias(f"{_P}_l{i}"),
                                    _offset_seconds(col("e", i)).alias(f"{_P}_es{i}"), _offset_seconds(col("h", i)).alias(f"{_P}_hs{i}"))]
    out = out.select("*", *fields)
    times = [F.when(col("s", i) != "", _to_utc(col("l", i), col("e", i), col("es", i), col("hs", i), zone)).alias(f"{_P}_t{i}") for i in n]
    return out.select("*", *times)


def _time_of(value: Column, hint: Column, zone: str | None) -> Column:
    """The same for one value as an expression, for the few rows that need it."""
    def parts(text: Column) -> Column:
        offset, rest = _offset_parts(text)
        return F.struct(offset.alias("e"), rest.alias("r"), F.regexp_replace(rest, _HOUR1, "$10$2:").alias("n"))

    def time(p: Column) -> Column:
        return let(_local_time(p["r"].rlike(DATE_RE), p["n"]), lambda local: _to_utc(local, p["e"], _offset_seconds(p["e"]), _offset_seconds(hint), zone))

    return let(trim_space(value), lambda text: F.when(text != "", let(parts(text), time)))


def _without_working_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(f"{_P}_")])


def with_exif_date(df: DataFrame, value: str, hint: str | None = None, zone: str | None = None, out: str = "ts") -> DataFrame:
    """``df`` plus ``out``: one EXIF-style date as a UTC ``TIMESTAMP_NTZ`` (NULL if
    unparseable)."""
    h = F.col(hint) if hint else F.lit(None).cast("string")
    return _without_working_columns(_parsed(df, [(F.col(value), h)], zone).withColumn(out, F.col(f"{_P}_t0")))


def with_capture_time(df: DataFrame, data: str = "data", mod_time: str = "mod_time", zone: str | None = None,
                      ts_col: str = "capture_ts", source_col: str = "source") -> DataFrame:
    """``df`` plus ``ts_col`` (UTC capture time) and ``source_col`` (tag name
    or ``files.mod_time``); both NULL when nothing parses."""
    tags = F.from_json(F.col(data), _tag_schema(), {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    none = F.lit(None).cast("string")
    tag = lambda name: F.col(f"{_P}_tags").getField(name)
    hints = [tag(OFFSET_COMPANION_TAGS[t]) if t in OFFSET_COMPANION_TAGS else none for t in CAPTURE_TAG_PRIORITY]
    filled = [F.when(tag(t) != "", tag(t)) for t in CAPTURE_TAG_PRIORITY]
    out = df.withColumn(f"{_P}_tags", tags)
    # the first tag that is there decides nearly every row: only it is parsed in the
    # staged projections; a row where it fails looks at the others one by one
    chosen = lambda values: F.coalesce(*[F.when(v.isNotNull(), x) for v, x in zip(filled, values)])
    out = out.withColumn(f"{_P}_first", chosen([F.lit(t) for t in CAPTURE_TAG_PRIORITY])).withColumn(f"{_P}_hint", chosen(hints))
    out = _parsed(out, [(F.coalesce(*filled), F.col(f"{_P}_hint"))], zone)
    rest = F.array(*[F.struct(v.alias("value"), h.alias("hint"), F.lit(t).alias("tag")) for v, h, t in zip(filled, hints, CAPTURE_TAG_PRIORITY)])
    parsed = F.transform(F.filter(rest, lambda x: x["value"].isNotNull()), lambda x: F.struct(_time_of(x["value"], x["hint"], zone).alias("t"), x["tag"].alias("tag")))
    next_one = F.try_element_at(F.filter(parsed, lambda x: x["t"].isNotNull()), F.lit(1))
    out = out.withColumn(f"{_P}_next", F.when(F.col(f"{_P}_t0").isNull() & F.col(f"{_P}_first").isNotNull(), next_one))
    first, following, mt = F.col(f"{_P}_t0"), F.col(f"{_P}_next"), F.col(mod_time).cast("timestamp_ntz")
    source = F.coalesce(F.when(first.isNotNull(), F.col(f"{_P}_first")), following["tag"], F.when(mt.isNotNull(), F.lit(MOD_TIME_SOURCE)))
    return _without_working_columns(out.withColumn(ts_col, F.coalesce(first, following["t"], mt)).withColumn(source_col, source))
