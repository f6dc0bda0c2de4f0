"""Media-tag policy: keep/drop rules, deterministic encoding, policy version.

Tag values are carried as *raw JSON text* (``map<string,string>`` whose values
are JSON fragments) so numbers such as ``1.50`` or ``1e5`` survive verbatim;
``from_json`` into a typed map would normalise them.
"""

from __future__ import annotations

import hashlib
import json
import re
from json.decoder import scanstring

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BINARY_PLACEHOLDER_PATTERN, EXCLUDED_TAG_GROUPS
from .paths import _c

_WS = re.compile(r"[ \t\n\r]*")
_DECODER = json.JSONDecoder()
# one member in the common form: a key without escapes, then a scalar value
# (string, number, true/false/null), then the separator that follows it
_MEMBER = re.compile(
    r'[ \t\n\r]*"([^"\\]*)"[ \t\n\r]*:[ \t\n\r]*'
    r'("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
    r'|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)'
    r'[ \t\n\r]*([,}])')


def _skip(s: str, i: int) -> int:
    return _WS.match(s, i).end()


def parse_raw_objects(text: str) -> list[dict[str, str] | None]:
    """Parse a JSON array of objects, keeping every member value as its raw
    source text.  Duplicate keys: the last wins.  ``null`` elements -> None.
    Raises ``ValueError`` on malformed input."""
    s = text
    i = _skip(s, 0)
    if i >= len(s) or s[i] != "[":
        raise ValueError("expected a JSON array")
    out: list[dict[str, str] | None] = []
    i = _skip(s, i + 1)
    if i < len(s) and s[i] == "]":
        return out
    while True:
        if s.startswith("null", i):
            out.append(None)
            i += 4
        elif i < len(s) and s[i] == "{":
            obj: dict[str, str] = {}
            i = _skip(s, i + 1)
            if i < len(s) and s[i] == "}":
                i += 1
            else:
                while True:
                    m = _MEMBER.match(s, i)
                    if m is not None:  # fast path: plain key, scalar value
                        obj[m.group(1)] = m.group(2)
                        i = m.end()
                        if m.group(3) == ",":
                            i = _skip(s, i)
                            continue
                        break
                    i = _skip(s, i)
                    if i >= len(s) or s[i] != '"':
                        raise ValueError(f"expected a key at {i}")
                    key, i = scanstring(s, i + 1)
                    i = _skip(s, i)
                    if i >= len(s) or s[i] != ":":
                        raise ValueError(f"expected ':' at {i}")
                    i = _skip(s, i + 1)
                    _, end = _DECODER.raw_decode(s, i)
                    obj[key] = s[i:end]
                    i = _skip(s, end)
                    if i < len(s) and s[i] == ",":
                        i = _skip(s, i + 1)
                        continue
                    if i < len(s) and s[i] == "}":
                        i += 1
                        break
                    raise ValueError(f"expected ',' or '}}' at {i}")
            out.append(obj)
        else:
            raise ValueError(f"expected an object at {i}")
        i = _skip(s, i)
        if i < len(s) and s[i] == ",":
            i = _skip(s, i + 1)
            continue
        if i < len(s) and s[i] == "]":
            i = _skip(s, i + 1)
            if i != len(s):
                raise ValueError("trailing data after array")
            return out
        raise ValueError(f"expected ',' or ']' at {i}")


def json_string_value(raw: str | None) -> str:
    """Decoded value when ``raw`` is a JSON string, else ``""``."""
    if raw is None or not raw.startswith('"'):
        return ""
    try:
        v = json.loads(raw)
    except ValueError:
        return ""
    return v if isinstance(v, str) else ""


def _decoded(v: Column) -> Column:
    """JSON string fragment -> its decoded text (NULL for non-strings)."""
    return F.when(v.startswith('"'),
                  F.element_at(F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>"), 1))


def _placeholder(v: Column) -> Column:
    """Whether a JSON fragment is the extractor's stand-in text.  The text needs no
    escapes, so the fragment itself is looked at; one with escapes is decoded."""
    plain = v.rlike(BINARY_PLACEHOLDER_PATTERN.replace("^", '^"', 1))
    return plain | F.when(v.startswith('"') & v.contains("\\"), F.coalesce(_decoded(v).rlike(BINARY_PLACEHOLDER_PATTERN), F.lit(False))).otherwise(F.lit(False))


def tag_keep(tags: Column | str) -> Column:
    """Drop ``SourceFile``/``Error`` keys, JSON nulls and binary placeholders."""
    return F.map_filter(_c(tags), lambda k, v: (~k.isin("SourceFile", "Error")) & (v != "null") & ~_placeholder(v))


def tag_group_exclude(tags: Column | str, groups: tuple[str, ...] = EXCLUDED_TAG_GROUPS) -> Column:
    """Drop tags of the excluded ``Group:`` prefixes."""
    return F.map_filter(
        _c(tags),
        lambda k, v: ~((F.instr(k, ":") > 0) & F.substring_index(k, ":", 1).isin(*groups)),
    )


def encode_tags(tags: Column | str) -> Column:
    """JSON object text with keys sorted and values verbatim; ``{}`` when empty."""
    m = _c(tags)
    quoted = lambda k: F.concat(F.lit('"'), k, F.lit('"'))
    key_json = lambda k: F.when(k.rlike(r'["\\\x00-\x1F]'), F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)).otherwise(quoted(k))
    members = F.transform(F.array_sort(F.map_entries(m)),
                          lambda e: F.concat(key_json(e["key"]), F.lit(":"), e["value"]))
    return F.when(m.isNull(), F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")))


def tags_version() -> str:
    """First 12 hex digits of SHA-256 over this package's tag policy."""
    policy = sorted([f"exclude-group:{g}" for g in EXCLUDED_TAG_GROUPS] + ["group-prefixed-names"])
    h = hashlib.sha256()
    for item in policy:
        h.update(item.encode())
        h.update(b"\0")
    h.update(BINARY_PLACEHOLDER_PATTERN.encode())
    return h.hexdigest()[:12]
