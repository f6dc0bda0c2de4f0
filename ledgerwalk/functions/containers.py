"""Walks over length-prefixed elements inside a binary column, and over a file.

EBML files hold elements (identifier, size, payload) and ISO media files boxes
(size, type, payload).  What tells their type may lie behind any amount of other
elements, so nothing is searched in a prefix: the walk goes from element to
element by their sizes.  The column form is native; the file form seeks and hands
on the few bytes that decide, so both give one answer.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from typing import BinaryIO

from pyspark.sql import Column
from pyspark.sql import functions as F

EBML_MARK, EBML_DOC_TYPE = b"\x1aE\xdf\xa3", b"\x42\x82"
#: Boxes that may stand before the one that tells the type.
ISO_PADDING = (b"free", b"skip", b"wide", b"pnot")
#: A file that starts with one of these has no type box: the older format.
ISO_UNTYPED = (b"moov", b"mdat")
ISO_STARTS = (b"ftyp", *ISO_PADDING, *ISO_UNTYPED)
#: Brands that decide, those that decide by compatibility first.
HEIC_BRANDS = (b"heic", b"heix", b"hevc", b"hevx", b"heim", b"heis")
HEIF_BRANDS = (b"mif1", b"msf1", b"heif")
QUICKTIME_BRANDS = (b"qt  ",)
#: Longer names are neither of the two document types that are told apart.
NAME_BYTES = 16


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` evaluated once."""
    return F.element_at(F.transform(F.array(c), f), 1)


def number_at(content: Column, offset: Column, size: int | Column) -> Column:
    """The big-endian number of ``size`` bytes at ``offset``; null beyond the end or 63 bits."""
    raw = F.hex(F.substring(content, (offset + 1).cast("int"), F.lit(size).cast("int") if isinstance(size, int) else size.cast("int")))
    return F.when(F.length(raw) == 2 * size, F.conv(raw, 16, 10).try_cast("bigint"))


def walk(start: Column, end: Column, step: Callable[[Column], Column]) -> Column:
    """``found`` of the first element that has it.  ``step`` takes the place of an element
    and gives struct(next bigint, found binary, done boolean).  Rounds double in
    length and stop when one is done, so the steps taken follow the number of
    elements, not the size of the content."""
    def state(at: Column, found: Column, done: Column) -> Column:
        return F.struct(at.cast("bigint").alias("at"), found.cast("binary").alias("found"), F.coalesce(done, F.lit(True)).alias("done"))

    def once(s: Column, _: Column) -> Column:
        moved = bound(step(s["at"]), lambda t: state(t["next"], t["found"], t["done"] | (t["next"] >= end) | (t["next"] <= s["at"])))
        return F.when(s["done"], s).otherwise(moved)

    def some(s: Column, i: Column) -> Column:
        return F.when(s["done"], s).otherwise(F.aggregate(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), i)), s, once))

    begin = state(start, F.lit(None), start >= end)
    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), begin, some)["found"]


def _vint_bytes(first: Column, most: int) -> Column:
    """Bytes of a variable-length number by its first one; null if it is none."""
    out = F.lit(None).cast("int")
    for n in range(most, 0, -1):
        out = F.when(first >= 1 << (8 - n), F.lit(n)).otherwise(out)
    return out


def _element(content: Column, at: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use(id length, payload's place, payload size)`` of the EBML element at ``at``; the
    size is -1 where it is unknown."""
    def sized(n: Column) -> Column:
        def payload(m: Column) -> Column:
            raw = number_at(content, at + n, m)
            marker = F.call_function("shiftleft", F.lit(1).cast("bigint"), (m * 7).cast("int"))
            size = F.when(raw == marker * 2 - 1, F.lit(-1).cast("bigint")).otherwise(raw - marker)
            return bound(size, lambda s: use(n, at + n + m, s))
        return bound(_vint_bytes(number_at(content, at + n, 1), 8), payload)
    return bound(_vint_bytes(number_at(content, at, 1), 4), sized)


def ebml_doc_type(content: Column) -> Column:
    """Hex of the DocType of an EBML file (at most NAME_BYTES), null without one."""
    total = F.length(content).cast("bigint")

    def child(end: Column) -> Callable[[Column], Column]:
        def step(at: Column) -> Column:
            def read(n: Column, place: Column, size: Column) -> Column:
                hit = (n == 2) & (F.substring(content, (at + 1).cast("int"), F.lit(2)) == F.lit(EBML_DOC_TYPE))
                name = F.substring(content, (place + 1).cast("int"), F.least(size, F.lit(NAME_BYTES)).cast("int"))
                return F.struct((place + F.greatest(size, F.lit(0))).alias("next"), F.when(hit, name).alias("found"), (hit | (size < 0)).alias("done"))
            return _element(content, at, read)
        return step

    def header(_: Column, place: Column, size: Column) -> Column:
        end = F.when(size < 0, total).otherwise(F.least(place + size, total))
        return bound(end, lambda e: walk(place, e, child(e)))

    after_mark = _element(content, F.lit(0).cast("bigint"), header)
    return bound(F.hex(after_mark), lambda h: F.regexp_replace(h, "(00)+$", ""))


def iso_brands(content: Column) -> Column:
    """Payload of the type box of an ISO media file: the major brand, a version, the
    compatible brands.  A file that starts without one has the brand of the older format."""
    total = F.length(content).cast("bigint")

    def step(at: Column) -> Column:
        kind = F.substring(content, (at + 5).cast("int"), F.lit(4))

        def box(size: Column) -> Column:
            head = F.when(size == 1, F.lit(16)).otherwise(F.lit(8))
            whole = F.when(size == 0, total - at).when(size == 1, number_at(content, at + 8, 8)).otherwise(size)

            def read(n: Column) -> Column:
                payload = F.substring(content, (at + head + 1).cast("int"), F.least(n - head, total).cast("int"))
                found = F.when(kind == F.lit(b"ftyp"), payload).when(kind.isin(*ISO_UNTYPED), F.lit(QUICKTIME_BRANDS[0]))
                return F.struct((at + n).alias("next"), found.alias("found"), (found.isNotNull() | ~kind.isin(*ISO_PADDING) | (n < head)).alias("done"))
            return bound(whole, read)
        return bound(number_at(content, at, 4), box)

    return walk(F.lit(0).cast("bigint"), total, step)


def compatible(brands: Column, wanted: tuple[bytes, ...]) -> Column:
    """Whether one of the compatible brands is among ``wanted``."""
    count = F.floor((F.length(brands) - 8) / 4)
    return F.when(count > 0, F.exists(F.sequence(F.lit(0), (count - 1).cast("int")),
                                      lambda i: F.substring(brands, i * 4 + 9, F.lit(4)).isin(*wanted))).otherwise(F.lit(False))


# ------------------------------------------------------------------ file form

def _vint(f: BinaryIO, most: int) -> tuple[bytes, int] | None:
    """A variable-length number as it stands, and its value (-1 where unknown)."""
    first = f.read(1)
    n = next((n for n in range(1, most + 1) if first and first[0] >= 1 << (8 - n)), None)
    raw = first + f.read(n - 1) if n else b""
    if not n or len(raw) < n:
        return None
    value = int.from_bytes(raw, "big") - (1 << 7 * n)
    return raw, -1 if value == (1 << 7 * n) - 1 else value


def ebml_head(f: BinaryIO) -> bytes:
    """The shortest EBML file with the DocType of ``f``."""
    end = f.seek(0, 2)
    f.seek(len(EBML_MARK))
    size = _vint(f, 8)
    if size and size[1] >= 0:
        end = min(end, f.tell() + size[1])
    while size and f.tell() < end:
        name = _vint(f, 4)
        held = _vint(f, 8) if name else None
        if held is None or held[1] < 0:
            break
        if name[0] == EBML_DOC_TYPE:
            value = f.read(min(held[1], NAME_BYTES))
            element = EBML_DOC_TYPE + bytes((0x80 | len(value),)) + value
            return EBML_MARK + bytes((0x80 | len(element),)) + element
        f.seek(min(f.tell() + held[1], end))
    return EBML_MARK + b"\x80"


def iso_head(f: BinaryIO, head: bytes, chunk: int = 1 << 20) -> bytes:
    """The shortest ISO media file of the type of ``f``: its type box with the compatible
    brands that decide, or ``head`` as it is where the walk meets no type."""
    at, end = 0, f.seek(0, 2)
    while True:
        if at >= end:
            return head
        f.seek(at)
        start = f.read(16)
        if len(start) < 8:
            return head
        size, kind = struct.unpack_from(">I4s", start)
        skip = 16 if size == 1 else 8
        if size == 1:
            if len(start) < 16:
                return head
            size = struct.unpack_from(">Q", start, 8)[0]
        if kind == b"ftyp":
            break
        if kind in ISO_UNTYPED:
            return struct.pack(">I4s", 8, kind)
        if kind not in ISO_PADDING or size < skip:
            return head
        at += size
    f.seek(at + skip)
    left = size - skip if size else None
    payload = f.read(8 if left is None else min(left, 8))
    left = None if left is None else left - len(payload)
    known, seen, rest = (*HEIC_BRANDS, *HEIF_BRANDS, *QUICKTIME_BRANDS), set(), b""
    while left is None or left > 0:
        part = f.read(chunk if left is None else min(chunk, left))
        if not part:
            break
        left = None if left is None else left - len(part)
        rest += part
        whole = len(rest) - len(rest) % 4
        seen.update(rest[i:i + 4] for i in range(0, whole, 4))
        seen.intersection_update(known)
        rest = rest[whole:]
    payload += b"".join(sorted(seen))
    return struct.pack(">I4s", 8 + len(payload), b"ftyp") + payload
