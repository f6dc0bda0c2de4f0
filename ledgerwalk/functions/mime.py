"""Content-type classification (native expressions).

This replaces an external per-file detector with a signature table over the
leading bytes, the DocType of EBML files, the brands of ISO media files and the
first directory of TIFF files, wherever those lie (``containers`` walks to them):
the media types the organiser accepts, PDF, empty files and a UTF-8 text fallback.
It is not a full magic database.

An ISO media file is what its major brand says; where that is a general one, a
compatible brand of an image or of QuickTime decides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .containers import HEIC_BRANDS, HEIF_BRANDS, ISO_STARTS, QUICKTIME_BRANDS, compatible, ebml_doc_type, iso_brands
from .containers import bound as _bind
from .paths import _c
from .timestamps import trim_space

# Bytes that make content "binary" for the text fallback (NUL and C0
# controls other than TAB LF VT FF CR ESC, plus DEL).
TIFF_MAKE, TIFF_DNG_VERSION = 0x010F, 0xC612
TEXT_CONTROL_RE = r"[\x00-\x08\x0E-\x1A\x1C-\x1F\x7F]"


def _unsigned(h: Column, offset: Column, size: int, little: Column) -> Column:
    """The ``size``-byte number at byte ``offset`` of hex text ``h``."""
    big = [F.substring(h, offset * 2 + 1 + 2 * i, F.lit(2)) for i in range(size)]
    return F.conv(F.when(little, F.concat(*big[::-1])).otherwise(F.concat(*big)), 16, 10).cast("bigint")


def _tiff_type(c: Column) -> Column:
    """TIFF container: the camera formats that share it are told apart by the
    entries of the first directory (Make and DNGVersion), wherever it lies."""
    def of(x: Column) -> Column:
        head = F.hex(F.substring(x, 1, 8))
        little = head.startswith("4949")
        first = _unsigned(head, F.lit(4), 4, little)
        at = F.when((F.length(x) >= 8) & (F.length(x) >= first + 2), first).otherwise(F.length(x)).cast("int")
        count = F.coalesce(_unsigned(F.hex(F.substring(x, at + 1, F.lit(2))), F.lit(0), 2, little), F.lit(0))

        def text(e: Column) -> Column:
            offset = _unsigned(e, F.lit(8), 4, little)
            far = F.hex(F.substring(x, F.least(offset, F.length(x)).cast("int") + 1, F.lit(5)))
            return F.when(_unsigned(e, F.lit(4), 4, little) > 4, far).otherwise(F.substring(e, 17, 8))

        def by_entries(d: Column) -> Column:
            n = F.floor(F.length(d) / 24)
            entries = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.substring(d, (i * 24 + 1).cast("int"), F.lit(24)))) \
                .otherwise(F.array().cast("array<string>"))
            dng = F.exists(entries, lambda e: _unsigned(e, F.lit(0), 2, little) == TIFF_DNG_VERSION)
            made = F.filter(entries, lambda e: _unsigned(e, F.lit(0), 2, little) == TIFF_MAKE)
            make = F.element_at(F.concat(F.transform(made, text), F.array(F.lit(""))), 1)
            return (F.when(dng, F.lit("image/x-adobe-dng"))
                    .when(make.startswith(_hex("NIKON")), F.lit("image/x-nikon-nef"))
                    .when(make.startswith(_hex("SONY")), F.lit("image/x-sony-arw"))
                    .otherwise(F.lit("image/tiff")))

        return _bind(F.hex(F.substring(x, at + 3, (count * 12).cast("int"))), by_entries)

    return _bind(c, of)


def _hex(s: str) -> str:
    return s.encode("latin-1").hex().upper()


def _iso_type(c: Column) -> Column:
    def of(brands: Column) -> Column:
        major = F.substring(brands, 1, 4)
        return (F.when(major.isin(*HEIC_BRANDS), F.lit("image/heic"))
                .when(major.isin(*HEIF_BRANDS), F.lit("image/heif"))
                .when(major.isin(*QUICKTIME_BRANDS), F.lit("video/quicktime"))
                .when(F.substring(major, 1, 3) == F.lit(b"M4V"), F.lit("video/x-m4v"))
                .when(F.substring(major, 1, 3).isin(b"3gp", b"3g2"), F.lit("video/3gpp"))
                .when(compatible(brands, HEIC_BRANDS), F.lit("image/heic"))
                .when(compatible(brands, HEIF_BRANDS), F.lit("image/heif"))
                .when(compatible(brands, QUICKTIME_BRANDS), F.lit("video/quicktime"))
                .when(brands.isNotNull(), F.lit("video/mp4")))

    return _bind(iso_brands(c), of)


def sniff_mime(content: Column | str, is_text: Column | None = None) -> Column:
    """MIME type of a binary ``content`` column.  ``is_text`` is the text test of
    the whole content where ``content`` is only its head (as ``read_heads`` gives
    it); without it the test is made here."""
    c = _c(content)
    h = F.hex(F.substring(c, 1, 16))          # upper-case hex of 16 leading bytes
    brand = F.substring(h, 17, 8)             # bytes 9..12
    b = _hex
    kind = F.substring(h, 9, 8)
    # a box that is not the type box is believed if its size is a possible one
    box = (kind == b("ftyp")) | (kind.isin(*[x.hex().upper() for x in ISO_STARTS]) & h.startswith("00"))
    if is_text is None:
        as_text = c.cast("string")
        is_text = F.is_valid_utf8(as_text) & ~as_text.rlike(TEXT_CONTROL_RE)
    by_start = (
        F.when(F.length(c) == 0, F.lit("inode/x-empty"))
        .when(h.startswith("FFD8FF"), F.lit("image/jpeg"))
        .when(h.startswith("89504E470D0A1A0A"), F.lit("image/png"))
        .when(h.startswith(b("GIF87a")) | h.startswith(b("GIF89a")), F.lit("image/gif"))
        .when(h.startswith(b("%PDF-")), F.lit("application/pdf"))
        .when(h.startswith(b("RIFF")) & (brand == b("WEBP")), F.lit("image/webp"))
        .when(h.startswith(b("RIFF")) & (brand == b("AVI ")), F.lit("video/x-msvideo"))
        .when(h.startswith("1A45DFA3"),
              F.when(ebml_doc_type(c) == b("webm"), F.lit("video/webm")).otherwise(F.lit("video/x-matroska")))
    )
    by_rest = (
        F.when(h.startswith("49492A00") | h.startswith("4D4D002A"),
               F.when(F.substring(h, 17, 4) == b("CR"), F.lit("image/x-canon-cr2")).otherwise(_tiff_type(c)))
        .when(h.startswith("000001BA") | h.startswith("000001B3"), F.lit("video/mpeg"))
        .when(is_text, F.lit("text/plain"))
        .otherwise(F.lit("application/octet-stream"))
    )
    return F.when(c.isNotNull(), F.coalesce(by_start, F.when(box, _iso_type(c)), by_rest))


def valid_mime(raw: Column | str, path: Column | str) -> Column:
    """struct(mime_type, error): detector output without ``/`` is an error."""
    def of(t: Column) -> Column:
        ok = F.instr(t, "/") > 0
        return F.struct(
            F.when(ok, t).alias("mime_type"),
            F.when(~ok, F.concat(F.lit("detecting mime for "), _c(path), F.lit(": "), t)).alias("error"),
        )

    return _bind(_c(raw), lambda r: _bind(trim_space(r), of))
