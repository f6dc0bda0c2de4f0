"""Secret scan: three base patterns plus high-entropy runs.  [native]

Base kinds are regular expressions (``assign``, ``access``, ``hex``).  The
entropy kinds slide a window over every candidate run of one character class
(hexadecimal or base64) and keep the counts of the window's characters up to
date: a step takes one count down and one up, and the entropy changes by two
table look-ups.  Windows at or above the class threshold are merged into
spans.  Candidates that an allow-list pattern matches are suppressed; base
spans are never suppressed.

Every document is scanned by itself: there is no shuffle, so hot sources and
repeated rows cost nothing extra.  Null or empty texts have no spans.  Repeated
rows give one result each.  Positions are code points, ends exclusive.  Extra
columns of the input pass through; the operator's own columns are ``spans``
(or the name given as ``out``) only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, prefix_sums


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE_MIN = 6
#: Runs are maximal, so a minimum length in the pattern drops the same matches
#: as a filter after it.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"


@dataclass(frozen=True)
class EntropyClass:
    """One character class: runs of ``chars`` (after ``fold``) of at least
    ``window`` characters are candidates; windows of that length with at least
    ``threshold`` bits a character are kept."""

    kind: str
    pattern: str
    alphabet: str
    fold: bool
    window: int
    threshold: float


CLASSES = (
    EntropyClass("entropy_hex", r"[0-9A-Fa-f]{24,}", "0123456789abcdef", True, 24, 3.0),
    EntropyClass("entropy_base64", r"[A-Za-z0-9+/=_-]{24,}",
                 "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", False, 24, 4.0),
)
#: Candidates that are no secrets: plain words, plain numbers, sample values.
ALLOW = (r"^[A-Za-z]+$", r"^[0-9]+$", r"(?i)example|sample|placeholder|changeme")
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))
_SCALE = 1 << 20
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def plogp_table(window: int) -> list[int]:
    """round(c * log2(c) * 2^20) for c = 0..window; integers make the
    incremental sums exact and independent of the order of the steps."""
    return [0 if c == 0 else round(c * math.log2(c) * _SCALE) for c in range(window + 1)]


def plogp_limit(c: EntropyClass) -> int:
    """A window's entropy reaches the threshold if its sum is at most this."""
    return math.floor(c.window * (math.log2(c.window) - c.threshold) * _SCALE)


def hot_windows(candidate: Column, c: EntropyClass) -> Column:
    """Merged [start, end) offsets of the high-entropy windows of one candidate."""
    w, table = c.window, F.array(*[F.lit(v).cast("bigint") for v in plogp_table(c.window)])
    text = F.lower(candidate) if c.fold else candidate
    codes = F.transform(F.split(text, ""), lambda ch: F.instr(F.lit(c.alphabet), ch))
    run = "struct<start:bigint,end:bigint>"
    start = F.struct(F.array_repeat(F.lit(0), len(c.alphabet) + 1).alias("n"), F.lit(0).cast("bigint").alias("s"),
                     F.lit(None).cast(run).alias("cur"), F.array().cast(f"array<{run}>").alias("out"))

    def step(codes: Column, state: Column, i: Column) -> Column:
        inn = F.element_at(codes, i)
        full = i > w  # a character leaves the window
        old = F.when(full, F.element_at(codes, F.greatest(i - w, F.lit(1)))).otherwise(-1)
        n_in, n_old = F.element_at(state["n"], inn + 1), F.element_at(state["n"], F.greatest(old, F.lit(0)) + 1)
        same = inn == old
        counts = F.when(same, state["n"]).otherwise(F.transform(
            state["n"], lambda x, k: x + F.when(k == inn, 1).otherwise(0) - F.when(k == old, 1).otherwise(0)))
        gain = F.element_at(table, n_in + 2) - F.element_at(table, n_in + 1)
        loss = F.when(full, F.element_at(table, F.greatest(n_old, F.lit(1))) - F.element_at(table, n_old + 1)).otherwise(0)
        s = F.when(same, state["s"]).otherwise(state["s"] + gain + loss)
        hot = (i >= w) & (s <= plogp_limit(c))
        cur = state["cur"]
        joins = cur.isNotNull() & (cur["end"] >= i - w)
        new = F.struct(F.when(joins, cur["start"]).otherwise((i - w).cast("bigint")).alias("start"), i.cast("bigint").alias("end"))
        closed = F.when(cur.isNotNull(), F.array(cur)).otherwise(F.array().cast(f"array<{run}>"))
        return F.struct(counts.alias("n"), s.alias("s"), F.when(hot, new).otherwise(cur).alias("cur"),
                        F.when(hot & ~joins, F.concat(state["out"], closed)).otherwise(state["out"]).alias("out"))

    def finish(state: Column) -> Column:
        return F.when(state["cur"].isNotNull(), F.concat(state["out"], F.array(state["cur"]))).otherwise(state["out"])

    # bind the codes once: a lambda over a one-element array
    return F.element_at(F.transform(F.array(codes), lambda cs: F.aggregate(
        F.sequence(F.lit(1), F.size(cs)), start, lambda st, i: step(cs, st, i), finish)), 1)


def scan_secrets(df: DataFrame, text: str = "text", classes: Sequence[EntropyClass] = CLASSES,
                 allow: Sequence[str] = ALLOW, out: str = "spans") -> DataFrame:
    """``df`` with column ``out``: array of (start, kind, end) sorted by start,
    then kind, where kind indexes assign, access, hex and then ``classes``."""
    patterns = [ASSIGN, ACCESS, HEX, *(c.pattern for c in classes)]
    tmp = [f"m{i}" for i in range(len(patterns))]
    own = [c for c in df.columns if c.lower() != out.lower()]
    df = carried(df).withColumn("t", F.coalesce(F.col("_row")[text].cast("string"), F.lit("")))
    t = F.col("t")
    # matches, and the lengths of what stands before each: positions follow
    for name, p in zip(tmp, patterns):
        df = df.withColumn(name, F.when(t.rlike(p), F.struct(
            F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias("hit"),
            F.transform(F.split(t, p, -1), lambda x: F.char_length(x)).alias("gap"))))
    for i, name in enumerate(tmp):
        hit, gap = F.col(name)["hit"], F.col(name)["gap"]
        steps = F.zip_with(F.slice(gap, F.lit(1), F.size(hit)),
                           F.concat(F.array(F.lit(0)), F.slice(F.transform(hit, lambda x: F.char_length(x)), F.lit(1), F.size(hit) - 1)),
                           lambda g, before: (g + before).cast("bigint"))
        df = df.withColumn(f"{name}_at", F.when(F.col(name).isNotNull(), prefix_sums(steps)))
        both = F.arrays_zip(F.col(f"{name}_at").alias("at"), hit.alias("hit"))
        if i == 0:
            value = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
            both = F.transform(F.filter(F.arrays_zip(both.alias("m"), value.alias("v")),
                                        lambda x: F.char_length(x["v"]) >= ASSIGN_VALUE_MIN), lambda x: x["m"])
        kind = F.lit(i)
        if i < 3:
            spans = F.transform(both, lambda m: F.struct(
                m["at"].alias("start"), kind.alias("kind"), (m["at"] + F.char_length(m["hit"])).alias("end")))
        else:
            keep = F.filter(both, lambda m: ~m["hit"].rlike("|".join(f"(?:{a})" for a in allow))) if allow else both
            spans = F.flatten(F.transform(keep, lambda m: F.transform(hot_windows(m["hit"], classes[i - 3]), lambda r: F.struct(
                (m["at"] + r["start"]).alias("start"), kind.alias("kind"), (m["at"] + r["end"]).alias("end")))))
        df = df.withColumn(f"{name}_span", F.when(F.col(name).isNotNull(), spans).otherwise(F.array()).cast(_SPAN))
    return df.select(*[F.col("_row")[c].alias(c) for c in own],
                     F.array_sort(F.concat(*[F.col(f"{n}_span") for n in tmp])).alias(out))


def span_text(spans: Column, kinds: Sequence[str] = KINDS) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def secret_report(df: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base
    spans, and all spans as text."""
    found = scan_secrets(df.select("doc_id", F.col("text").alias("text")))
    base = F.filter("spans", lambda x: x["kind"] < 3)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
