"""Large JSON arrays in files, read by many tasks.

A file is cut into byte ranges, wherever those fall.  Whether a range starts
inside a string, and how deep, depends on all before it, but only through two
cases: each range is scanned once for both (``_scan_range``: its change of depth
and its top-level separators by relative depth), and a file's ranges are then put
one after another (``_chain``, one small row a range).  A second pass reads every
range from its first top-level separator to the first one behind its end, so each
element is read once and has its position in the whole array.

Files of one range skip the first pass.  Offsets are bytes; the structural
characters are ASCII, so UTF-8 sequences may be cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import open_file

RANGE_BYTES = 16 << 20
_CHUNK = 1 << 20
#: Elements handed to the parser together.
ELEMENTS = 2000
_RANGES = "path string, start long, stop long, size long"
_SCANNED = _RANGES + ", flips boolean, depth0 long, seps0 map<long,long>, depth1 long, seps1 map<long,long>"
_PLACED = _RANGES + ", inside boolean, depth long, ordinal long"
_QUOTE, _BACKSLASH = 34, 92
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_STRUCTURAL = _STEP != 0
_STRUCTURAL[ord(",")] = True


def file_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every file under ``path`` in ranges.  An empty file is one empty range."""
    files = spark.read.format("binaryFile").load(path).select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"))
    last = F.greatest(F.ceil(F.col("size") / range_bytes) - 1, F.lit(0))
    ranges = files.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    return ranges.select("path", (F.col("i") * range_bytes).alias("start"), F.least((F.col("i") + 1) * range_bytes, F.col("size")).alias("stop"), "size")


def _escaped_at(f, at: int) -> bool:
    """Whether the byte at ``at`` stands behind an odd number of backslashes."""
    run, back = 0, 64
    while at > 0:
        begin = max(0, at - back)
        f.seek(begin)
        held = f.read(at - begin)
        run = len(held) - len(held.rstrip(b"\\"))
        if run < len(held) or begin == 0:
            break
        back *= 2
    return run % 2 == 1


class _Scanner:
    """Structural characters of a stream of chunks, outside and inside of strings."""

    def __init__(self, inside: bool, escaped: bool):
        self.inside, self.escaped = inside, escaped

    def feed(self, chunk: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the structural characters, the characters, and whether each is in a string."""
        data = np.frombuffer(chunk, np.uint8)
        quotes = np.flatnonzero(data == _QUOTE)
        slashes = np.flatnonzero(data == _BACKSLASH)
        carried = self.escaped
        if len(slashes):
            # a backslash is itself escaped at every second place of its run
            new = np.concatenate(([True], np.diff(slashes) > 1))
            begin = slashes[new][np.cumsum(new) - 1]
            odd = (slashes - begin) % 2
            odd ^= ((begin == 0) & carried).astype(np.int64)
            after = slashes[odd == 0] + 1  # escaped bytes
            self.escaped = bool(len(after)) and int(after[-1]) == len(data)
            quotes = quotes[~np.isin(quotes, after)]
        else:
            self.escaped = False
        if carried and len(quotes) and quotes[0] == 0:
            quotes = quotes[1:]
        at = np.flatnonzero(_STRUCTURAL[data])
        inside = (np.searchsorted(quotes, at) % 2 == 1) ^ self.inside
        self.inside ^= len(quotes) % 2 == 1
        return at, data[at], inside


def _scan_range(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for path, start, stop, size in frame.itertuples(index=False):
            depth, seps = [0, 0], [{}, {}]
            with open_file(path) as f:
                scanner = _Scanner(False, _escaped_at(f, start))
                f.seek(start)
                left = stop - start
                while left > 0 and (chunk := f.read(min(_CHUNK, left))):
                    left -= len(chunk)
                    at, kind, inside = scanner.feed(chunk)
                    for case, mask in enumerate((~inside, inside)):
                        step = _STEP[kind[mask]]
                        before = depth[case] + np.cumsum(step) - step
                        # the array's own bracket stands one level above its commas
                        sep = np.where(kind[mask] == ord(","), before, np.where(kind[mask] == ord("["), before + 1, np.iinfo(np.int64).min))
                        level, count = np.unique(sep[sep > np.iinfo(np.int64).min], return_counts=True)
                        for k, n in zip(level.tolist(), count.tolist()):
                            seps[case][k] = seps[case].get(k, 0) + n
                        depth[case] += int(step.sum())
            out.append((path, start, stop, size, scanner.inside, depth[0], seps[0], depth[1], seps[1]))
        yield pd.DataFrame(out, columns=["path", "start", "stop", "size", "flips", "depth0", "seps0", "depth1", "seps1"])


def _chain(ranges: pd.DataFrame) -> pd.DataFrame:
    """State before each range of one file, from its ranges in order."""
    inside, depth, ordinal, out = False, 0, 0, []
    for r in ranges.sort_values("start").itertuples(index=False):
        out.append((r.path, r.start, r.stop, r.size, inside, depth, ordinal))
        seps = dict(r.seps1 if inside else r.seps0)
        # a bracket below the top is no separator of the array: only one at depth 0 counts, as 1
        ordinal += int(seps.get(1 - depth, 0))
        depth += int(r.depth1 if inside else r.depth0)
        inside ^= bool(r.flips)
    return pd.DataFrame(out, columns=["path", "start", "stop", "size", "inside", "depth", "ordinal"])


def placed_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges with whether they start in a string, how deep, and behind how many separators."""
    single = ranges.filter("start = 0 and stop = size").select("*", F.lit(False).alias("inside"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("ordinal"))
    many = ranges.filter("not (start = 0 and stop = size)").repartition("path", "start").mapInPandas(_scan_range, _SCANNED)
    return single.unionByName(many.groupBy("path").applyInPandas(_chain, _PLACED))


def _blank(part: bytes) -> bool:
    return not part.strip(b" \t\n\r")


def elements(path: str, start: int, stop: int, size: int, inside: bool, depth: int, ordinal: int) -> Iterator[tuple[int, str]]:
    """(position of the first, text of an array) of the elements whose separator, the
    array's bracket or a comma, stands in the range, ELEMENTS at a time.  ValueError
    where the array is not one; what follows it is looked at by the range of its end."""
    if depth == 0 and ordinal > 0:
        return  # behind the array
    opened, index, place = depth > 0, ordinal - 1, start
    held: bytearray | None = None  # the element being read, once its separator was met
    whole: list[bytes] = []

    def flush() -> Iterator[tuple[int, str]]:
        if whole:
            yield index - len(whole) + 1, "[" + b",".join(whole).decode("utf-8") + "]"
            whole.clear()

    with open_file(path) as f:
        scanner = _Scanner(inside, _escaped_at(f, start))
        f.seek(start)
        while (held is not None or place < stop) and (chunk := f.read(_CHUNK)):
            at, kind, in_string = scanner.feed(chunk)
            at, kind = at[~in_string], kind[~in_string]
            step = _STEP[kind]
            after = depth + np.cumsum(step)
            before = after - step
            event = (before == 0) | ((kind == ord(",")) & (before == 1)) | (after <= 0)
            begin = 0
            if not opened and not _blank(chunk[:int(at[0])] if len(at) else chunk):
                raise ValueError("expected a JSON array")
            for p, k, top in zip(at[event].tolist(), kind[event].tolist(), (before[event] == 0).tolist()):
                if top and (opened or k != ord("[")):
                    raise ValueError("expected ',' or ']'" if opened else "expected a JSON array")
                opened = True
                ends = not top and k != ord(",")
                if held is not None:
                    held += chunk[begin:p]
                    if not _blank(held):
                        whole.append(bytes(held))
                    elif index or not ends:
                        raise ValueError("expected an object")
                    if len(whole) >= ELEMENTS or ends or place + p >= stop:
                        yield from flush()
                if ends:
                    if k != ord("]"):
                        raise ValueError("expected ',' or ']'")
                    tail = chunk[p + 1:]
                    while tail:
                        if not _blank(tail):
                            raise ValueError("trailing data after array")
                        tail = f.read(_CHUNK)
                    return
                if place + p >= stop:
                    return
                held, begin, index = bytearray(), p + 1, index + 1
            if held is not None:
                held += chunk[begin:]
            depth = int(after[-1]) if len(after) else depth
            place += len(chunk)
    if held is not None or (not opened and stop == size):
        raise ValueError("expected ',' or ']'" if opened else "expected a JSON array")


def parsed(ranges: DataFrame, parse: Callable[[str], list], fields: dict[str, str], row: Callable[[object], tuple]) -> DataFrame:
    """(path, pos, <fields>, parse_error) of every element; of a file that does not parse
    only the first error, as one row."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "pos", *fields, "parse_error"]
        for frame in frames:
            for path, start, stop, size, inside, depth, ordinal in frame.itertuples(index=False):
                try:
                    for first, text in elements(path, start, stop, size, inside, depth, ordinal):
                        yield pd.DataFrame([(path, first + i, *row(x), None) for i, x in enumerate(parse(text))], columns=columns)
                except ValueError as exc:
                    yield pd.DataFrame([(path, ordinal, *[None] * len(fields), str(exc))], columns=columns)

    dealt = ranges.select("path", "start", "stop", "size", "inside", "depth", "ordinal").repartition("path", "start")
    schema = ", ".join(["path string", "pos long", *[f"{n} {t}" for n, t in fields.items()], "parse_error string"])
    rows = dealt.mapInPandas(run, schema).checkpoint()
    broken = rows.filter("parse_error is not null").groupBy("path").agg(F.min_by("parse_error", "pos").alias("parse_error"))
    whole = rows.filter("parse_error is null").join(broken.select("path"), "path", "left_anti")
    return whole.unionByName(broken.withColumn("pos", F.lit(0).cast("long")), allowMissingColumns=True)
