"""Reading file bytes on executors (Arrow batches, streamed in chunks)."""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.containers import EBML_MARK, ISO_STARTS, ebml_head, iso_head
from ..functions.mime import TEXT_CONTROL_RE, TIFF_DNG_VERSION, TIFF_MAKE
from ..session import ensure_checkpoint_dir, ship_package
from .storage import open_file

_CHUNK = 1 << 20


def _hash_file(path: str) -> tuple[str | None, str | None]:
    h = hashlib.sha256()
    try:
        with open_file(path) as f:
            while True:
                b = f.read(_CHUNK)
                if not b:
                    break
                h.update(b)
    except OSError as exc:
        return None, f"hashing {path}: {exc.strerror or exc}"
    return h.hexdigest(), None


def hash_files(items: DataFrame, path_col: str = "abs_path") -> DataFrame:
    """(id, sha256, error) for items whose bytes live at ``path_col``; whole
    files are streamed, never loaded at once."""
    ship_package(items.sparkSession)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("sha256", T.StringType()),
                           T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_pylist()
            out = [_hash_file(p) for p in b.column(path_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([o[0] for o in out], pa.string()),
                 pa.array([o[1] for o in out], pa.string())], schema=pa.schema(
                    [("id", pa.int64()), ("sha256", pa.string()), ("error", pa.string())]))

    return items.select("id", path_col).mapInArrow(run, schema)


HEAD_BYTES = 32  # signatures at fixed places lie in here; containers are walked
_TEXT_CONTROL = re.compile(TEXT_CONTROL_RE.encode("latin-1"))


def _tiff_head(f: BinaryIO, head: bytes) -> bytes:
    """The head of a TIFF file with those entries of its first directory, wherever that
    lies, that tell its type: they follow the first 16 bytes, then the maker's text."""
    order = "<" if head[:2] == b"II" else ">"
    f.seek(struct.unpack_from(order + "I", head, 4)[0])
    raw = f.read(2)
    directory = f.read(12 * struct.unpack(order + "H", raw)[0]) if len(raw) == 2 else b""
    entries = [directory[i:i + 12] for i in range(0, len(directory) - 11, 12)]
    kept, text = [], b""
    for tag in (TIFF_MAKE, TIFF_DNG_VERSION):
        kept += [e for e in entries if struct.unpack_from(order + "H", e)[0] == tag][:1]
    at = 16 + 2 + 12 * len(kept)
    for i, e in enumerate(kept):
        tag, kind, size, offset = struct.unpack(order + "HHII", e)
        if tag == TIFF_MAKE and size > 4:
            f.seek(offset)
            text = f.read(min(size, 64))
            kept[i] = struct.pack(order + "HHII", tag, kind, size, at)
    return head[:4] + struct.pack(order + "I", 16) + head[8:16].ljust(8, b"\0") + struct.pack(order + "H", len(kept)) + b"".join(kept) + text


def _head_and_text(path: str) -> tuple[bytes | None, bool | None]:
    """The head of a file, and whether all of it is text: valid UTF-8 without
    control bytes, decoded chunk by chunk to the end."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    head, text = b"", True
    try:
        with open_file(path) as f:
            while text or len(head) < HEAD_BYTES:
                b = f.read(_CHUNK)
                if len(head) < HEAD_BYTES:
                    head += b[:HEAD_BYTES - len(head)]
                try:
                    decoder.decode(b, final=not b)
                    text = text and not _TEXT_CONTROL.search(b)
                except UnicodeDecodeError:
                    text = False
                if not b:
                    break
            if head[:4] in (b"II*\0", b"MM\0*") and len(head) >= 8:
                head = _tiff_head(f, head)
            elif head[:4] == EBML_MARK:
                head = ebml_head(f)
            elif head[4:8] in ISO_STARTS:
                head = iso_head(f, head)
    except OSError:
        return None, None
    return head, text


def read_heads(items: DataFrame, path_col: str = "abs_path") -> DataFrame:
    """items + ``head`` (the first ``HEAD_BYTES`` bytes of each file, of TIFF, EBML and
    ISO media files what tells their type; NULL when unreadable) and ``is_text`` (a test of the whole file)."""
    ship_package(items.sparkSession)
    schema = T.StructType(list(items.schema.fields) + [T.StructField("head", T.BinaryType()), T.StructField("is_text", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [_head_and_text(p) for p in b.column(path_col).to_pylist()]
            b = b.append_column("head", pa.array([h for h, _ in data], pa.binary()))
            yield b.append_column("is_text", pa.array([t for _, t in data], pa.bool_()))

    return items.mapInArrow(run, schema)


#: What opening a file costs, in bytes read.
OPEN_BYTES = 1 << 16


def spread_by_bytes(items: DataFrame, size_col: str = "size", bytes_per_task: int = 1 << 30) -> DataFrame:
    """``items`` dealt so that a task reads about ``bytes_per_task``: files stand in one
    row, each as long as its bytes and OPEN_BYTES more, and the row is cut every
    ``bytes_per_task``; a file goes where it starts.  So a task has at most that and
    one file more, whatever the sizes.

    The row is never laid out in one task: rows keep their partition (a reliable
    checkpoint fixes it), the partitions' sums, one number each, are added up on the
    driver, and every partition counts on from its own.  A null or negative size
    counts as 0."""
    spark = items.sparkSession
    ensure_checkpoint_dir(spark)
    cost = F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint") + OPEN_BYTES
    staged = items.withColumn("_lw_part", F.spark_partition_id()).withColumn("_lw_cost", cost).checkpoint(eager=True)
    sums = sorted((r["_lw_part"], r["n"]) for r in staged.groupBy("_lw_part").agg(F.sum("_lw_cost").alias("n")).collect())
    before, total = {}, 0
    for part, n in sums:
        before[part] = total
        total += n
    least = max(1, -(-total // spark.sparkContext.defaultParallelism))
    width = min(bytes_per_task, least)  # small work still goes to every core
    tasks = max(1, -(-total // width))
    schema = T.StructType([f for f in staged.schema.fields if f.name not in ("_lw_part", "_lw_cost")] + [T.StructField("_lw_task", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = None
        for b in batches:
            if not b.num_rows:
                continue
            n = len(b.schema) - 2
            if ahead is None:
                ahead = before[b.column(n)[0].as_py()]
            ends = np.cumsum(b.column(n + 1).to_numpy()) + ahead
            starts = ends - b.column(n + 1).to_numpy()
            ahead = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array((starts // width).astype(np.int32))], names=schema.names)

    return staged.mapInArrow(place, schema).repartitionById(tasks, "_lw_task").drop("_lw_task")
