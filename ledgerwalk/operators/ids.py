"""Dense ids for appended rows: ``start + row_number() over (order by keys)``.

A global ``row_number`` window runs in one task.  Instead the rows are
range-partitioned and sorted by the keys, the layout is fixed with a reliable
checkpoint, per-partition counts (one row per partition, so a bounded result)
give each partition its offset, and one Arrow pass numbers the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

_PART = "_lw_part"


def next_id(df: DataFrame, col: str = "id") -> int:
    """1 + max(col) (1 for an empty table): a one-row aggregate."""
    row = df.agg(F.max(col).alias("m")).first()
    return (row["m"] or 0) + 1


def with_dense_ids(df: DataFrame, order_cols: Sequence[str | Column], start: int | None = None,
                   id_col: str = "id", after: DataFrame | None = None, after_col: str = "id") -> DataFrame:
    """Number ``df`` from ``start`` (or from ``max(after.after_col) + 1``) in key order."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    staged = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn(_PART, F.spark_partition_id()))
    staged = staged.checkpoint(eager=True)
    sizes = staged.groupBy(_PART).agg(F.count(F.lit(1)).alias("n"))
    if after is not None:
        # the existing table's max id rides along in the same (bounded) collect
        sizes = sizes.unionByName(after.agg(F.lit(-1).alias(_PART), F.max(after_col).cast("long").alias("n")))
    rows = sizes.collect()
    if after is not None:
        top = [r["n"] for r in rows if r[_PART] == -1]
        start = (top[0] or 0) + 1 if top and top[0] is not None else 1
    counts = sorted((r[_PART], r["n"]) for r in rows if r[_PART] != -1)
    offsets, acc = {}, (1 if start is None else start)
    for part, n in counts:
        offsets[part] = acc
        acc += n

    out_schema = T.StructType(list(staged.schema.fields) + [T.StructField(id_col, T.LongType(), False)])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = 0
        for b in batches:
            if b.num_rows == 0:
                yield b.append_column(id_col, pa.array([], pa.int64()))
                continue
            base = offsets[b.column(_PART)[0].as_py()]
            ids = pa.array(np.arange(pos, pos + b.num_rows, dtype=np.int64) + base)
            pos += b.num_rows
            yield b.append_column(id_col, ids)

    numbered = staged.mapInArrow(number, out_schema).drop(_PART)
    return numbered.select(id_col, *[c for c in df.columns if c != id_col])
