"""Helpers shared by the operators of this subpackage.

Row identity: tables may repeat an id or hold a null one, so operators that
must come back to a document key it by its id *and* a hash of its text
(``with_key``).  Rows equal in both have equal texts, so they get equal
results whatever the join returns them to.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows of a side that may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


@contextmanager
def setting(spark: SparkSession, key: str, value: int | None) -> Iterator[None]:
    """Jobs started inside have ``value`` for ``key``."""
    before = spark.conf.get(key)
    spark.conf.set(key, str(value or before))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def batches_of(spark: SparkSession, rows: int | None):
    """Python functions of jobs started inside get at most ``rows`` rows at a time:
    what keeps a worker small where rows are long texts or sets."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def scan_batches(spark: SparkSession, rows: int):
    """The same for the Parquet reader of jobs started inside, whose columns of a batch
    are in the heap whole."""
    return setting(spark, "spark.sql.parquet.columnarReaderBatchSize", rows)


def stored(df: DataFrame, name: str, batch_rows: int | None = None, group_bytes: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, so a
    lost executor costs the tasks after this table only.  ``group_bytes``: of a row
    group, for rows so long that the usual count before its size is looked at is too much."""
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if group_bytes:
        writer = writer.options(**{"parquet.block.size": group_bytes, "parquet.block.size.row.check.min": 1,
                                   "parquet.page.size.row.check.min": 1})
    with batches_of(df.sparkSession, batch_rows):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows (counted
    here); otherwise unchanged, which leaves a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def carried(df: DataFrame) -> DataFrame:
    """``df`` as one column ``_row``: an operator's working columns, added beside
    it, cannot clash with the table's own.  ``_row.*`` brings the columns back."""
    return df.select(F.struct("*").alias("_row"))


def id_text(name: str) -> Column:
    """An id column as text, for its way through pandas (which would turn a column
    with nulls into floating point)."""
    return F.col(name).cast("string").alias(name)


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, every other character unchanged."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prefix_sums(a: Column, block: int = 256) -> Column:
    """Running totals of an array of numbers (element i: the sum of 0..i), as
    bigint.  Done in blocks so that a very long array costs n * block appends
    instead of n squared."""
    zero = F.array().cast("array<bigint>")

    def run(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda acc, x: F.concat(
            acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + x)))

    parts = F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / block).cast("int")),
                                              lambda g: run(F.slice(a, g * block + 1, F.lit(block)))))
    offsets = F.concat(F.array(F.lit(0).cast("bigint")), run(F.transform(parts, lambda p: F.element_at(p, -1))))
    summed = F.flatten(F.zip_with(parts, F.slice(offsets, F.lit(1), F.size(parts)),
                                  lambda p, o: F.transform(p, lambda x: x + o)))
    return F.coalesce(summed, zero)
