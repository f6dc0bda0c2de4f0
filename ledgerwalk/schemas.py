"""Table schemas of the catalogue (explicit, never inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LONG = T.LongType()
STR = T.StringType()
TS = T.TimestampNTZType()
BOOL = T.BooleanType()
INT = T.IntegerType()


def _s(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


FILES = _s(
    ("id", LONG, False), ("store", STR, False), ("path", STR, False),
    ("size", LONG, False), ("mod_time", TS, False), ("found_at", TS, False),
    ("reconciled_at", TS, False), ("missing", BOOL, False),
    ("sha256", STR, True), ("hashed_at", TS, True),
)

DIRECTORIES = _s(
    ("id", LONG, False), ("store", STR, False), ("path", STR, False),
    ("file_count", LONG, False), ("total_size", LONG, False),
    # false when the directory was seen but could not be read (see README)
    ("listed", BOOL, True),
)

OPERATIONS = _s(
    ("id", LONG, False), ("file_id", LONG, True), ("dir_id", LONG, True),
    ("src_store", STR, False), ("src_path", STR, False),
    ("dst_store", STR, True), ("dst_path", STR, True),
    ("rule", STR, False), ("reason", STR, True), ("executed_at", TS, False),
)

PROCESS_ERRORS = _s(
    ("id", LONG, False), ("file_id", LONG, True), ("dir_id", LONG, True),
    ("enricher", STR, True), ("rule", STR, True), ("error", STR, False),
    ("occurred_at", TS, False),
)

ENRICHER_BASE = _s(("hash", STR, False), ("file_id", LONG, False), ("processed_at", TS, True))

MIME_COLUMNS = _s(("mime_type", STR, True))
EXIF_COLUMNS = _s(("data", STR, True), ("tags_version", STR, True))

LISTING = _s(
    ("store", STR, False), ("path", STR, False), ("is_dir", BOOL, False),
    ("size", LONG, True), ("mod_time", TS, True), ("listed", BOOL, False),
)

OPS = _s(
    ("op_id", LONG, False), ("kind", STR, False), ("file_id", LONG, True),
    ("dir_id", LONG, True), ("src_store", STR, False), ("src_path", STR, False),
    ("dst_store", STR, True), ("dst_path", STR, True), ("rule", STR, False),
    ("reason", STR, True), ("rule_priority", INT, False), ("plan_key", STR, False),
)

OUTCOMES = _s(("op_id", LONG, False), ("error", STR, True))


def enricher_schema(columns: T.StructType) -> T.StructType:
    return T.StructType(list(ENRICHER_BASE.fields) + list(columns.fields))


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select ``schema``'s columns in order, casting to the declared types."""
    from pyspark.sql import functions as F
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
