"""Ad-hoc SQL over the catalogue tables, text output formats, schema alignment."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import COLUMN_NAME_PATTERN, COLUMN_TYPE_PATTERN, UNICODE_SPACE_CLASS
from ..functions.sizes import register_sql_functions

_IDENT = re.compile(COLUMN_NAME_PATTERN)
_TYPE = re.compile(COLUMN_TYPE_PATTERN)

# declared column types (SQLite affinity names) -> Spark types
_TYPE_MAP = {"TEXT": T.StringType(), "INTEGER": T.LongType(), "REAL": T.DoubleType(),
             "BLOB": T.BinaryType(), "NUMERIC": T.DoubleType(), "BOOLEAN": T.BooleanType(),
             "TIMESTAMP": T.TimestampNTZType()}


def register_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    register_sql_functions(spark)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def query(spark: SparkSession, tables: Mapping[str, DataFrame], text: str) -> DataFrame:
    """Run SQL text over the tables (one temp view each, plus the
    ``human_bytes`` / ``human_ibytes`` functions).  Empty text is an error, and so
    is a statement that would change anything: queries only read."""
    if text is None or text.strip() == "":
        raise ValueError("query text is empty")
    register_tables(spark, tables)
    _refuse_writes(spark, text)
    return spark.sql(text)


def _refuse_writes(spark: SparkSession, text: str) -> None:
    """Parse ``text`` (without running it) and refuse commands and inserts."""
    jvm = spark.sparkContext._jvm
    command = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name.startswith("InsertInto") or (command.isInstance(node) and not name.startswith(("Show", "Describe", "Explain"))):
            raise ValueError(f"only queries are allowed, not {name}")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def tsv_lines(df: DataFrame, header: bool = True) -> DataFrame:
    """(ord, line): tab-joined values, NULL as empty, no quoting.  ``ord`` 0 is
    the header line, which is the first row; the others keep the order of ``df``."""
    body = df.select(F.lit(1).alias("ord"), F.concat_ws("\t", *[_text(c) for c in df.columns]).alias("line"))
    if not header:
        return body
    head = df.sparkSession.createDataFrame([(0, "\t".join(df.columns))], "ord int, line string")
    return head.unionByName(body)


def csv_field(c: Column) -> Column:
    """One CSV field: quoted (quotes doubled) when it contains a comma, quote,
    CR or LF, starts with (Unicode) white space, or is ``\\.``; NULL as empty."""
    v = F.coalesce(c.cast("string"), F.lit(""))
    needs = (v != "") & (v.rlike('[,"\\r\\n]') | v.rlike("^" + UNICODE_SPACE_CLASS) | (v == "\\."))
    return F.when(needs, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_lines(df: DataFrame, header: bool = True) -> DataFrame:
    body = df.select(F.lit(1).alias("ord"),
                     F.concat_ws(",", *[csv_field(F.col(f"`{c}`")) for c in df.columns]).alias("line"))
    if not header:
        return body
    names = df.sparkSession.createDataFrame([tuple(df.columns)], df.columns) if df.columns else None
    head = names.select(F.lit(0).alias("ord"),
                        F.concat_ws(",", *[csv_field(F.col(f"`{c}`")) for c in df.columns]).alias("line"))
    return head.unionByName(body)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """Distributed TSV sink: lines as they are, in the order of ``df``, the header
    once at the start of the first part file."""
    tsv_lines(df, header).select("line").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Distributed CSV sink, as ``write_tsv``."""
    csv_lines(df, header).select("line").write.mode("overwrite").text(path)


def _spark_type(declared: str) -> T.DataType | str:
    """SQLite affinity names map to Spark types; other names are Spark type names."""
    return _TYPE_MAP.get(declared.upper(), declared.lower())


def align_schema(df: DataFrame, base: Sequence[str] | T.StructType,
                 declared: Sequence[tuple[str, str]]) -> DataFrame:
    """Keep the base columns, add missing declared columns as typed NULLs, keep
    existing declared ones, drop every other column.  Identifiers must match
    ``^[a-zA-Z_][a-zA-Z0-9_]*$`` and types be letters only."""
    base_names = base.fieldNames() if isinstance(base, T.StructType) else list(base)
    for name, typ in declared:
        if not _IDENT.match(name):
            raise ValueError(f"invalid column name {name!r}")
        if not _TYPE.match(typ):
            raise ValueError(f"invalid column type {typ!r} for {name}")
    cols = [F.col(c) for c in base_names]
    for name, typ in declared:
        if name in base_names:
            continue
        cols.append(F.col(name) if name in df.columns else F.lit(None).cast(_spark_type(typ)).alias(name))
    return df.select(*cols)


__all__ = ["register_tables", "query", "tsv_lines", "csv_lines", "csv_field", "write_tsv",
           "write_csv", "align_schema"]
