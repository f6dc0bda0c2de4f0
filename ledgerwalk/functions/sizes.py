"""Human-readable byte counts (SI and IEC), as Columns and as SQL functions.

Format: below 10 -> ``"<n> B"``; otherwise pick the power ``e`` of the base,
round ``n / base**e`` half-up to one decimal, print it with one decimal when
below 10 and with none (half-even) otherwise.  Anything but a whole number that
is not negative is an error; NULL stays NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..constants import IEC_UNITS, SI_UNITS
from .paths import _c


def _human(raw: Column, base: int, units: tuple[str, ...]) -> Column:
    n = raw.try_cast("long")
    nd = n.cast("double")
    e = F.floor(F.log(nd) / F.log(F.lit(float(base))))
    val = F.floor(nd / F.pow(F.lit(float(base)), e) * 10 + 0.5) / 10
    unit = F.element_at(F.array(*[F.lit(u) for u in units]), (e + 1).cast("int"))
    big = F.when(val < 10, F.format_string("%.1f %s", val, unit)) \
        .otherwise(F.format_string("%.0f %s", F.bround(val, 0), unit))
    whole = F.typeof(raw).isin("tinyint", "smallint", "int", "bigint", "void")
    return (F.when(~whole, F.raise_error(F.concat(F.lit("not a whole number of bytes: "), raw.cast("string"))))
            .when(n.isNull(), F.lit(None).cast("string"))
            .when(n < 0, F.raise_error(F.concat(F.lit("negative byte count: "), n.cast("string"))))
            .when(n < 10, F.concat(n.cast("string"), F.lit(" B")))
            .otherwise(big))


def human_bytes(n: Column | str) -> Column:
    return _human(_c(n), 1000, SI_UNITS)


def human_ibytes(n: Column | str) -> Column:
    return _human(_c(n), 1024, IEC_UNITS)


def _sql_body(base: int, units: tuple[str, ...]) -> str:
    arr = ", ".join(f"'{u}'" for u in units)
    e = f"floor(ln(CAST(n AS DOUBLE)) / ln({base}.0))"
    val = f"(floor(CAST(n AS DOUBLE) / power({base}.0, {e}) * 10 + 0.5) / 10)"
    unit = f"element_at(array({arr}), CAST({e} AS INT) + 1)"
    return (
        "CASE WHEN n IS NULL THEN CAST(NULL AS STRING) "
        "WHEN n <> CAST(n AS BIGINT) THEN raise_error(concat('not a whole number of bytes: ', CAST(n AS STRING))) "
        "WHEN n < 0 THEN raise_error(concat('negative byte count: ', CAST(n AS STRING))) "
        "WHEN n < 10 THEN concat(CAST(CAST(n AS BIGINT) AS STRING), ' B') "
        f"WHEN {val} < 10 THEN format_string('%.1f %s', {val}, {unit}) "
        f"ELSE format_string('%.0f %s', bround({val}, 0), {unit}) END"
    )


def register_sql_functions(spark: SparkSession) -> None:
    """Register ``human_bytes`` / ``human_ibytes`` as SQL functions (SQL bodies,
    so they stay inside Catalyst and whole-stage codegen).  The parameter is a
    decimal so that a fraction is seen, and refused."""
    for name, base, units in (("human_bytes", 1000, SI_UNITS), ("human_ibytes", 1024, IEC_UNITS)):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(n DECIMAL(38, 6)) RETURNS STRING "
            f"RETURN {_sql_body(base, units)}"
        )
