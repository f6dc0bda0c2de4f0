"""Joins that stay balanced when one key holds a large share of the rows.

``salted_join(big, small, key)`` joins a possibly skewed ``big`` side with a
``small`` side holding at most one row per key (a per-hash or
per-destination table).  Every row of the big side gets one of ``buckets``
salts from its own id, and every row of the small side is there once for each
salt: the rows of a key are dealt over ``buckets`` tasks, however many they
are.  There is no list of hot keys and no threshold; the price is ``buckets``
copies of the narrow side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BUCKETS = 8
_SALT = "_lw_salt"


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner",
                spread_by: Sequence[str] = ("id",), buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """``big.join(small, key, how)`` with every key spread over ``buckets`` tasks.

    ``small`` must have at most one row per key; ``how`` is ``inner`` or
    ``left``.  ``spread_by`` columns of ``big`` pick a row's salt
    deterministically (so a retried task reproduces the same rows)."""
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    b = big.withColumn(_SALT, F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(buckets)).cast("int"))
    s = small.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return b.join(s, [key, _SALT], how).drop(_SALT)
