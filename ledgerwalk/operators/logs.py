"""Tables that only grow: the operation log and the error log."""

from __future__ import annotations

from pyspark.sql import DataFrame

_MARK = "_lw_appended"


def appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with ``rows`` behind it.  The result remembers both, so a writer that
    holds ``table`` already writes ``rows`` only; any further transformation of the
    result forgets it."""
    out = table.unionByName(rows)
    setattr(out, _MARK, (table, rows))
    return out


def rows_since(table: DataFrame, base: DataFrame) -> list[DataFrame] | None:
    """What was appended to ``base`` to get ``table``, oldest first; None if ``table`` is
    something else."""
    rows: list[DataFrame] = []
    while table is not base:
        mark = getattr(table, _MARK, None)
        if mark is None:
            return None
        table = mark[0]
        rows.insert(0, mark[1])
    return rows
