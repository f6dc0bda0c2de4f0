"""Operators a large-scale training-data pipeline needs, each by its own method.

Nothing else in the library imports this subpackage.  ``queries.QUERIES`` and
``oracle.ORACLE`` hold the registered queries and their DuckDB SQL.
"""
