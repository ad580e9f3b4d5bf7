"""Operators for preparing training data: filtering, deduplication, mixing, packing, encoding.

Nothing outside this package imports it.  The queries over the driver's tables are in
``queries`` and their DuckDB statements in ``oracle``.
"""
