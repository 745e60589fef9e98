"""Deterministic row hashes.

Every sample, fold, shuffle and tie-break in the package is ordered by a hash of
(salt, id) with the id as the last key, so results never depend on file order or
partitioning. The hash is the first 32 bits of an MD5 digest of
``salt:part1:part2...``; Spark and DuckDB compute it identically, so oracle
queries rebuild the same order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("string")


def h(salt: str, *cols) -> Column:
    """BIGINT in [0, 2^32) from a literal salt and columns (names or Columns)."""
    joined = F.concat_ws(":", F.lit(str(salt)), *[_col(c) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


def h_unit(salt: str, *cols) -> Column:
    """The hash mapped to a double in [0, 1)."""
    return h(salt, *cols) / F.lit(4294967296.0)


def sql_h(salt: str, *exprs: str) -> str:
    """DuckDB text of the same hash; ``exprs`` are SQL expressions."""
    inner = ", ".join([f"'{salt}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"('0x' || substr(md5(concat_ws(':', {inner})), 1, 8))::BIGINT"


def sql_h_unit(salt: str, *exprs: str) -> str:
    return f"({sql_h(salt, *exprs)} / 4294967296.0)"
