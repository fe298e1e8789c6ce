"""Broadcasts whose size is proven from the plan, not assumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def max_rows(df: DataFrame) -> int | None:
    """Upper bound on the row count that Catalyst derives from the plan (None when unbounded)."""
    bound = df._jdf.queryExecution().optimizedPlan().maxRows()
    return int(bound.get()) if bound.isDefined() else None


def bounded_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast hint for a side whose plan proves at most ``limit`` rows; otherwise an error."""
    bound = max_rows(df)
    if bound is None or bound > limit:
        raise ValueError(f"broadcast side not provably bounded by {limit} rows (plan bound: {bound})")
    return F.broadcast(df)


def attach_global(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a one-row table (a global aggregate) on every row of ``df``.

    The plan must prove that ``one_row`` has at most one row (global
    aggregates do), so the join broadcasts one row and emits exactly the rows
    of ``df``: a scalar lookup, never a pairing of two tables.
    """
    return df.crossJoin(bounded_broadcast(one_row, 1))
