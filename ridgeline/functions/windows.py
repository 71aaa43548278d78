"""Window frames. Spark has ROWS and RANGE; GROUPS is a RANGE over the dense rank of the order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ridgeline.plans.names import fresh


def window_spec(partition_by: Sequence[str | Column] = (), order_by: Sequence[str | Column] = (), units: str | None = None, start: int | None = None, end: int | None = None) -> WindowSpec:
    """A window; ``start`` and ``end`` as offsets from the current row, None for no bound."""
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    lo = Window.unboundedPreceding if start is None else start
    hi = Window.unboundedFollowing if end is None else end
    if units is None:
        return w
    if units not in ("rows", "range"):
        raise ValueError("units must be rows or range; for groups use over_groups")
    return w.rowsBetween(lo, hi) if units == "rows" else w.rangeBetween(lo, hi)


def over_groups(df: DataFrame, out: str, aggregate: Column, partition_by: Sequence[str], order_by: Sequence[str | Column], start: int | None, end: int | None) -> DataFrame:
    """``df`` with ``aggregate`` over the peer groups from ``start`` to ``end`` as column ``out``."""
    (rank,) = fresh([*df.columns, out], "rank")
    ranked = df.withColumn(rank, F.dense_rank().over(Window.partitionBy(*partition_by).orderBy(*order_by)))
    return ranked.withColumn(out, aggregate.over(window_spec(partition_by, [rank], "range", start, end))).drop(rank)


__all__ = ["over_groups", "window_spec"]
