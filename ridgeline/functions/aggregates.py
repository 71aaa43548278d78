"""Aggregates with the common options: filter, distinct, order and the treatment of nulls."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions.base import value

ALIASES = {
    "approx_distinct": "approx_count_distinct", "mean": "avg", "covar": "covar_samp", "stddev": "stddev_samp", "var": "var_samp", "var_population": "var_pop", "var_sample": "var_samp",
    "quantile_cont": "percentile_cont", "count_star": "count_star",
}


def filtered(x: Any, where: Column | None) -> Column:
    """``x`` where the filter is true, else null, which aggregates pass over."""
    return value(x) if where is None else F.when(where, value(x))


def count_star(filter: Column | None = None) -> Column:  # noqa: A002
    return F.count(F.lit(1)) if filter is None else F.count_if(filter)


def percentile_cont(expression: Any, percentile: float, filter: Column | None = None) -> Column:  # noqa: A002
    """Exact, with interpolation."""
    return F.percentile(filtered(expression, filter), F.lit(percentile))


def approx_percentile_cont(expression: Any, percentile: float, filter: Column | None = None) -> Column:  # noqa: A002
    """Exact and interpolated: an approximation that cannot be off."""
    return percentile_cont(expression, percentile, filter)


def approx_percentile_cont_with_weight(expression: Any, weight: Any, percentile: float, filter: Column | None = None) -> Column:  # noqa: A002
    return F.percentile(filtered(expression, filter), F.lit(percentile), value(weight))


def approx_median(expression: Any, filter: Column | None = None) -> Column:  # noqa: A002
    return percentile_cont(expression, 0.5, filter)


def array_agg(expression: Any, distinct: bool = False, filter: Column | None = None, order_by: Sequence[Column | str] = ()) -> Column:  # noqa: A002
    """Nulls are kept; sorted by ``order_by``, ascending."""
    item = F.struct(*[value(o).alias(f"o{i}") for i, o in enumerate(order_by)], value(expression).alias("v"))
    item = item if filter is None else F.when(filter, item)
    got = F.collect_set(item) if distinct else F.collect_list(item)
    return F.transform(F.array_sort(got) if order_by else got, lambda s: s["v"])


def _ends(pick: Any, plain: Any, expression: Any, filter: Column | None, order_by: Column | str | None, ignore_nulls: bool) -> Column:  # noqa: A002
    v = value(expression)
    keep = filter if not ignore_nulls else v.isNotNull() if filter is None else filter & v.isNotNull()
    if order_by is None:
        return plain(filtered(v, keep), ignorenulls=ignore_nulls or filter is not None)
    item = F.struct(v.alias("v"))
    return pick(item if keep is None else F.when(keep, item), value(order_by) if keep is None else F.when(keep, value(order_by)))["v"]


def first_value(expression: Any, filter: Column | None = None, order_by: Column | str | None = None, ignore_nulls: bool = False) -> Column:  # noqa: A002
    return _ends(F.min_by, F.first, expression, filter, order_by, ignore_nulls)


def last_value(expression: Any, filter: Column | None = None, order_by: Column | str | None = None, ignore_nulls: bool = False) -> Column:  # noqa: A002
    return _ends(F.max_by, F.last, expression, filter, order_by, ignore_nulls)


def nth_value(expression: Any, n: int, order_by: Column | str, filter: Column | None = None) -> Column:  # noqa: A002
    """In the order of ``order_by``; null beyond the last value. As a window function use ``pyspark``'s ``nth_value``."""
    return F.get(array_agg(expression, filter=filter, order_by=[order_by]), F.lit(n - 1))


def string_agg(expression: Any, delimiter: str, filter: Column | None = None, order_by: Column | str | None = None) -> Column:  # noqa: A002
    """Nulls are passed over."""
    return F.array_join(array_agg(expression, filter=filter, order_by=[order_by] if order_by is not None else []), delimiter)


__all__ = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")]
