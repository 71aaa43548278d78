"""Scalar, aggregate and window functions with the semantics of the engine, as Spark columns.

A string stands for a column where a value is expected, and for itself where a pattern, delimiter, unit or format is.
Names are resolved here first, then in ``pyspark.sql.functions``: what Spark has under the same name and meaning isn't wrapped.
"""

from __future__ import annotations

from typing import Any

from ridgeline.functions import aggregates, arrays, scalar, windows

_ALIASES = scalar.ALIASES | arrays.ALIASES | aggregates.ALIASES


def __getattr__(name: str) -> Any:
    from pyspark.sql import functions as spark_functions

    target = _ALIASES.get(name, name)
    for module in (scalar, arrays, aggregates, windows):
        if not target.startswith("_") and target in module.__all__:
            return getattr(module, target)
    if target.startswith("_") or not hasattr(spark_functions, target):
        raise AttributeError(f"no function {name}")
    return getattr(spark_functions, target)


def names() -> list[str]:
    """All names that the engine defines itself or under another name than Spark."""
    return sorted({*_ALIASES, *scalar.__all__, *arrays.__all__, *aggregates.__all__, *windows.__all__})
