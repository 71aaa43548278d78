"""Names of helper columns that cannot clash with those of the caller."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` names, each with as many leading underscores as it takes to be new (Spark compares without case)."""
    seen = {x.lower() for x in taken}
    out = []
    for name in wanted:
        while name.lower() in seen:
            name = "_" + name
        seen.add(name.lower())
        out.append(name)
    return out
