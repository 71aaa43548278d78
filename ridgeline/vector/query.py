"""What a vector search asks for: where to look, what may count, and what comes out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from types import MappingProxyType
from typing import Any

from ridgeline.vector.errors import InvalidArgument

DEFAULT_LIMIT = 10


def _count(name: str, value: Any) -> int:
    if type(value) is bool or not isinstance(value, int) or value < 1:
        raise InvalidArgument(f"{name} must be a positive integer")
    return value


def _columns(_: str, value: Iterable[str]) -> tuple[str, ...]:
    names = tuple(value)
    if not names or len(names) > len(set(names)):
        raise InvalidArgument("a projection names at least one column, each once")
    return names


def _condition(_: str, value: str) -> str:
    if not value or value.isspace():
        raise InvalidArgument("the predicate is empty")
    return value


#: The parts of a request that a caller may set, each with its check.
_PARTS = MappingProxyType({"select": _columns, "limit": _count, "nprobes": _count, "where": _condition, "exact": lambda _, on: bool(on)})


class VectorQuery:
    """A vector to search for in a table, and the parts of the request that were set. It never changes: each verb returns another one."""

    __slots__ = ("_near", "_set")

    def __init__(self, table: str, vector: Sequence[float], column: str | None = None, index: str | None = None, parts: Mapping[str, Any] | None = None):
        object.__setattr__(self, "_near", (table, tuple(vector), column, index))
        object.__setattr__(self, "_set", {name: _PARTS[name](name, value) for name, value in (parts or {}).items()})

    def _with(self, name: str, value: Any) -> VectorQuery:
        return VectorQuery(*self._near, parts={**self._set, name: value})

    def select(self, columns: Sequence[str]) -> VectorQuery:
        """Only these columns of the source come out, with the distance."""
        return self._with("select", columns)

    def limit(self, k: int) -> VectorQuery:
        """At most so many rows, the nearest ones."""
        return self._with("limit", k)

    def nprobes(self, n: int) -> VectorQuery:
        """How many clusters of the index are searched."""
        return self._with("nprobes", n)

    def where(self, predicate: str) -> VectorQuery:
        """Only source rows with this SQL condition count, before the nearest are taken."""
        return self._with("where", predicate)

    def bypass_vector_index(self) -> VectorQuery:
        """Measure every row."""
        return self._with("exact", True)

    @property
    def source(self) -> str:
        return self._near[0]

    @property
    def vector(self) -> tuple[float, ...]:
        return self._near[1]

    @property
    def column(self) -> str | None:
        return self._near[2]

    @property
    def index(self) -> str | None:
        return self._near[3]

    def part(self, name: str) -> Any:
        """A part of the request, or None (for ``limit`` the default, for ``exact`` False) where it wasn't set."""
        return self._set.get(name, {"limit": DEFAULT_LIMIT, "exact": False}.get(name))

    def __setattr__(self, name: str, value: Any) -> None:
        raise AttributeError("a query does not change")

    def __eq__(self, other: object) -> bool:
        return isinstance(other, VectorQuery) and (self._near, self._set) == (other._near, other._set)

    def __hash__(self) -> int:
        return hash((self._near, tuple(sorted(self._set.items()))))

    def __repr__(self) -> str:
        return f"VectorQuery{(*self._near, dict(sorted(self._set.items())))}"

    def __reduce__(self) -> tuple:
        return VectorQuery, (*self._near, self._set)
