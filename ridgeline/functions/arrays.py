"""Array, vector and map functions whose semantics differ from Spark's, or that Spark lacks. Places count from 1."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from ridgeline.functions.base import literal, value

_ARRAY = {
    "array_transform": "array_transform", "array_filter": "array_filter", "array_any_match": "array_any_match", "any_match": "array_any_match", "make_array": "array", "array_push_back": "array_append",
    "array_concat": "concat_arrays", "array_cat": "concat_arrays", "dot_product": "inner_product", "array_extract": "array_element", "array_has": "array_contains",
    "array_has_any": "array_has_any", "arrays_overlap": "array_has_any", "array_indexof": "array_position", "array_push_front": "array_prepend", "array_remove_all": "remove_all", "empty": "array_empty",
    "array_reverse": "reverse", "gen_series": "gen_series", "generate_series": "gen_series", "array_join": "array_to_string", "make_list": "array", "list_to_string": "array_to_string",
    "make_map": "make_map", "element_at": "map_extract",
}
_LISTS = (
    "any_match any_value append cat concat compact contains dims distance distinct element empty except extract filter has has_all has_any indexof intersect join length max min ndims normalize "
    "overlap pop_back pop_front position positions prepend push_back push_front remove remove_all remove_n repeat replace replace_all replace_n resize reverse slice sort transform union zip"
).split()
ALIASES = dict(_ARRAY)
for _n in _LISTS:
    _a = {"overlap": "arrays_overlap", "zip": "arrays_zip"}.get(_n, f"array_{_n}")
    ALIASES[f"list_{_n}"] = _ARRAY.get(_a, _a)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, v: s + v)


def _pairs(a: Column, b: Column, f: Any) -> Column:
    """The sum of ``f`` over pairs of elements; an error where the lengths differ, null where an element is."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    ok = F.size(x) == F.size(y)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(ok, _sum(F.zip_with(x, y, f))).otherwise(F.raise_error(F.lit("vectors have different lengths")).cast("double"))


def squared_l2(a: Any, b: Any) -> Column:
    """The sum of squared differences in double precision, as float."""
    return _pairs(value(a), value(b), lambda x, y: (x - y) * (x - y)).cast("float")


def array_distance(a: Any, b: Any) -> Column:
    return F.sqrt(_pairs(value(a), value(b), lambda x, y: (x - y) * (x - y)))


def inner_product(a: Any, b: Any) -> Column:
    return _pairs(value(a), value(b), lambda x, y: x * y)


def cosine_distance(a: Any, b: Any) -> Column:
    """Null where a vector has no length."""
    x, y = value(a), value(b)
    norm = F.sqrt(inner_product(x, x)) * F.sqrt(inner_product(y, y))
    return 1 - inner_product(x, y) / F.nullif(norm, F.lit(0.0))


def array_normalize(a: Any) -> Column:
    """Null for a zero vector and where an element is null."""
    x = value(a).cast("array<double>")
    norm = F.sqrt(_sum(F.transform(x, lambda v: v * v)))
    return F.when(F.exists(x, lambda v: v.isNull()) | (norm == 0), F.lit(None)).otherwise(F.transform(x, lambda v: v / norm))


def _higher(name: str, plain: Any, a: Any, f: Any) -> Column:
    """A function of an array and a Python function, or one of ``lambda_``."""
    from ridgeline.functions.scalar import SqlLambda, _sql_of

    return F.expr(f"{name}({_sql_of(value(a))}, {f.text})") if isinstance(f, SqlLambda) else plain(value(a), f)


def array_transform(a: Any, f: Any) -> Column:
    return _higher("transform", F.transform, a, f)


def array_filter(a: Any, f: Any) -> Column:
    return _higher("filter", F.filter, a, f)


def array_any_match(a: Any, f: Any) -> Column:
    return _higher("exists", F.exists, a, f)


def array_to_string(a: Any, delimiter: str, null_string: str | None = None) -> Column:
    s = value(a).cast("array<string>")
    return F.array_join(s, delimiter) if null_string is None else F.array_join(s, delimiter, null_string)


def range(start: int | Column, stop: int | Column | None = None, step: int = 1) -> Column:  # noqa: A001
    """``stop`` is exclusive; empty where the step leads away from it."""
    a, b = (F.lit(0), literal(start)) if stop is None else (literal(start), literal(stop))
    ok = a < b if step > 0 else a > b
    return F.when(ok, F.sequence(a, b - (1 if step > 0 else -1), F.lit(step))).otherwise(F.array().cast("array<int>"))


def gen_series(start: int | Column, stop: int | Column, step: int = 1) -> Column:
    a, b = literal(start), literal(stop)
    return F.when(a <= b if step > 0 else a >= b, F.sequence(a, b, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _depth(t: DataType) -> int:
    return 1 + _depth(t.elementType) if isinstance(t, ArrayType) else 0


def array_ndims(df: DataFrame, a: str) -> Column:
    """Of the schema, at plan time; null for a null array."""
    return F.when(F.col(a).isNotNull(), F.lit(_depth(df.schema[a].dataType)))


def array_dims(df: DataFrame, a: str) -> Column:
    """Sizes by level, of the first element at each."""
    out, at = [], F.col(a)
    for _ in [0] * _depth(df.schema[a].dataType):
        out.append(F.size(at))
        at = F.get(at, F.lit(0))
    return F.when(F.col(a).isNotNull(), F.array(*out))


def cardinality(df: DataFrame, a: str) -> Column:
    """The number of innermost elements."""
    x = F.col(a)
    for _ in [0] * (_depth(df.schema[a].dataType) - 1):
        x = F.flatten(x)
    return F.size(x)


def concat_arrays(*args: Any) -> Column:
    return F.concat(*[value(a) for a in args])


def array_element(a: Any, n: int | Column) -> Column:
    """Null outside and at place 0; negative places count from the end."""
    return F.try_element_at(value(a), F.nullif(literal(n), F.lit(0)))


def array_empty(a: Any) -> Column:
    return F.size(value(a)) == 0


def array_length(a: Any) -> Column:
    x = value(a)
    return F.when(x.isNotNull(), F.size(x))


def array_has_all(a: Any, b: Any) -> Column:
    return F.size(F.array_except(value(b), value(a))) == 0


def array_has_any(a: Any, b: Any) -> Column:
    return F.coalesce(F.arrays_overlap(value(a), value(b)), F.when(value(a).isNotNull() & value(b).isNotNull(), F.lit(False)))


def array_position(a: Any, element: Any, index: int = 1) -> Column:
    """From place ``index`` on; null where it isn't found."""
    x = value(a)
    if index > 1:
        at = F.array_position(F.slice(x, index, F.greatest(F.size(x), F.lit(1))), element)
        return F.when(at > 0, at + (index - 1))
    return F.nullif(F.array_position(x, element), F.lit(0).cast("bigint"))


def array_positions(a: Any, element: Any) -> Column:
    e = literal(element)
    return F.filter(F.transform(value(a), lambda x, i: F.when(x.eqNullSafe(e), i + 1)), lambda x: x.isNotNull())


def array_pop_back(a: Any) -> Column:
    x = value(a)
    return F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))


def array_pop_front(a: Any) -> Column:
    x = value(a)
    return F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))


def _matches_before(x: Column, e: Column) -> Column:
    """Elements with the number of matches up to and with each: one pass, not one a place."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("seen"))
    return F.aggregate(x, start, lambda s, v: F.struct((s["n"] + v.eqNullSafe(e).cast("int")).alias("n"), F.array_append(s["seen"], s["n"] + v.eqNullSafe(e).cast("int")).alias("seen")), lambda s: s["seen"])


def array_remove_n(a: Any, element: Any, n: int) -> Column:
    x, e = value(a), literal(element)
    seen = _matches_before(x, e)
    return F.filter(x, lambda v, i: ~(v.eqNullSafe(e)) | (F.get(seen, i) > n))


def array_remove(a: Any, element: Any) -> Column:
    """The first match only."""
    return array_remove_n(a, element, 1)


def remove_all(a: Any, element: Any) -> Column:
    e = literal(element)
    return F.filter(value(a), lambda v: ~v.eqNullSafe(e))


def array_replace_n(a: Any, from_val: Any, to_val: Any, n: int) -> Column:
    x, e, t = value(a), literal(from_val), literal(to_val)
    seen = _matches_before(x, e)
    return F.transform(x, lambda v, i: F.when(v.eqNullSafe(e) & (F.get(seen, i) <= n), t).otherwise(v))


def array_replace(a: Any, from_val: Any, to_val: Any) -> Column:
    return array_replace_n(a, from_val, to_val, 1)


def array_replace_all(a: Any, from_val: Any, to_val: Any) -> Column:
    e, t = literal(from_val), literal(to_val)
    return F.transform(value(a), lambda v: F.when(v.eqNullSafe(e), t).otherwise(v))


def array_sort(a: Any, descending: bool = False, nulls_first: bool = False) -> Column:
    x = value(a)
    there = F.sort_array(F.array_compact(x), asc=not descending)
    nulls = F.filter(x, lambda v: v.isNull())
    return F.concat(nulls, there) if nulls_first else F.concat(there, nulls)


def array_slice(a: Any, begin: int, end: int, stride: int = 1) -> Column:
    """From place ``begin`` to ``end``, both included; negative places count from the end."""
    x = value(a)
    n = F.size(x)
    first = F.greatest(F.lit(begin) if begin > 0 else n + 1 + begin if begin < 0 else F.lit(1), F.lit(1))
    last = F.least(F.lit(end) if end >= 0 else n + 1 + end, n)
    got = F.when(last >= first, F.slice(x, first, F.greatest(last - first + 1, F.lit(0)))).otherwise(F.slice(x, 1, 0))
    return got if stride == 1 else F.filter(got, lambda _, i: i % stride == 0)


def array_resize(a: Any, size: int, fill: Any = None) -> Column:
    x = value(a)
    return F.slice(F.concat(x, F.array_repeat(literal(fill), F.greatest(F.lit(size) - F.size(x), F.lit(0)))), 1, size)


def array_any_value(a: Any) -> Column:
    return F.get(F.array_compact(value(a)), F.lit(0))


def array_prepend(element: Any, a: Any) -> Column:
    return F.array_prepend(value(a), element)


def array_repeat(element: Any, count: int) -> Column:
    return F.array_repeat(value(element), count)


def map_extract(m: Any, key: Any) -> Column:
    """A list of one value, null in it for a missing key."""
    return F.array(F.try_element_at(value(m), literal(key)))


def make_map(*args: Any) -> Column:
    """From two arrays, or from keys and values in turn."""
    return F.map_from_arrays(value(args[0]), value(args[1])) if len(args) == 2 else F.create_map(*[value(a) for a in args])


__all__ = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")]
