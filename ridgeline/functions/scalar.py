"""Scalar functions whose semantics differ from Spark's function of that name, or that Spark lacks."""

from __future__ import annotations

import re
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.base import java_pattern, literal, value

ALIASES = {
    "pow": "power", "length": "char_length", "character_length": "char_length", "ends_with": "endswith", "starts_with": "startswith", "strpos": "instr_", "instr": "instr_",
    "substr_index": "substring_index", "datepart": "date_part", "extract": "date_part", "datetrunc": "date_trunc", "date_format": "to_char", "string_to_list": "string_to_array",
    "arrow_cast": "cast_to", "arrow_try_cast": "try_cast_to", "current_timestamp": "now", "random": "rand", "literal": "lit", "string_literal": "lit", "column": "col",
}
# Arrow type names and Spark's.
ARROW_TYPES = {
    "Boolean": "boolean", "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint", "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint", "UInt64": "decimal(20,0)",
    "Float16": "float", "Float32": "float", "Float64": "double", "Utf8": "string", "LargeUtf8": "string", "Utf8View": "string", "Binary": "binary", "LargeBinary": "binary", "BinaryView": "binary",
    "Date32": "date", "Date64": "timestamp_ntz", "Null": "void",
}


def spark_type(name: str) -> str:
    """Spark's name of an Arrow type such as ``Float64``, ``Decimal128(10, 2)``, ``Timestamp(Microsecond, None)`` or ``List(Int32)``."""
    name = name.strip()
    if name in ARROW_TYPES:
        return ARROW_TYPES[name]
    if m := re.fullmatch(r"Decimal\d+\((\d+),\s*(-?\d+)\)", name):
        return f"decimal({m[1]},{m[2]})"
    if m := re.fullmatch(r"Timestamp\((\w+),\s*(.*)\)", name):
        return "timestamp_ntz" if m[2] == "None" else "timestamp"
    if m := re.fullmatch(r"(?:Large)?List\((.*)\)", name):
        return f"array<{spark_type(m[1])}>"
    return name


def arrow_name(spark: str) -> str:
    """The Arrow name of a simple Spark type."""
    back = {v: k for k, v in reversed(ARROW_TYPES.items())}
    if m := re.fullmatch(r"decimal\((\d+),(\d+)\)", spark):
        return f"Decimal128({m[1]}, {m[2]})"
    if m := re.fullmatch(r"array<(.*)>", spark):
        return f"List({arrow_name(m[1])})"
    return {"timestamp": "Timestamp(Microsecond, Some(\"UTC\"))", "timestamp_ntz": "Timestamp(Microsecond, None)"}.get(spark, back.get(spark, spark))


def arrow_typeof(arg: Any) -> Column:
    out = F.typeof(value(arg))
    chain = out
    for spark in dict.fromkeys(ARROW_TYPES.values()):
        chain = F.when(out == spark, arrow_name(spark)).otherwise(chain)
    return chain


def cast_to(expr: Any, data_type: str) -> Column:
    return value(expr).cast(spark_type(data_type))


def try_cast_to(expr: Any, data_type: str) -> Column:
    return value(expr).try_cast(spark_type(data_type))


def cast_to_type(df: DataFrame, expr: Any, like: Any) -> Column:
    return value(expr).cast(df.select(value(like)).schema[0].dataType)


def try_cast_to_type(df: DataFrame, expr: Any, like: Any) -> Column:
    return value(expr).try_cast(df.select(value(like)).schema[0].dataType.simpleString())


def arrow_field(df: DataFrame, name: str) -> Column:
    """A struct (name, data_type, nullable) from the schema, at plan time."""
    f = df.schema[name]
    return F.struct(F.lit(f.name).alias("name"), F.lit(arrow_name(f.dataType.simpleString())).alias("data_type"), F.lit(f.nullable).alias("nullable"))


def arrow_metadata(df: DataFrame, name: str, key: str | None = None) -> Column:
    meta = df.schema[name].metadata or {}
    if key is not None:
        return F.lit(meta.get(key)).cast("string")
    return F.create_map(*[F.lit(x) for k, v in meta.items() for x in (k, str(v))]).cast("map<string,string>")


def isnan(expr: Any) -> Column:
    e = value(expr)
    return F.when(e.isNotNull(), F.isnan(e))


def fill_nan(expr: Any, other: Any) -> Column:
    return F.nanvl(value(expr), literal(other))


def fill_null(expr: Any, other: Any) -> Column:
    return F.coalesce(value(expr), literal(other))


def between(expr: Any, low: Any, high: Any, negated: bool = False) -> Column:
    out = value(expr).between(literal(low), literal(high))
    return ~out if negated else out


def iszero(arg: Any) -> Column:
    return value(arg) == F.lit(0)


def ceil(arg: Any) -> Column:
    return F.ceil(value(arg)).cast("double")


def floor(arg: Any) -> Column:
    return F.floor(value(arg)).cast("double")


def gcd(x: Any, y: Any) -> Column:
    """Euclid's steps as a fold: no more than 93 are needed for 64-bit integers."""
    start = F.struct(F.abs(value(x)).cast("bigint").alias("a"), F.abs(value(y)).cast("bigint").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["a"])


def lcm(x: Any, y: Any) -> Column:
    a, b = value(x), value(y)
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(F.call_function("div", F.abs(a * b), gcd(a, b)))


def div(x: Any, y: Any) -> Column:
    """Integer division, towards zero; null for a zero divisor."""
    b = value(y)
    return F.when(b != 0, F.call_function("div", value(x), b))


def _ieee(x: Column, logarithm: Column) -> Column:
    """Minus infinity at zero, not a number below it, where Spark has null."""
    return F.when(x > 0, logarithm).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.when(x.isNotNull(), x))


def ln(arg: Any) -> Column:
    x = value(arg).cast("double")
    return _ieee(x, F.ln(x))


def log10(arg: Any) -> Column:
    x = value(arg).cast("double")
    return _ieee(x, F.log10(x))


def log2(arg: Any) -> Column:
    x = value(arg).cast("double")
    return _ieee(x, F.log2(x))


def log(base: Any, num: Any) -> Column:
    return ln(num) / ln(base)


def trunc(num: Any, precision: int = 0) -> Column:
    x, p = value(num).cast("double"), F.lit(10.0**precision)
    return F.signum(x) * F.floor(F.abs(x) * p).cast("double") / p


def concat(*args: Any) -> Column:
    """Nulls are skipped."""
    return F.concat_ws("", *[value(a).cast("string") for a in args])


def chr(arg: Any) -> Column:  # noqa: A001
    """Any code point."""
    return F.decode(F.unhex(F.lpad(F.hex(value(arg)), 8, "0")), "UTF-32")


def initcap(string: Any) -> Column:
    """Every character that isn't a letter or digit begins a word."""
    parts = F.regexp_extract_all(F.lower(value(string)), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")


def instr_(string: Any, substring: Any) -> Column:
    return F.locate(substring, value(string)) if isinstance(substring, str) else F.call_function("locate", substring, value(string))


def position(string: Any, substring: Any) -> Column:
    return F.call_function("locate", literal(substring), value(string))


def left(string: Any, n: int) -> Column:
    s = value(string)
    return F.left(s, F.lit(n)) if n >= 0 else F.left(s, F.greatest(F.length(s) + F.lit(n), F.lit(0)))


def right(string: Any, n: int) -> Column:
    s = value(string)
    return F.right(s, F.lit(n)) if n >= 0 else F.right(s, F.greatest(F.length(s) + F.lit(n), F.lit(0)))


def _flags(regex: str, flags: str | None) -> str:
    own = "".join(f for f in flags or "" if f in "imsx")
    return f"(?{own}){regex}" if own else regex


def regexp_like(string: Any, regex: str, flags: str | None = None) -> Column:
    return F.regexp_like(value(string), F.lit(_flags(regex, flags)))


def regexp_match(string: Any, regex: str, flags: str | None = None) -> Column:
    """The groups of the first match, or the match itself where there is no group; null without a match."""
    r, s = _flags(regex, flags), value(string)
    n = re.compile(regex).groups
    got = F.array(*[F.regexp_extract(s, r, i) for i in (range(1, n + 1) if n else (0,))])
    return F.when(F.regexp_like(s, F.lit(r)), got)


def regexp_replace(string: Any, pattern: str, replacement: str, flags: str | None = None) -> Column:
    """The first match is replaced; all of them with flag ``g``. ``\\1`` and ``$1`` name groups."""
    to = re.sub(r"\\(\d)", r"$\1", replacement)
    r, s = _flags(pattern, flags), value(string)
    if "g" in (flags or ""):
        return F.regexp_replace(s, r, to)
    head = F.regexp_extract(s, f"(?s)^(.*?)(?:{r})", 1)
    rest = s.substr(F.length(head) + 1, F.length(s))
    first = F.regexp_extract(rest, f"^(?:{r})", 0)
    return F.when(F.regexp_like(s, F.lit(r)), F.concat(head, F.regexp_replace(first, f"^(?:{r})$", to), rest.substr(F.length(first) + 1, F.length(rest)))).otherwise(s)


def regexp_count(string: Any, pattern: str, start: int = 1, flags: str | None = None) -> Column:
    s = value(string)
    return F.regexp_count(s.substr(F.lit(start), F.length(s)) if start > 1 else s, F.lit(_flags(pattern, flags)))


def regexp_instr(string: Any, pattern: str, start: int = 1, n: int = 1, flags: str | None = None) -> Column:
    """The place of the n-th match from ``start``, 0 if there is none."""
    s, r = value(string), _flags(pattern, flags)
    rest = s.substr(F.lit(start), F.length(s))
    skipped = F.regexp_extract(rest, f"(?s)^((?:.*?(?:{r})){{{n - 1}}}.*?)(?:{r})", 1) if n > 1 else F.regexp_extract(rest, f"(?s)^(.*?)(?:{r})", 1)
    return F.when(F.size(F.regexp_extract_all(rest, F.lit(f"({r})"), 1)) >= n, F.length(skipped) + start).otherwise(F.when(s.isNotNull(), F.lit(0)))


def encode(expr: Any, encoding: str) -> Column:
    e = value(expr)
    if encoding == "hex":
        return F.lower(F.hex(e))
    if encoding == "base64":
        return F.rtrim(F.base64(e.cast("binary")), F.lit("="))
    raise ValueError(f"unknown encoding {encoding}")


def decode(expr: Any, encoding: str) -> Column:
    e = value(expr)
    if encoding == "hex":
        return F.unhex(e)
    if encoding == "base64":
        return F.unbase64(F.concat(e, F.repeat(F.lit("="), F.pmod(-F.length(e), F.lit(4)))))
    raise ValueError(f"unknown encoding {encoding}")


def digest(expr: Any, method: str) -> Column:
    """Binary digest by md5, sha224, sha256, sha384, sha512, blake2b or blake2s."""
    e = value(expr)
    if method == "md5":
        return F.unhex(F.md5(e))
    if method in ("sha224", "sha256", "sha384", "sha512"):
        return F.unhex(F.sha2(e.cast("binary"), int(method[3:])))
    if method in ("blake2b", "blake2s"):
        import hashlib

        @F.arrow_udf("binary")
        def blake(column: pa.Array) -> pa.Array:
            return pa.array([None if b is None else getattr(hashlib, method)(b).digest() for b in column.to_pylist()], pa.binary())

        return blake(e.cast("binary"))
    raise ValueError(f"unknown digest {method}")


def sha224(arg: Any) -> Column:
    return digest(arg, "sha224")


def sha256(arg: Any) -> Column:
    return digest(arg, "sha256")


def sha384(arg: Any) -> Column:
    return digest(arg, "sha384")


def sha512(arg: Any) -> Column:
    return digest(arg, "sha512")


def to_hex(arg: Any) -> Column:
    return F.lower(F.hex(value(arg)))


def string_to_array(string: Any, delimiter: str | None, null_string: str | None = None) -> Column:
    s = value(string)
    parts = F.split(s, "", -1) if delimiter is None else F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, re.escape(delimiter), -1))
    return parts if null_string is None else F.transform(parts, lambda x: F.nullif(x, F.lit(null_string)))


def struct(*args: Any) -> Column:
    return F.struct(*[value(a).alias(f"c{i}") for i, a in enumerate(args)])


def row(*args: Any) -> Column:
    return struct(*args)


def named_struct(pairs: list[tuple[str, Any]]) -> Column:
    return F.struct(*[value(v).alias(k) for k, v in pairs])


def get_field(expr: Any, *names: Any) -> Column:
    out = value(expr)
    for n in names:
        out = out.getItem(n)
    return out


def union_value(tag: str, **members: Any) -> Column:
    """A tagged union as a struct (tag, one field a member, null but for the tag's)."""
    return F.struct(F.lit(tag).alias("tag"), *[(value(v) if k == tag else F.lit(None)).alias(k) for k, v in members.items()])


def union_tag(expr: Any) -> Column:
    return value(expr)["tag"]


def union_extract(expr: Any, name: str) -> Column:
    return F.when(union_tag(expr) == name, value(expr)[name])


def in_list(arg: Any, values: list, negated: bool = False) -> Column:
    out = value(arg).isin([v for v in values]) if not any(isinstance(v, Column) for v in values) else value(arg).isin(*values)
    return ~out if negated else out


def order_by(expr: Any, ascending: bool = True, nulls_first: bool = True) -> Column:
    e = value(expr)
    return {(True, True): e.asc_nulls_first, (True, False): e.asc_nulls_last, (False, True): e.desc_nulls_first, (False, False): e.desc_nulls_last}[ascending, nulls_first]()


def with_metadata(expr: Any, name: str, metadata: dict) -> Column:
    return value(expr).alias(name, metadata=metadata)


def to_char(arg: Any, formatter: str) -> Column:
    return F.date_format(value(arg), java_pattern(formatter))


def _parsed(parse: Any, arg: Any, formatters: tuple[str, ...]) -> Column:
    """By the first formatter that fits; an error where none does."""
    s = value(arg)
    tries = [parse(s, F.lit(java_pattern(f)) if parse is not F.try_to_date else java_pattern(f)) for f in formatters] or [parse(s)]
    return F.when(s.isNotNull(), F.coalesce(*tries, F.raise_error(F.concat(F.lit("cannot be parsed: "), s.cast("string"))).cast("timestamp" if parse is F.try_to_timestamp else "date")))


def to_date(arg: Any, *formatters: str) -> Column:
    return _parsed(F.try_to_date, arg, formatters)


def to_timestamp(arg: Any, *formatters: str) -> Column:
    return _parsed(F.try_to_timestamp, arg, formatters)


def to_timestamp_seconds(arg: Any, *formatters: str) -> Column:
    return F.date_trunc("second", to_timestamp(arg, *formatters)) if formatters else F.timestamp_seconds(value(arg))


def to_timestamp_millis(arg: Any, *formatters: str) -> Column:
    return F.date_trunc("millisecond", to_timestamp(arg, *formatters)) if formatters else F.timestamp_millis(value(arg))


def to_timestamp_micros(arg: Any, *formatters: str) -> Column:
    return to_timestamp(arg, *formatters) if formatters else F.timestamp_micros(value(arg))


def to_timestamp_nanos(arg: Any, *formatters: str) -> Column:
    """Spark keeps microseconds: the last three digits are lost."""
    return to_timestamp(arg, *formatters) if formatters else F.timestamp_micros(F.call_function("div", value(arg), F.lit(1000)))


def to_unixtime(arg: Any, *formatters: str) -> Column:
    return F.unix_seconds(to_timestamp(arg, *formatters))


def to_local_time(arg: Any) -> Column:
    return value(arg).cast("timestamp_ntz")


def from_unixtime(arg: Any) -> Column:
    return F.timestamp_seconds(value(arg))


def date_part(part: str, date: Any) -> Column:
    """As doubles are avoided, ``dow`` counts from Sunday = 0 and ``epoch`` is in seconds with a fraction."""
    d, p = value(date), part.lower()
    if p in ("dow", "dayofweek"):
        return F.dayofweek(d) - 1
    if p == "isodow":
        return F.weekday(d) + 1
    if p == "epoch":
        return F.unix_micros(d.cast("timestamp")) / F.lit(1e6)
    if p in ("millisecond", "microsecond"):
        return (F.date_part(F.lit("second"), d) * (1000 if p == "millisecond" else 1_000_000)).cast("int")
    return F.date_part(F.lit(p), d).cast("int")


def date_bin(stride_seconds: float, source: Any, origin: str = "1970-01-01 00:00:00") -> Column:
    """The start of the bucket of fixed width that holds ``source``; buckets before the origin floor as well."""
    width = F.lit(int(stride_seconds * 1_000_000))
    start = F.unix_micros(F.lit(origin).cast("timestamp"))
    at = F.unix_micros(value(source).cast("timestamp"))
    return F.timestamp_micros(at - F.pmod(at - start, width))


class CaseBuilder:
    """``case(x).when(1, "one").when(2, "two").otherwise("many")``, or ``.end()`` for null elsewhere."""

    def __init__(self, subject: Column, made: Column | None = None):
        self.subject, self.made = subject, made

    def when(self, match: Any, then: Any) -> CaseBuilder:
        test, out = self.subject == literal(match), literal(then)
        return CaseBuilder(self.subject, F.when(test, out) if self.made is None else self.made.when(test, out))

    def otherwise(self, other: Any) -> Column:
        return self.end().otherwise(literal(other))

    def end(self) -> Column:
        if self.made is None:
            raise ValueError("a case has at least one when")
        return self.made


def case(expr: Any) -> CaseBuilder:
    return CaseBuilder(value(expr))


def lambda_var(name: str) -> Column:
    """The parameter ``name`` of a function made by ``lambda_``."""
    return F.col(f"{_PARAMETER}{name}")


_PARAMETER = "__parameter_"


def lambda_(params: list[str], body: Column) -> Any:
    """A function for ``array_transform``, ``array_filter`` and their like, from a body over ``lambda_var`` columns."""
    text = re.sub(rf"`?{_PARAMETER}(\w+)`?", r"\1", _sql_of(body))
    names = params[0] if len(params) == 1 else f"({', '.join(params)})"
    return SqlLambda(f"{names} -> {text}")


class SqlLambda:
    def __init__(self, text: str):
        self.text = text


def _sql_of(column: Column) -> str:
    """The SQL text of a column, as Catalyst prints its expression."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return spark._jsparkSession.expression(column._jc).sql()


def expression_to_bytes(column: Column) -> bytes:
    """The expression as text that ``expression_from_bytes`` reads back, in this session or another; Python functions have no text."""
    text = _sql_of(column)
    F.expr(text)  # it must be readable
    return text.encode()


def expression_from_bytes(data: bytes) -> Column:
    return F.expr(data.decode())


def if_(condition: Column, if_true: Any, if_false: Any) -> Column:
    return F.when(condition, value(if_true)).otherwise(value(if_false))


def spark_cast(arg: Any, type_name: str) -> Column:
    return value(arg).cast(type_name)


def modulus(dividend: Any, divisor: Any) -> Column:
    return value(dividend) % value(divisor)


def luhn_check(arg: Any) -> Column:
    return F.call_function("luhn_check", value(arg))


def space(n: Any) -> Column:
    return F.call_function("space", value(n))


def version() -> Column:
    from ridgeline import __version__

    return F.lit(f"ridgeline {__version__}")


__all__ = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")]
