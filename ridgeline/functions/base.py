"""Argument conventions of the function modules."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def value(x: Any) -> Column:
    """A column by name, a column, or a literal that isn't a string."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def literal(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def pattern_of(fmt: str) -> str:
    """A Spark datetime pattern from a strftime format; text outside directives is quoted."""
    # Strftime directives and their Spark patterns.
    known = {
        "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE",
        "I": "hh", "p": "a", "f": "SSSSSS", "z": "xx", "Z": "VV", "e": "d", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "3f": "SSS", "6f": "SSSSSS",
    }
    out, i, plain = [], 0, ""

    def flush() -> None:
        nonlocal plain
        if plain:
            out.append("'" + plain.replace("'", "''") + "'" if any(c.isalpha() or c == "'" for c in plain) else plain)
            plain = ""

    while i < len(fmt):
        if fmt[i] != "%":
            plain, i = plain + fmt[i], i + 1
            continue
        j = i + 1
        while j < len(fmt) and fmt[j] in ".-":
            j += 1
        if fmt[j : j + 1] == "%":
            plain, i = plain + "%", j + 1
            continue
        code = fmt[j : j + 2] if fmt[j : j + 1].isdigit() else fmt[j : j + 1]
        if code not in known:
            raise ValueError(f"datetime directive not supported: %{code}")
        flush()
        out.append(("." if fmt[i + 1 : i + 2] == "." else "") + known[code])
        i = j + len(code)
    flush()
    return "".join(out)


def java_pattern(fmt: str) -> str:
    """A strftime format is translated, any other pattern is taken as Spark's own."""
    return pattern_of(fmt) if "%" in fmt else fmt
