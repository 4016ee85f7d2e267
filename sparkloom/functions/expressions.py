"""Scalar and aggregate functions by name.

The math functions sum, mean, min and max take a column of numbers in a group,
or an array in a row.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import Expr, operand, path, resolve, type_of

__all__ = (
    "func as_ count count_all count_if sum_ avg min_ max_ upper lower string_upper string_lower string_len concat string_concat "
    "array_length array_contains abs_ math_abs ceil math_ceil floor math_floor round_ math_round math_sum math_mean math_min math_max "
    "time_now time_format type_is cast to_datetime register"
).split()

# Names of types, as Spark calls them.
TYPES = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean", "datetime": "timestamp", "decimal": "decimal(38,10)", "number": "double", "bytes": "binary", "duration": "interval day to second"}
# Strftime directives and Java's patterns for them.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "E", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "Z": "z", "z": "Z", "%": "%"}


def _of(x: Any, df: DataFrame) -> Column:
    return path(x, df) if isinstance(x, str) and x.replace(".", "").replace("_", "").isalnum() and not x[0].isdigit() else resolve(x, df)


def _one(f: Callable[[Column], Column]) -> Callable[[Any], Expr]:
    return lambda x: Expr(lambda df: f(_of(x, df)))


def _either(group: Callable[[Column], Column], array: Callable[[Column], Column]) -> Callable[[Any], Expr]:
    def build(x: Any, df: DataFrame) -> Column:
        return (array if isinstance(x, str) and x in df.columns and isinstance(type_of(x, df), T.ArrayType) else group)(_of(x, df))

    return lambda x: Expr(lambda df: build(x, df))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


sum_, avg, min_, max_ = _one(F.sum), _one(F.avg), _one(F.min), _one(F.max)
math_sum = _either(F.sum, _total)
math_mean = _either(F.avg, lambda x: F.try_divide(_total(x), F.array_size(x)))
math_min, math_max = _either(F.min, F.array_min), _either(F.max, F.array_max)
upper = string_upper = _one(F.upper)
lower = string_lower = _one(F.lower)
string_len = _one(F.length)
array_length = _one(F.array_size)
abs_ = math_abs = _one(F.abs)
ceil = math_ceil = _one(F.ceil)
floor = math_floor = _one(F.floor)


def as_(x: Any, name: str) -> Expr:
    return Expr(lambda df: _of(x, df), name)


def count(x: Any = None) -> Expr:
    """Rows, or rows where x isn't null."""
    return Expr(lambda df: F.count(F.lit(1) if x is None or x == "*" else _of(x, df)))


def count_all() -> Expr:
    return count()


def count_if(condition: Any) -> Expr:
    return Expr(lambda df: F.count_if(resolve(condition, df)))


def concat(*xs: Any) -> Expr:
    """Texts joined; null if any is null."""
    return Expr(lambda df: F.concat(*(_of(x, df) for x in xs)))


string_concat = concat


def array_contains(x: Any, element: Any) -> Expr:
    return Expr(lambda df: F.array_contains(_of(x, df), operand(element, df)))


def round_(x: Any, digits: int = 0) -> Expr:
    """Half away from zero."""
    return Expr(lambda df: F.round(_of(x, df), digits))


math_round = round_


def time_now() -> Expr:
    """The query's start: the same in all its rows."""
    return Expr(lambda df: F.current_timestamp())


def time_format(x: Any, form: str) -> Expr:
    """A time as text, by strftime directives."""
    out, quoted, k = "", "", 0

    def flush() -> str:
        nonlocal quoted
        own, quoted = quoted, ""
        return "'" + own.replace("'", "''") + "'" if own and any(c.isalpha() or c == "'" for c in own) else own

    while k < len(form):
        if form[k] == "%" and k + 1 < len(form):
            if form[k + 1] not in DIRECTIVES:
                raise ValueError(f"no such directive: %{form[k + 1]}")
            if form[k + 1] == "%":
                quoted += "%"
            else:
                out += flush() + DIRECTIVES[form[k + 1]]
            k += 2
        else:
            quoted += form[k]
            k += 1
    out += flush()
    return Expr(lambda df: F.date_format(_of(x, df), out))


def cast(x: Any, kind: str) -> Expr:
    """As another type; null where the value has no such form."""
    return Expr(lambda df: _of(x, df).try_cast(TYPES.get(kind, kind)))


def to_datetime(x: Any) -> Expr:
    """A text with a zone, or without one as UTC, as a time; a date is its midnight; null where it is none."""

    def build(df: DataFrame) -> Column:
        own = F.trim(_of(x, df))
        own = F.when(own.rlike(r"^\d+-\d\d-\d\d$"), F.concat(own, F.lit("T00:00:00"))).otherwise(own)
        return F.when(own.rlike(r"(?i)(z|T.*[+-]\d\d:?\d\d| .*[+-]\d\d:?\d\d)$"), F.try_to_timestamp(own)).otherwise(F.try_to_timestamp(F.concat(own, F.lit("Z"))))

    return Expr(build)


def type_is(x: str, kind: str) -> Expr:
    """Whether a column, or each value of a variant, is of a type."""

    def build(df: DataFrame) -> Column:
        own = type_of(x, df)
        if isinstance(own, T.VariantType):
            names = {"string": ["STRING"], "int": ["BIGINT"], "float": ["DOUBLE"], "bool": ["BOOLEAN"], "number": ["BIGINT", "DOUBLE"]}[kind]
            found = F.schema_of_variant(path(x, df))
            decimal = found.startswith("DECIMAL") if kind in ("number", "float") else F.lit(False)
            return found.isin(names) | decimal
        if kind == "number":
            return F.lit(isinstance(own, T.NumericType))
        if kind in ("array", "object"):
            return F.lit(isinstance(own, T.ArrayType if kind == "array" else (T.StructType, T.MapType)))
        families = {"int": T.IntegralType, "float": T.FractionalType, "datetime": (T.TimestampType, T.TimestampNTZType)}
        return F.lit(isinstance(own, families[kind]) if kind in families else own.simpleString() == TYPES[kind])

    return Expr(build)


#: Functions by the names that stored queries call them by; register() adds to them.
REGISTRY: dict[str, Callable[..., Expr]] = {
    "count": count, "sum": sum_, "avg": avg, "min": min_, "max": max_,
    "string::uppercase": upper, "string::lowercase": lower, "string::len": string_len, "string::concat": concat,
    "array::len": array_length, "array::includes": array_contains,
    "math::abs": abs_, "math::ceil": ceil, "math::floor": floor, "math::round": round_,
    "math::sum": math_sum, "math::mean": math_mean, "math::min": math_min, "math::max": math_max,
    "time::now": time_now, "time::format": time_format,
}


def register(name: str, f: Callable[..., Column]) -> None:
    """A stored function: from columns to a column."""
    REGISTRY[name] = lambda *xs: Expr(lambda df: f(*(_of(x, df) if isinstance(x, (str, Expr)) else operand(x, df) for x in xs)))


def func(name: str, *xs: Any) -> Expr:
    """A function by name: a registered one, or else one of Spark's."""
    if name in REGISTRY:
        return REGISTRY[name](*xs)
    return Expr(lambda df: F.call_function(name, *(_of(x, df) for x in xs)))
