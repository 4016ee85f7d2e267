"""All comparison, containment, null and logical operators.

A comparison with null is never true, as in SQL; only `eq(field, None)` and
`ne(field, None)` ask for null itself.  In a variant column, a field that is null
and a field that is absent differ: `is_null` and `is_none` tell them apart.  In
all other columns both mean null.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import Expr, operand, path, resolve, type_of

__all__ = "eq ne gt gte lt lte contains contains_not contains_all contains_any inside not_inside is_null is_not_null is_none is_not_none and_ or_ not_".split()


def _compared(name: str, x: Any, f: Callable[[Column, Column], Column]) -> Expr:
    def build(df: DataFrame) -> Column:
        own = path(name, df)
        if isinstance(type_of(name, df), T.VariantType):
            kind = "boolean" if isinstance(x, bool) else "bigint" if isinstance(x, int) else "double" if isinstance(x, float) else "string"
            own = F.try_variant_get(own, "$", kind)
        return f(own, operand(x, df))

    return Expr(build)


def eq(name: str, x: Any) -> Expr:
    return is_null(name) if x is None else _compared(name, x, operator.eq)


def ne(name: str, x: Any) -> Expr:
    return is_not_null(name) if x is None else _compared(name, x, operator.ne)


def gt(name: str, x: Any) -> Expr:
    return _compared(name, x, operator.gt)


def gte(name: str, x: Any) -> Expr:
    return _compared(name, x, operator.ge)


def lt(name: str, x: Any) -> Expr:
    return _compared(name, x, operator.lt)


def lte(name: str, x: Any) -> Expr:
    return _compared(name, x, operator.le)


def contains(name: str, x: Any) -> Expr:
    """An array holds an element, or a text holds another."""
    return Expr(lambda df: F.array_contains(path(name, df), operand(x, df)) if isinstance(type_of(name, df), T.ArrayType) else F.contains(path(name, df), operand(x, df)))


def contains_not(name: str, x: Any) -> Expr:
    return ~contains(name, x)


def contains_all(name: str, xs: Sequence[Any]) -> Expr:
    """Each of the values is contained; always so for no values."""
    return Expr(lambda df: reduce(operator.and_, (contains(name, x).build(df) for x in xs), path(name, df).isNotNull()))


def contains_any(name: str, xs: Sequence[Any]) -> Expr:
    return Expr(lambda df: reduce(operator.or_, (contains(name, x).build(df) for x in xs), F.lit(False)))


def inside(name: str, xs: Sequence[Any]) -> Expr:
    return Expr(lambda df: path(name, df).isin(list(xs)))


def not_inside(name: str, xs: Sequence[Any]) -> Expr:
    return ~inside(name, xs)


def is_null(name: str) -> Expr:
    return Expr(lambda df: F.is_variant_null(path(name, df)) if isinstance(type_of(name, df), T.VariantType) else path(name, df).isNull())


def is_not_null(name: str) -> Expr:
    return ~is_null(name)


def is_none(name: str) -> Expr:
    return Expr(lambda df: path(name, df).isNull())


def is_not_none(name: str) -> Expr:
    return Expr(lambda df: path(name, df).isNotNull())


def and_(*xs: Any) -> Expr:
    return Expr(lambda df: reduce(operator.and_, (resolve(x, df) for x in xs)))


def or_(*xs: Any) -> Expr:
    return Expr(lambda df: reduce(operator.or_, (resolve(x, df) for x in xs)))


def not_(x: Any) -> Expr:
    return Expr(lambda df: ~resolve(x, df))
