"""Expressions that become columns once it is known what they are applied to."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Expr:
    """A column in waiting: some operators depend on the types of the rows' columns."""

    def __init__(self, build: Callable[[DataFrame], Column], name: str | None = None) -> None:
        self.build, self.name = build, name

    def __repr__(self) -> str:
        """The operators and operands that it was made of: equal for equal expressions, in every run."""
        return _described(self.build) + (f" AS {self.name}" if self.name else "")

    def alias(self, name: str) -> Expr:
        return Expr(self.build, name)

    def column(self, df: DataFrame) -> Column:
        out = self.build(df)
        return out.alias(self.name) if self.name else out

    def _with(self, other: Any, f: Callable[[Column, Column], Column]) -> Expr:
        return Expr(lambda df: f(self.build(df), operand(other, df)))

    def __add__(self, other: Any) -> Expr:
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other: Any) -> Expr:
        return self._with(other, lambda a, b: a - b)

    def __mul__(self, other: Any) -> Expr:
        return self._with(other, lambda a, b: a * b)

    def __truediv__(self, other: Any) -> Expr:
        """Division by zero is null."""
        return self._with(other, F.try_divide)

    def __and__(self, other: Any) -> Expr:
        return self._with(other, lambda a, b: a & b)

    def __or__(self, other: Any) -> Expr:
        return self._with(other, lambda a, b: a | b)

    def __invert__(self) -> Expr:
        return Expr(lambda df: ~self.build(df))


def _described(x: Any) -> str:
    """A function as its name, its code and what it has taken from around it; anything else as it prints."""
    if isinstance(x, list | tuple):
        return f"[{', '.join(map(_described, x))}]"
    code = getattr(x, "__code__", None)
    if code is None:
        return repr(x)
    held = [c.cell_contents for c in x.__closure__ or ()] + list(x.__defaults__ or ())
    return f"{x.__qualname__}#{zlib.crc32(code.co_code + repr(code.co_names).encode()):08x}({', '.join(map(_described, held))})"


def operand(x: Any, df: DataFrame) -> Column:
    """A right-hand side: expressions and columns as they are, all else a literal."""
    return x.build(df) if isinstance(x, Expr) else x if isinstance(x, Column) else F.lit(x)


def resolve(x: Any, df: DataFrame) -> Column:
    """Something to select or filter by: text is SQL."""
    return x.column(df) if isinstance(x, Expr) else x if isinstance(x, Column) else F.expr(x)


def type_of(name: str, df: DataFrame) -> T.DataType:
    """The type of a column or a dotted path into structs; what lies in a variant is a variant."""
    kind: T.DataType = df.schema
    for part in name.split("."):
        if isinstance(kind, T.VariantType):
            return kind
        kind = kind[part].dataType if isinstance(kind, T.StructType) else T.NullType()
    return kind


def path(name: str, df: DataFrame) -> Column:
    """A column, a field of a struct, or a path into a variant."""
    root, _, rest = name.partition(".")
    if rest and root in df.columns and isinstance(df.schema[root].dataType, T.VariantType):
        return F.try_variant_get(F.col(root), f"$.{rest}", "variant")
    return F.col(name)


def field(name: str) -> Expr:
    return Expr(lambda df: path(name, df))


def value(x: Any) -> Expr:
    return Expr(lambda df: F.lit(x))


def raw(sql: str) -> Expr:
    """A fragment of Spark SQL."""
    return Expr(lambda df: F.expr(sql))
