"""Expressions, predicates and aggregates over columns."""

from .core import Expr, field, raw, resolve, value
from .expressions import *  # noqa: F403
from .predicates import *  # noqa: F403

__all__ = ["Expr", "field", "raw", "resolve", "value"]
