"""The query builder: immutable descriptions that become one DataFrame plan."""

from . import helpers, hints
from .query import Database, Query

__all__ = ["Database", "Query", "helpers", "hints"]
