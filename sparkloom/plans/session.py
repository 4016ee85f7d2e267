"""A database as a caller may see and change it.

Rules are given by table and action: a condition over the table's rows, or a function
from the caller's values to one; True and False allow all rows and none, and what has
no rule is allowed. They hold for queries, for hops (an edge shows only between rows that
show), for writes and for live queries alike.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import Expr, resolve
from ..operators import dml
from ..sources import Table
from .query import Database, Query

SELECT, CREATE, UPDATE, DELETE = "select", "create", "update", "delete"


class Forbidden(PermissionError):
    """A row that the caller may not write."""


@dataclass(frozen=True)
class Session:
    """tables are stored ones, which the caller may change; the database's others can only be read."""

    db: Database
    caller: Mapping[str, Any]
    rules: Mapping[str, Mapping[str, Any]]
    tables: Mapping[str, Table] = field(default_factory=dict)

    def rule(self, name: str, action: str) -> Any:
        """The condition of an action for this caller; None if there is none."""
        found = self.rules.get(name, {}).get(action)
        found = found(self.caller) if isinstance(found, Callable) and not isinstance(found, Expr | Column) else found
        return F.lit(found) if isinstance(found, bool) else found

    def _allowed(self, name: str, action: str, rows: DataFrame) -> DataFrame:
        rule = self.rule(name, action)
        return rows if rule is None else rows.where(dml.holds(rule, rows))

    def database(self) -> Database:
        """The database with the rows that show. Edges and nodes that a rule hides are in no hop."""
        raw = {**self.db.tables, **{n: t.read() for n, t in self.tables.items()}}
        shown = {n: self._allowed(n, SELECT, df) for n, df in raw.items()}
        keyed, ends = dict(self.db.keyed), dict(self.db.ends)
        for name in self.db.edges:
            hidden = [t for t in self.db.ends.get(name, ()) if self.rule(t, SELECT) is not None]
            for t, side in zip(self.db.ends.get(name, ()), ("in", "out"), strict=False):
                if t in hidden:
                    shown[name] = shown[name].join(shown[t].select(F.col("id").alias(side)), side, "left_semi").select(*raw[name].columns)
            if hidden or self.rule(name, SELECT) is not None:  # keys alone don't say which rows show
                keyed.pop(name, None)
                ends.pop(name, None)
        indexes = {k: v for k, v in self.db.indexes.items() if self.rule(k[0], SELECT) is None}
        return Database(self.db.spark, shown, set(self.db.edges), dict(self.db.views), dict(self.db.permissions), dict(self.db.keys), keyed, ends, indexes)

    def run(self, query: Query) -> DataFrame:
        return query.to_df(self.database())

    def read(self, name: str) -> DataFrame:
        return self.database().table(name)

    def _refused(self, name: str, action: str, rows: DataFrame) -> None:
        rule = self.rule(name, action)
        if rule is not None and not rows.where(~dml.holds(rule, rows)).isEmpty():
            raise Forbidden(f"{action} on {name}")

    def insert(self, name: str, rows: DataFrame) -> int:
        """Rows that the caller may create; one that it may not refuses all."""
        table = self.tables[name]
        self._refused(name, CREATE, table._shaped(rows).select("row.*"))
        return table.insert(rows)

    def upsert(self, name: str, rows: DataFrame) -> int:
        """Rows that exist must be such as the caller may change, before and after; others such as it may create."""
        table = self.tables[name]
        new = table._shaped(rows).select("row.*")
        held = table.read()
        self._refused(name, UPDATE, held.join(new.select("id"), "id", "left_semi"))
        self._refused(name, UPDATE, new.join(held.select("id"), "id", "left_semi"))
        self._refused(name, CREATE, new.join(held.select("id"), "id", "left_anti"))
        return table.upsert(rows)

    def _both(self, name: str, action: str, condition: Any) -> Any:
        """A condition, of rows that show and that the action is allowed on."""
        parts = [c for c in (condition, self.rule(name, SELECT), self.rule(name, action)) if c is not None]
        if not parts:
            return None

        def build(df: DataFrame) -> Column:
            out = F.lit(True)
            for c in parts:
                out = out & F.coalesce(resolve(c, df), F.lit(False))
            return out

        return Expr(build)

    def update(self, name: str, values: Mapping[str, Any], condition: Any = None) -> int:
        """Of the rows that the condition holds for, those that the caller may change; they must be such afterwards, too."""
        table = self.tables[name]
        own = table.read()
        hit = own.where(dml.holds(self._both(name, UPDATE, condition), own))
        self._refused(name, UPDATE, dml.update(hit, values).select(*own.columns))
        return table.update(dict(values), self._both(name, UPDATE, condition))

    def delete(self, name: str, condition: Any = None) -> int:
        return self.tables[name].delete(self._both(name, DELETE, condition))

    def live(self, name: str, condition: Any = None) -> DataFrame:
        """A stream of changes to rows that show."""
        from ..streaming import feeds

        return feeds.live(self.tables[name], self._both(name, SELECT, condition))
