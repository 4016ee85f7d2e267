"""An immutable query builder over named tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field as default, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import Expr, path as at_path, resolve
from ..ids import RecordId
from ..operators import dml, fulltext, graph, vector
from ..operators.vectorindex import VectorIndex
from . import hints as hinting

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_HOP = re.compile(r"(<->|->|<-)([A-Za-z_]\w*)")


def named(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a name: {name!r}")
    return name


@dataclass
class Database:
    """Tables by name, edges among them, and what is defined on them."""

    spark: SparkSession
    tables: dict[str, DataFrame] = default(default_factory=dict)
    edges: set[str] = default(default_factory=set)
    views: dict[str, Query] = default(default_factory=dict)
    permissions: dict[str, Any] = default(default_factory=dict)
    #: The column whose value is the key in a table's ids, and edges by such keys in place of ids.
    keys: dict[str, str] = default(default_factory=dict)
    keyed: dict[str, DataFrame] = default(default_factory=dict)
    #: The tables at the ends of such edges: in and out.
    ends: dict[str, tuple[str, str]] = default(default_factory=dict)
    #: Stored vector indexes by table and column, and text indexes; whoever changes a table appends to its indexes.
    indexes: dict[tuple[str, str], VectorIndex] = default(default_factory=dict)

    def record(self, name: str, record: str) -> DataFrame:
        """The row of a record id: by its key, so that the scan can skip what doesn't hold it."""
        df = self.table(name)
        if name not in self.keys:
            return df.where(F.col("id") == record)
        column = self.keys[name]
        return df.where(F.col(column) == F.lit(RecordId.parse(record).key).try_cast(df.schema[column].dataType))

    def table(self, name: str) -> DataFrame:
        """A table or view, with the rows that its permission lets through."""
        df = self.views[name].to_df(self) if name in self.views else self.tables[name]
        rule = self.permissions.get(name)
        return df if rule is None else df.where(dml.holds(rule, df))

    def edges_at(self, name: str, record: str, direction: str = graph.OUT) -> DataFrame:
        """The edges (in, out) at a record: by keys, which the scan can use, where the database has them."""
        if name not in self.ends or name in self.permissions:
            return graph.edges_of(self.table(name), record, direction)
        parsed, df, out = RecordId.parse(record), self.keyed[name], F.lit(False)
        for side, table in zip(("in", "out"), self.ends[name], strict=True):
            if parsed.table == table and direction in (graph.BOTH, graph.OUT if side == "in" else graph.IN):
                out = out | (F.col(side) == F.lit(parsed.key).try_cast(df.schema[side].dataType))
        return df.where(out)

    def related(self, name: str, record: str, direction: str = graph.OUT) -> DataFrame:
        """The rows at the other ends of a record's edges, once for every edge."""
        if name not in self.ends or any(t in self.views for t in self.ends[name]):
            raise ValueError(f"the database has no keys for {name}")
        if direction == graph.BOTH:
            raise ValueError("related records go one way: out or in")
        side, table = ("out", self.ends[name][1]) if direction == graph.OUT else ("in", self.ends[name][0])
        rows = self.table(table)
        at = self.edges_at(name, record, direction).select(F.col(side).alias("_far"))
        return at.join(rows, F.col("_far") == rows[self.keys[table]]).drop("_far")

    def sql(self, text: str, args: Mapping[str, Any] | None = None) -> DataFrame:
        """Spark SQL over the tables and views; `:name` are bound values."""
        for name in [*self.tables, *self.views]:
            if re.search(rf"\b{name}\b", text):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=dict(args or {}))

    def param(self, name: str, value: Any) -> None:
        """A named constant for SQL text: a session variable."""
        self.spark.sql(f"DECLARE OR REPLACE VARIABLE {named(name)} = :value", args={"value": value})

    def many(self, texts: Sequence[str], args: Mapping[str, Any] | None = None) -> list[DataFrame]:
        return [self.sql(t, args) for t in texts]


@dataclass(frozen=True)
class Query:
    """Select, filter, group, order and page; each method returns a new query."""

    sources: tuple[str, ...] = ()
    record: str | None = None
    fields: tuple[Any, ...] = ()
    added: tuple[Any, ...] = ()
    conditions: tuple[Any, ...] = ()
    groups: tuple[Any, ...] = ()
    whole: bool = False
    orders: tuple[tuple[str, bool], ...] = ()
    most: int | None = None
    skipped: int = 0
    joins: tuple[tuple[str, Any, str], ...] = ()
    path: tuple[tuple[str, str], ...] = ()
    nearest: tuple | None = None
    match: tuple | None = None
    links: tuple[tuple[str, str], ...] = ()
    hints: tuple[object, ...] = ()

    def select(self, *fields: Any) -> Query:
        """All columns if no fields are given."""
        return replace(self, fields=fields)

    select_expr = select

    def from_table(self, *targets: str) -> Query:
        """Tables, or one record `table:key`; several tables are rows of each, by column name."""
        record = targets[0] if len(targets) == 1 and ":" in targets[0] else None
        return replace(self, sources=tuple(named(t.partition(":")[0]) for t in targets), record=record)

    def where_(self, condition: Any) -> Query:
        """One more condition: an operator, a column or SQL text; all must hold."""
        return replace(self, conditions=(*self.conditions, condition))

    where_str = where_op = where_

    def order_by(self, name: str, direction: str = "ASC") -> Query:
        """By a column of the result, or a column or dotted path of the rows that it comes from; nulls last either way."""
        if direction.upper() not in ("ASC", "DESC"):
            raise ValueError(f"no such direction: {direction}")
        return replace(self, orders=(*self.orders, (name, direction.upper() == "DESC")))

    def group_by(self, *fields: Any) -> Query:
        return replace(self, groups=(*self.groups, *fields))

    def group_all(self) -> Query:
        """One group of all rows; goes before group_by."""
        return replace(self, whole=True)

    def limit(self, n: int) -> Query:
        if n < 0:
            raise ValueError("limit must be 0 or more")
        return replace(self, most=n)

    def offset(self, n: int) -> Query:
        if n < 0:
            raise ValueError("offset must be 0 or more")
        return replace(self, skipped=n)

    def join(self, table: str, on: Any, how: str = "inner") -> Query:
        return replace(self, joins=(*self.joins, (table, on, how)))

    def traverse(self, path: str) -> Query:
        """Arrows and names, `->placed->orders`: edges and nodes by turns."""
        hops = _HOP.findall(path)
        if "".join(a + b for a, b in hops) != path or not hops:
            raise ValueError(f"not a path: {path!r}")
        return replace(self, path=tuple(hops))

    def reverse_traverse(self, source: str, link: str, name: str, *fields: str) -> Query:
        """A column of the source's rows that link here."""
        return replace(self, added=(*self.added, ("reverse", source, link, name, fields)))

    def fetch(self, link: str, table: str) -> Query:
        return replace(self, links=(*self.links, (link, table)))

    def vector_search(self, field: str, vector_: Sequence[float], k: int, metric: str = "cosine", threshold: float | None = None, key: str = "id") -> Query:
        """The k nearest of the rows that the conditions leave; exact."""
        vector.literal(vector_)
        if k < 1:
            raise ValueError("k must be 1 or more")
        return replace(self, nearest=(field, tuple(vector_), k, metric, threshold, key))

    def vector_search_indexed(self, field: str, vector_: Sequence[float], k: int, key: str = "id", ef: int = 64) -> Query:
        """The k nearest rows by the metric of the database's index on the column; ef is the breadth of its search.

        Without an index, or where conditions or joins leave only some of its rows, the rows are compared by Euclidean
        distance: hashes bound what is compared, and no row is missed.
        """
        vector.literal(vector_)
        if k < 1 or ef < 1:
            raise ValueError("k and ef must be 1 or more")
        return replace(self, nearest=(field, tuple(vector_), k, None, ef, key))

    def similarity_score(self, field: str, vector_: Sequence[float], metric: str, name: str) -> Query:
        return replace(self, added=(*self.added, Expr(lambda df: vector.similarity(metric, F.col(field), vector.literal(vector_)), name)))

    def fulltext_search(self, field: str, query: str, analyzer: fulltext.Analyzer = fulltext.STANDARD, any_: bool = False) -> Query:
        if not field or not query:
            raise ValueError("a field and a query are needed")
        return replace(self, match=(field, query, analyzer, any_, None))

    def search_score(self, name: str) -> Query:
        """A column of BM25 scores, of the search."""
        if not self.match:
            raise ValueError("there is no search to score")
        return replace(self, match=(*self.match[:4], name))

    def hint(self, *hints: object) -> Query:
        return replace(self, hints=(*self.hints, *hints))

    def first(self) -> Query:
        return self if self.most is not None else self.limit(1)

    def last(self) -> Query:
        """The first row of the opposite order."""
        return replace(self, orders=tuple((n, not d) for n, d in self.orders), most=1)

    def _source(self, db: Database) -> DataFrame:
        if not self.sources:
            raise ValueError("no table")
        df = db.table(self.sources[0])
        for name in self.sources[1:]:
            df = df.unionByName(db.table(name), allowMissingColumns=True)
        return db.record(self.sources[0], self.record) if self.record else df

    def _walked(self, db: Database, df: DataFrame) -> DataFrame:
        """The rows of the path's end, once for every path; without a table there, their ids. Where all steps have keys, keys are joined."""
        nodes = [self.sources[0], *(n for _, n in self.path if n not in db.edges)]
        short = len(self.sources) == 1 and self.path[-1][1] not in db.edges and all(n in db.keys for n in nodes) and all(a != "<->" and n in db.keyed for a, n in self.path if n in db.edges)
        key = lambda name: db.keys[name] if short else "id"
        at = graph.starts(df, key(self.sources[0]))
        for k, (arrow, name) in enumerate(self.path):
            if name in db.edges:
                at = graph.hop(at, db.keyed[name] if short else db.table(name), {"->": graph.OUT, "<-": graph.IN, "<->": graph.BOTH}[arrow])
            elif k + 1 < len(self.path):  # the nodes of a table
                at = at.join(db.table(name).select(F.col(key(name)).alias("_node")), F.col("node") == F.col("_node"), "left_semi")
        last = self.path[-1][1]
        if last in db.edges:
            return at.select(F.col("node").alias("id"))
        rows = db.table(last)
        return at.select("node").join(rows, F.col("node") == rows[key(last)]).drop("node")

    def to_df(self, db: Database) -> DataFrame:
        """The query's plan; nothing runs, but a hashed, indexed or full-text search first reads its query."""
        df = self._source(db)
        df = hinting.spread(df, hinting.checked(self.hints, self.sources[0])) if self.hints else df
        for table, on, how in self.joins:
            df = df.join(db.table(table), resolve(on, df) if not isinstance(on, (str, list)) else on if isinstance(on, list) else F.expr(on), how)
        if self.path:
            df = self._walked(db, df)
        for c in self.conditions:
            df = df.where(resolve(c, df))
        if self.match:
            field, query, analyzer, any_, name = self.match
            df = fulltext.bm25(df, field, query, analyzer, any_, name) if name else fulltext.search(df, field, query, analyzer, any_)
        if self.nearest:
            field, near, k, metric, threshold, key = self.nearest
            index = db.indexes.get((self.sources[0], field))
            if metric:
                df = vector.knn(df, field, near, k, metric, key, threshold)
            elif index is None or len(self.sources) > 1 or any((self.record, self.joins, self.path, self.conditions, self.match, self.sources[0] in db.permissions)):
                df = vector.knn_hashed(df, field, near, k, key)
            else:
                found = index.search(near, k, threshold).withColumnRenamed("key", "_key")  # k rows
                df = df.join(F.broadcast(found), F.col(key) == F.col("_key")).drop("_key").orderBy("distance", key)
        for a in self.added:
            if isinstance(a, tuple):
                df = graph.reverse_references(df, db.table(a[1]), a[2], a[3], *a[4])
        df = self._selected(df)
        for link, table in self.links:
            df = graph.fetch(df, link, db.table(table))
        if self.orders:
            by = [F.col(f"_order_{k}") if f"_order_{k}" in df.columns else at_path(n, df) for k, (n, _) in enumerate(self.orders)]
            df = df.orderBy(*[c.desc_nulls_last() if d else c.asc_nulls_last() for c, (_, d) in zip(by, self.orders, strict=True)]).drop(*[f"_order_{k}" for k in range(len(self.orders))])
        df = df.offset(self.skipped) if self.skipped else df
        df = df if self.most is None else df.limit(self.most)
        return hinting.explained(df, self.hints)

    def _ordered(self, source: DataFrame, result: DataFrame) -> list[Column]:
        """Columns of the source that the result is ordered by and doesn't have, under names of their own."""
        out = []
        for k, (name, _) in enumerate(self.orders):
            if name.partition(".")[0] not in result.columns:
                if name.partition(".")[0] not in source.columns:
                    raise ValueError(f"no column to order by: {name}")
                out.append(at_path(name, source).alias(f"_order_{k}"))
        return out

    def _selected(self, df: DataFrame) -> DataFrame:
        added = [a for a in self.added if not isinstance(a, tuple)]
        if self.whole or self.groups:
            if not self.fields:
                raise ValueError("a group needs fields to select")
            keys = [] if self.whole else [resolve(g, df) for g in self.groups]
            names = {g for g in self.groups if isinstance(g, str)} if not self.whole else set()
            values = [resolve(f, df) for f in self.fields if not (isinstance(f, str) and f in names) and not (isinstance(f, Expr) and f.name is None and f in self.groups)]
            out = df.groupBy(*keys).agg(*values)
            self._ordered(out, out)
            return out
        if not self.fields and not added:
            self._ordered(df, df)
            return df
        fields: list[Column] = [F.col(c) for c in df.columns] if not self.fields else []
        for f in (*self.fields, *added):
            fields += [F.col(c) for c in df.columns] if isinstance(f, str) and f == "*" else [resolve(f, df)]
        # What a query is ordered by may be a column that isn't selected.
        return df.select(*fields, *self._ordered(df, df.select(*fields)))
