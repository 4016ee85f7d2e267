"""Queries by free functions, whole queries in one call, and aggregates by options."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..functions import expressions as e
from ..operators import dml, fulltext
from .query import Database, Query

insert, update, upsert, delete, relate = dml.insert, dml.update, dml.upsert, dml.delete, dml.relate


def select(*fields: Any) -> Query:
    return Query().select(*fields)


def from_table(query: Query, *targets: str) -> Query:
    return query.from_table(*targets)


def where_(query: Query, condition: Any) -> Query:
    return query.where_(condition)


def group_by(query: Query, *fields: Any) -> Query:
    return query.group_by(*fields)


def order_by(query: Query, name: str, direction: str = "ASC") -> Query:
    return query.order_by(name, direction)


def limit(query: Query, n: int) -> Query:
    return query.limit(n)


def offset(query: Query, n: int) -> Query:
    return query.offset(n)


def vector_search_query(table: str, column: str, vector: Sequence[float], k: int = 10, metric: str = "cosine", fields: Sequence[str] = (), threshold: float | None = None, key: str = "id") -> Query:
    """The k nearest rows of a table; with fields, those and the distance."""
    query = Query().from_table(table).vector_search(column, vector, k, metric, threshold, key)
    return query.select(*fields, "distance") if fields else query


def similarity_search_query(table: str, column: str, vector: Sequence[float], metric: str = "cosine", name: str = "similarity", fields: Sequence[str] = ()) -> Query:
    """Every row with its similarity, the most similar first."""
    return Query().select(*fields).from_table(table).similarity_score(column, vector, metric, name).order_by(name, "DESC")


def fulltext_search_query(table: str, column: str, text: str, name: str = "score", fields: Sequence[str] = (), analyzer: fulltext.Analyzer = fulltext.STANDARD, any_: bool = False) -> Query:
    """The matching rows with their scores, the best first."""
    query = Query().from_table(table).fulltext_search(column, text, analyzer, any_).search_score(name).order_by(name, "DESC")
    return query.select(*fields, name) if fields else query


@dataclass(frozen=True)
class AggregateOpts:
    """What to compute, by name, over which rows and groups, in which order."""

    values: Mapping[str, Any] = field(default_factory=dict)
    group_by: tuple[str, ...] = ()
    where: tuple[Any, ...] = ()
    order_by: tuple[tuple[str, str], ...] = ()
    limit: int | None = None


def build_aggregate_query(table: str, opts: AggregateOpts) -> Query:
    """Without groups, one of all rows."""
    if not opts.values:
        raise ValueError("nothing to aggregate")
    query = Query().select(*opts.group_by, *[e.as_(x, n) for n, x in opts.values.items()]).from_table(table)
    query = query.group_by(*opts.group_by) if opts.group_by else query.group_all()
    for c in opts.where:
        query = query.where_(c)
    for name, direction in opts.order_by:
        query = query.order_by(name, direction)
    return query if opts.limit is None else query.limit(opts.limit)


def aggregate_records(db: Database, table: str, opts: AggregateOpts) -> DataFrame:
    return build_aggregate_query(table, opts).to_df(db)
