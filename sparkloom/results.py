"""Results on the driver: single rows, lists, pages and scalars."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import MISSING, dataclass, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .plans import Database, Query


@dataclass(frozen=True)
class ListResult:
    rows: list[dict]
    total: int | None = None
    limit: int | None = None
    offset: int = 0

    @property
    def has_more(self) -> bool:
        """With a total: whether rows come after these; without: whether the limit was reached."""
        if self.limit is None:
            return False
        return self.offset + self.limit < self.total if self.total is not None else len(self.rows) == self.limit


@dataclass(frozen=True)
class Page:
    rows: list[dict]
    page: int
    size: int
    total: int

    @property
    def pages(self) -> int:
        return -(-self.total // self.size) if self.size else 0


def many(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def one(df: DataFrame) -> dict | None:
    rows = many(df.limit(1))
    return rows[0] if rows else None


def scalar(df: DataFrame, name: str, otherwise: Any = None) -> Any:
    """A field of the first row."""
    row = one(df)
    return otherwise if row is None else row.get(name, otherwise)


def typed(df: DataFrame, kind: type) -> list:
    """The rows as objects of a dataclass: its fields by name; one that a row lacks must have a default, columns besides are left out."""
    names = {f.name: f for f in fields(kind)}
    if missing := [n for n, f in names.items() if n not in df.columns and f.default is MISSING and f.default_factory is MISSING]:
        raise ValueError(f"{kind.__name__} needs {', '.join(missing)}")
    return [kind(**r.asDict(recursive=True)) for r in df.select(*[n for n in names if n in df.columns]).collect()]


def typed_one(df: DataFrame, kind: type) -> Any:
    return next(iter(typed(df.limit(1), kind)), None)


def rows_of(spark: SparkSession, objects: Sequence[Any], schema: T.StructType) -> DataFrame:
    """Objects of dataclasses as rows of a schema, to be written; what they lack is null."""
    return spark.createDataFrame([tuple(getattr(x, n, None) for n in schema.names) for x in objects], schema)


def listed(query: Query, db: Database, counted: bool = False) -> ListResult:
    from dataclasses import replace

    total = replace(query, most=None, skipped=0, orders=()).to_df(db).count() if counted else None
    return ListResult(many(query.to_df(db)), total, query.most, query.skipped)


def paged(query: Query, db: Database, page: int, size: int) -> Page:
    """Page 1 and so on, of a query with an order."""
    if page < 1 or size < 1:
        raise ValueError("page and size must be 1 or more")
    total = query.to_df(db).count()
    return Page(many(query.limit(size).offset((page - 1) * size).to_df(db)), page, size, total)


def count_records(db: Database, table: str, condition: Any = None) -> int:
    query = Query().from_table(table)
    return (query if condition is None else query.where_(condition)).to_df(db).count()


def exists(db: Database, record: str) -> bool:
    return not Query().from_table(record).to_df(db).isEmpty()
