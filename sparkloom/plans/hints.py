"""Hints on a query; of each kind the last one counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Parallel:
    """How many tasks work on the rows that a query reads; order and limits come after, and aren't touched."""

    workers: int = 8

    def __post_init__(self) -> None:
        if not 1 <= self.workers <= 32:
            raise ValueError("workers must be from 1 to 32")


@dataclass(frozen=True)
class Timeout:
    seconds: float

    def __post_init__(self) -> None:
        if self.seconds <= 0:
            raise ValueError("seconds must be more than 0")


@dataclass(frozen=True)
class Fetch:
    """How rows come to the driver: eager, lazy or batch."""

    mode: str = "eager"
    size: int = 1000

    def __post_init__(self) -> None:
        if self.mode not in ("eager", "lazy", "batch") or not 1 <= self.size <= 10_000:
            raise ValueError("mode is eager, lazy or batch; a batch has 1 to 10000 rows")


@dataclass(frozen=True)
class Explain:
    full: bool = False


@dataclass(frozen=True)
class Index:
    """An index by name; Spark has none, so it has no effect but its table must be the query's."""

    table: str
    name: str
    force: bool = False


def merged(hints: Sequence[object]) -> list[object]:
    """The last hint of each kind, where the first one of the kind stood."""
    return list({type(h): h for h in hints}.values())


def checked(hints: Sequence[object], table: str) -> list[object]:
    for h in hints:
        if isinstance(h, Index) and h.table != table:
            raise ValueError(f"the hint is for {h.table}, the query for {table}")
    return merged(hints)


def spread(df: DataFrame, hints: Sequence[object]) -> DataFrame:
    """A query's source, dealt as Parallel asks."""
    for h in merged(hints):
        if isinstance(h, Parallel):
            df = df.repartition(h.workers)
    return df


def explained(df: DataFrame, hints: Sequence[object]) -> DataFrame:
    """A query's result, once its plan is printed if Explain asks for it."""
    for h in merged(hints):
        if isinstance(h, Explain):
            df.explain("extended" if h.full else "formatted")
    return df


def rows(df: DataFrame, hints: Sequence[object] = ()):
    """The rows as the Fetch hint asks, under the Timeout hint's limit."""
    import threading

    by = {type(h): h for h in hints}
    context, timer = df.sparkSession.sparkContext, None
    if Timeout in by:
        group = f"query-{id(df)}"
        context.setJobGroup(group, "query with a timeout", interruptOnCancel=True)
        timer = threading.Timer(by[Timeout].seconds, context.cancelJobGroup, [group])
        timer.start()
    try:
        fetch = by.get(Fetch, Fetch())
        yield from df.collect() if fetch.mode == "eager" else df.toLocalIterator(prefetchPartitions=fetch.mode == "batch")
    finally:
        if timer:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
