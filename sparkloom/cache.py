"""Named DataFrames that stay in the executors' memory or disk for a while."""

from __future__ import annotations

import fnmatch
import hashlib
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame


@dataclass
class Cache:
    """Entries live for `ttl` seconds; the oldest goes first when there are more than `most`."""

    ttl: float = 300.0
    most: int = 100
    clock: Callable[[], float] = time.monotonic
    hits: int = 0
    misses: int = 0
    evictions: int = 0
    entries: dict[str, tuple[DataFrame, float, frozenset[str]]] = field(default_factory=dict)

    def get_or_set(self, key: str, make: Callable[[], DataFrame], tables: Iterable[str] = (), ttl: float | None = None) -> DataFrame:
        if key in self.entries and self.entries[key][1] > self.clock():
            self.hits += 1
            return self.entries[key][0]
        self.misses += 1
        self.drop(key)
        df = make().persist(StorageLevel.MEMORY_AND_DISK)
        self.entries[key] = (df, self.clock() + (self.ttl if ttl is None else ttl), frozenset(tables))
        while len(self.entries) > self.most:
            self.drop(next(iter(self.entries)))
            self.evictions += 1
        return df

    def plan(self, df: DataFrame, tables: Iterable[str] = (), ttl: float | None = None) -> DataFrame:
        """df, kept under what its plan computes: another plan that computes the same finds it, whoever has made it.

        A read of a table with a history names its version, so after a commit the plan is another one. Of files that are
        written anew under the same path the plan knows nothing: name their tables, and invalidate them.
        """
        key = f"plan:{df.semanticHash()}"
        while key in self.entries and not self.entries[key][0].sameSemantics(df):  # plans that share a number
            key += "+"
        return self.get_or_set(key, lambda: df, tables, ttl)

    def drop(self, key: str) -> bool:
        if key not in self.entries:
            return False
        self.entries.pop(key)[0].unpersist()
        return True

    def invalidate_table(self, table: str) -> int:
        """Drops what was made from a table; call it when the table has a new version."""
        return sum(self.drop(k) for k in [k for k, (_, _, tables) in self.entries.items() if table in tables])

    def invalidate(self, pattern: str) -> int:
        return sum(self.drop(k) for k in fnmatch.filter(list(self.entries), pattern))

    def clear(self) -> None:
        for k in list(self.entries):
            self.drop(k)

    def cached(self, *tables: str, ttl: float | None = None):
        """A decorator for functions that make DataFrames; arguments are part of the key."""

        def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            def run(*args, **more) -> DataFrame:
                key = hashlib.sha256(f"{f.__module__}.{f.__qualname__}{args!r}{sorted(more.items())!r}".encode()).hexdigest()[:16]
                return self.get_or_set(key, lambda: f(*args, **more), tables, ttl)

            return run

        return wrap
