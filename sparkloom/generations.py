"""Folders of immutable generations: each is published by one rename, adds rows, and names keys that count in no older one."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, publish


#: Keys of changes that are broadcast to the rows at most; more are met by a shuffle of both.
BROADCAST_KEYS = 500_000


class Taken(RuntimeError):
    """Another writer has published the generation."""


@dataclass
class Generations:
    """The generations under a folder. One that replaces others holds what counted in them, and they are read no more."""

    spark: SparkSession
    root: str
    _path: object = field(init=False, repr=False)
    _files: object = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self._path, self._files = filesystem(self.spark, self.root)

    def _names(self, at: str) -> list[str]:
        path = self._path(at)
        return [f.getPath().getName() for f in self._files.listStatus(path)] if self._files.exists(path) else []

    def _all(self) -> list[int]:
        return sorted(int(n.removeprefix("gen=")) for n in self._names(self.root) if n.startswith("gen="))

    def numbers(self) -> list[int]:
        """The generations that count, in order."""
        found = self._all()
        gone = {int(x) for n in found for x in self._names(f"{self.root}/gen={n}/replaces")}
        return [n for n in found if n not in gone]

    def read(self, name: str) -> DataFrame | None:
        """A table of all generations that have it, with the column gen; None if none has."""
        parts = [self.spark.read.parquet(f"{self.root}/gen={n}/{name}").withColumn("gen", F.lit(n)) for n in self.numbers() if self._files.exists(self._path(f"{self.root}/gen={n}/{name}"))]
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def alive(self, rows: DataFrame) -> DataFrame:
        """rows (key, gen, ...) with dead: whether a later generation names their key."""
        dead = self.read("dead")
        if dead is None:
            return rows.withColumn("dead", F.lit(False))
        last = dead.groupBy("key").agg(F.max("gen").alias("_dead"))
        last = F.broadcast(last) if dead.count() <= BROADCAST_KEYS else last
        return rows.join(last, "key", "left").withColumn("dead", F.coalesce(F.col("_dead") > F.col("gen"), F.lit(False))).drop("_dead")

    def commit(self, write: Callable[[str], None], replaces: Sequence[int] = (), base: int | None = None) -> int:
        """Publishes what `write` puts into a folder as the generation after base, unless another writer has taken that one."""
        n = (max(self._all(), default=0) if base is None else base) + 1
        staged = f"{self.root}/staged-{uuid.uuid4().hex}"
        self._files.mkdirs(self._path(staged))
        write(staged)
        for x in replaces:
            self._files.mkdirs(self._path(f"{staged}/replaces/{x}"))
        if not publish(self.spark, staged, f"{self.root}/gen={n}"):
            self._files.delete(self._path(staged), True)
            raise Taken(f"another writer has published generation {n}")
        return n

    def latest(self) -> int:
        return max(self._all(), default=0)

    def expire(self) -> int:
        """Deletes the generations that count no more; returns how many."""
        kept = set(self.numbers())
        gone = [n for n in self._all() if n not in kept]
        for n in gone:
            self._files.delete(self._path(f"{self.root}/gen={n}"), True)
        return len(gone)
