"""Structured Streaming over tables' logs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.core import resolve
from ..operators import dml
from ..shared import cut
from ..sources.store import Table


def live(table: Table, condition: Any = None) -> DataFrame:
    """A stream of changes (version, id, action, row); the condition is on the row, before delivery.

    A row that is deleted is judged by its original, if the table keeps originals.
    """
    schema = T.StructType([*table.logged.fields, T.StructField("version", T.LongType())])
    out = table.spark.readStream.schema(schema).parquet(f"{table.root}/log")
    if condition is None:
        return out
    subject = F.coalesce("row", "original") if table.originals else F.col("row")
    flat = out.select("*", *[subject[c].alias(f"_{c}") for c in table.schema.names])
    renamed = flat.select(*[F.col(c).alias(f"_log_{c}") for c in out.columns], *[F.col(f"_{c}").alias(c) for c in table.schema.names])
    kept = renamed.where(F.coalesce(resolve(condition, renamed), F.lit(False)))
    return kept.select(*[F.col(f"_log_{c}").alias(c) for c in out.columns])


@dataclass
class Subscriptions:
    """Running live queries by name."""

    checkpoints: str
    running: dict[str, StreamingQuery] = field(default_factory=dict)

    def spawn(self, name: str, stream: DataFrame, callback: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
        """Hands each batch of changes to callback; after a restart it goes on where it stopped."""
        writer = stream.writeStream.queryName(name).foreachBatch(callback).option("checkpointLocation", f"{self.checkpoints}/{name}")
        self.running[name] = (writer.trigger(availableNow=True) if once else writer).start()
        return self.running[name]

    def kill(self, name: str) -> bool:
        if name not in self.running:
            return False
        self.running.pop(name).stop()
        return True

    def count(self) -> int:
        return len(self.names())

    def names(self) -> list[str]:
        return [n for n, q in self.running.items() if q.isActive]

    def drain(self) -> None:
        for n in list(self.running):
            self.kill(n)


def trigger(table: Table, condition: Any, action: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A callback for spawn: action gets the batch's changes for which the condition, over action, row and original, holds."""

    def run(batch: DataFrame, _: int) -> None:
        hit = batch.where(dml.holds(condition, batch))
        if not hit.isEmpty():
            action(hit)

    return run


@dataclass
class CountedView:
    """An aggregate that follows a table: counts and sums by group, kept as a table of their own.

    Each batch is aggregated first and then merged with the rows of its groups, so a commit moves one row for each that changed.
    The table must keep originals, so that what an update or delete takes away is known.
    """

    source: Table
    target: Table
    groups: tuple[str, ...]
    sums: tuple[str, ...] = ()

    def refresh(self, batch: DataFrame, number: int) -> None:
        """A callback for spawn. A batch that is handed over twice counts once, by the versions it holds."""
        done = self.target.read().agg(F.max("seen")).first()[0] or 0
        new = batch.where(F.col("version") > done)
        sign = lambda side, n: new.where(F.col(side).isNotNull()).select(F.col(f"{side}.*"), F.lit(n).alias("_sign"), "version")
        both = sign("row", 1).unionByName(sign("original", -1))
        changes = both.groupBy(*self.groups).agg(F.sum("_sign").alias("total"), F.max("version").alias("seen"), *[F.sum(F.col(c) * F.col("_sign")).alias(c) for c in self.sums])
        changes = cut(changes.withColumn("id", F.concat(F.lit("view:"), F.to_json(F.struct(*self.groups)))))  # a null group lacks its field
        held = self.target.read().join(changes.select("id"), "id", "left_semi")
        merged = changes.unionByName(held, allowMissingColumns=True).groupBy("id", *self.groups).agg(F.sum("total").alias("total"), F.max("seen").alias("seen"), *[F.sum(c).alias(c) for c in self.sums])
        self.target.upsert(merged)

    def read(self) -> DataFrame:
        return self.target.read().where("total > 0").drop("id", "seen")


@dataclass
class QueryView:
    """Any grouped query over tables, kept current: only groups that changed rows belong to are computed again.

    `rows` makes of the tables' rows, by name, those that are grouped, such as a join; `values` are any aggregates by name.
    The groups of changed rows are found among what the tables had and have, so a join whose sides change together misses none.
    """

    sources: dict[str, Table]
    root: str
    rows: Callable[[dict[str, DataFrame]], DataFrame]
    groups: tuple[str, ...]
    values: dict[str, Column]

    def _query(self, rows: DataFrame) -> DataFrame:
        own = rows.groupBy(*self.groups).agg(*[v.alias(n) for n, v in self.values.items()])
        return own.withColumn("id", F.concat(F.lit("view:"), F.to_json(F.struct(*self.groups))))  # a null group lacks its field

    @property
    def target(self) -> Table:
        kind = self._query(self.rows({n: t.read(0) for n, t in self.sources.items()})).schema
        return Table(next(iter(self.sources.values())).spark, self.root, T.StructType([*kind.fields, T.StructField("seen", T.LongType())]))

    def refresh(self) -> int:
        """Brings the view to the tables' versions now, by one commit; returns how many groups were computed."""
        target = self.target
        held, now = target.read(), {n: t.version() for n, t in self.sources.items()}
        seen = {r["id"]: r["seen"] for r in held.where("id LIKE 'seen:%'").select("id", "seen").collect()}  # a row for each table
        whole = {n: t.read(now[n]) for n, t in self.sources.items()}
        touched = None
        if seen:
            moved = {n: self._moved(t, seen[f"seen:{n}"], now[n]) for n, t in self.sources.items()}
            wide = {n: whole[n].unionByName(moved[n]) for n in whole}
            for n in self.sources:
                if seen[f"seen:{n}"] < now[n]:
                    some = self.rows({**wide, n: moved[n]}).select(*self.groups)
                    touched = some if touched is None else touched.unionByName(some)
            if touched is None:
                return 0
            touched = cut(touched.distinct())
        rows = self.rows(whole)
        if touched is not None:
            same = [rows[g].eqNullSafe(touched[g]) for g in self.groups]
            rows = rows.join(touched, same, "left_semi")
        fresh = cut(self._query(rows).withColumn("seen", F.lit(None).cast("long")))
        marks = held.sparkSession.createDataFrame([(f"seen:{n}", v) for n, v in now.items()], "id string, seen long")
        before = held if touched is None else held.join(touched.select(F.concat(F.lit("view:"), F.to_json(F.struct(*self.groups))).alias("id")), "id", "left_semi").unionByName(held.where("id LIKE 'seen:%'"))
        target.commit(target._changes(before, fresh.unionByName(marks, allowMissingColumns=True)), target.version())
        return fresh.count()

    @staticmethod
    def _moved(table: Table, since: int, until: int) -> DataFrame:
        """All rows that changes since a version have made or ended."""
        if not table.originals:
            raise ValueError("a view needs tables that keep originals")
        log = table.log(since + 1, until)
        sides = [log.where(F.col(s).isNotNull()).select(f"{s}.*") for s in ("row", "original")]
        return sides[0].unionByName(sides[1])

    def read(self) -> DataFrame:
        return self.target.read().where("id NOT LIKE 'seen:%'").drop("id", "seen")


def windowed(stream: DataFrame, time: str, length: str, late: str, *keys: Any, slide: str | None = None, **values: Column) -> DataFrame:
    """Aggregates by time window, tumbling or sliding, of rows that are at most `late` behind."""
    own = stream.withWatermark(time, late)
    return own.groupBy(F.window(time, length, slide) if slide else F.window(time, length), *keys).agg(*[v.alias(n) for n, v in values.items()])


def sessions(stream: DataFrame, time: str, gap: str, late: str, key: str, **values: Column) -> DataFrame:
    """Aggregates by sessions of a key: rows no further apart than the gap."""
    own = stream.withWatermark(time, late)
    return own.groupBy(F.session_window(time, gap), key).agg(*[v.alias(n) for n, v in values.items()])
