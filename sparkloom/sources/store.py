"""Tables with a history: every commit is a folder of changed rows, and a marker that makes it count.

A commit holds rows with an id, the action (create, update or delete) and, if the
table keeps originals, the row as it was. The commits are the change feed and the
source of live queries too. A commit is published by renaming its folder to the next
version, which fails if another writer has taken that version.

A snapshot holds all rows as of a version, in buckets by a hash of their ids. A read
is the last snapshot without the ids that have changed since, and what they are now,
so that only changes are shuffled, and one id is looked for in one bucket.

The tables of a store change together: one entry of its log, published by one rename,
makes the changes of a transaction to all of its tables count. Writers of different
rows both succeed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import dml
from ..shared import cut, filesystem, publish, scratch

__all__ = ["Conflict", "Store", "Table", "Transaction", "Work", "filesystem", "scratch"]

#: Bytes of changes since a snapshot whose ids are broadcast to it at most; bytes of a bucket, and buckets at most.
BROADCAST_CHANGES, BUCKET, BUCKETS = 1 << 25, 1 << 27, 4096


class Conflict(RuntimeError):
    """Another writer has committed first."""


@dataclass
class Table:
    """A table under a folder. schema has the rows' columns, `id string` among them."""

    spark: SparkSession
    root: str
    schema: T.StructType
    originals: bool = False
    references: dict[str, tuple[Table, str, str]] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    store: Store | None = None

    def __post_init__(self) -> None:
        if "id" not in self.schema.names:
            raise ValueError("rows need an id")
        self._path, self._files = filesystem(self.spark, self.root)
        self._files.mkdirs(self._path(f"{self.root}/log"))
        self._files.mkdirs(self._path(f"{self.root}/snapshots"))

    @property
    def logged(self) -> T.StructType:
        """The columns of the log."""
        out = T.StructType([T.StructField("id", T.StringType()), T.StructField("action", T.StringType()), T.StructField("row", self.schema)])
        return out.add("original", self.schema) if self.originals else out

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [f.getPath().getName() for f in self._files.listStatus(path)] if self._files.exists(path) else []

    def _numbers(self, folder: str) -> list[int]:
        if self.store is not None:
            self.store.settle()
        return sorted(int(n.removeprefix("version=")) for n in self._names(folder) if n.startswith("version="))

    def _oldest(self) -> int:
        """The version of the snapshot that holds what has expired, or 0."""
        return max((int(n.removeprefix("until=")) for n in self._names("expired")), default=0)

    def versions(self) -> list[int]:
        """The versions that can be read: those of commits, and where older ones have expired the snapshot's."""
        oldest = self._oldest()
        return sorted({*(v for v in self._numbers("log") if v >= oldest), *([oldest] if oldest else [])})

    def version(self) -> int:
        """The last version; that of the store, where the table is in one."""
        return self.store.version() if self.store is not None else max(self.versions(), default=0)

    def _bytes(self, path: str) -> int:
        at = self._path(f"{self.root}/{path}")
        return self._files.getContentSummary(at).getLength() if self._files.exists(at) else 0

    def log(self, since: int = 1, until: int | None = None) -> DataFrame:
        """Changes of versions from `since` on, with the column version. Only their folders are read."""
        until = self.version() if until is None else until
        if not self._numbers("log"):
            return self.spark.createDataFrame([], self.logged).withColumn("version", F.lit(0).cast("long"))
        own = self.spark.read.schema(T.StructType([*self.logged.fields, T.StructField("version", T.LongType())])).parquet(f"{self.root}/log")
        return own.where((F.col("version") >= since) & (F.col("version") <= until))

    def read(self, version: int | datetime | None = None, record: str | None = None) -> DataFrame:
        """The rows as of a version or a time, or the one row of an id: the last snapshot's, and each id's last change since, unless that was its end."""
        version = self.version() if version is None else self.version_at(version) if isinstance(version, datetime) else version
        if version < self._oldest():
            raise ValueError(f"version {version} has expired")
        base = max((v for v in self._numbers("snapshots") if v <= version), default=0)
        changes = self.log(base + 1, version)
        if record is not None:
            changes = changes.where(F.col("id") == record)
        last = changes.groupBy("id").agg(F.max_by(F.struct("action", "row"), "version").alias("x"))
        now = last.where(F.col("x.action") != "delete").select(*[F.col("id") if c == "id" else F.col("x.row")[c].alias(c) for c in self.schema.names])
        if not base:
            return now
        held = self._snapshot(base, record)
        size = sum(self._bytes(f"log/version={v}") for v in self._numbers("log") if base < v <= version)
        changed = changes.select(F.col("id").alias("_id"))
        left = held.join(F.broadcast(changed) if size <= BROADCAST_CHANGES else changed, F.col("id") == F.col("_id"), "left_anti")
        return left.unionByName(now)

    def _snapshot(self, version: int, record: str | None = None) -> DataFrame:
        """A snapshot's rows, or those of an id's bucket with that id."""
        of = next(n for n in self._names(f"snapshots/version={version}") if n.startswith("of="))
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(f"{self.root}/snapshots/version={version}/{of}")
        if record is not None:
            rows = rows.where((F.col("_bucket") == _bucket(F.lit(record), int(of.removeprefix("of=")))) & (F.col("id") == record))
        return rows.select(*self.schema.names)

    def snapshot(self, version: int | None = None) -> int:
        """Writes all rows as of a version, for reads from there on, in buckets of about the same size."""
        version = self.version() if version is None else version
        held = self._numbers("snapshots")
        if version and version not in held:
            size = sum(self._bytes(f"log/version={v}") for v in self._numbers("log") if v <= version) + max([self._bytes(f"snapshots/version={v}") for v in held if v < version], default=0)
            of = max(1, min(BUCKETS, math.ceil(size / BUCKET)))
            staged = f"{self.root}/staged-{uuid.uuid4().hex}"
            rows = self.read(version).withColumn("_bucket", _bucket(F.col("id"), of))
            rows.repartition(of, "_bucket").sortWithinPartitions("_bucket", "id").write.partitionBy("_bucket").parquet(f"{staged}/of={of}")
            if not publish(self.spark, staged, f"{self.root}/snapshots/version={version}"):
                self._files.delete(self._path(staged), True)  # another writer's, with the same rows
        return version

    def times(self) -> dict[int, datetime]:
        """When each version of the log was written; a later version is never earlier, whatever its writer's clock says."""
        out, last = {}, 0
        for v in self._numbers("log"):
            at = self._path(f"{self.root}/log/version={v}/_SUCCESS")
            last = max(last, self._files.getFileStatus(at if self._files.exists(at) else at.getParent()).getModificationTime())
            out[v] = datetime.fromtimestamp(last / 1000, timezone.utc)
        return out

    def version_at(self, when: datetime) -> int:
        """The last version that was there at a time, 0 if none was."""
        return max((v for v, t in self.times().items() if t <= when), default=0)

    def _changes(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """What turned before into after, row by row."""
        columns = [F.col(c).cast(self.schema[c].dataType).alias(c) if c in after.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.schema.names]
        new = after.select(F.col("id").alias("_id"), F.struct(*columns).alias("row"), F.lit(True).alias("_new"))
        old = before.select("id", F.struct(*self.schema.names).alias("original"), F.lit(True).alias("_old"))
        both = old.join(new, F.col("id") == F.col("_id"), "full")
        action = F.when(F.col("_old").isNull(), "create").when(F.col("_new").isNull(), "delete").otherwise("update")
        changed = both.where(F.col("_old").isNull() | F.col("_new").isNull() | ~F.col("row").eqNullSafe(F.col("original")))
        out = changed.select(F.coalesce("id", "_id").alias("id"), action.alias("action"), F.when(F.col("_new").isNotNull(), F.col("row")).alias("row"), F.when(F.col("_old").isNotNull(), F.col("original")).alias("original"))
        return out.select("id", "action", "row", "original")

    def commit(self, changes: DataFrame, base: int | None = None) -> int:
        """Publishes changes as the version after base; in a store, by the store's log."""
        if self.store is not None:
            return self.store.commit({self.name: changes}, self.version() if base is None else base, {self.name: (None,)})
        base = self.version() if base is None else base
        staged = f"{self.root}/staged-{uuid.uuid4().hex}"
        changes.select(*self.logged.names).write.parquet(staged)
        if not publish(self.spark, staged, f"{self.root}/log/version={base + 1}"):
            self._files.delete(self._path(staged), True)
            raise Conflict(f"version {base + 1} exists")
        return base + 1

    def _checked(self, changes: DataFrame, base: int) -> DataFrame:
        """changes, once no unique key of theirs is held by another row of what they make of the version base."""
        if not self.unique:
            return changes
        changes = cut(changes)
        new = changes.where(F.col("row").isNotNull()).select("row.*")
        rows = self.read(base).join(changes.select("id"), "id", "left_anti").unionByName(new)
        for columns in self.unique:
            keys = new.select(*columns).distinct()
            held = rows.join(keys, list(columns), "left_semi").groupBy(*columns).agg(F.count("*").alias("_held"))
            twice = held.where("_held > 1").first()  # rows with a null in the key are joined to none
            if twice:
                raise ValueError(f"{', '.join(columns)} {tuple(twice)[:-1]} is held by {twice['_held']} rows")
        return changes

    def write(self, after: DataFrame, base: int | None = None) -> int:
        """Commits whatever differs from the version base."""
        base = self.version() if base is None else base
        return self.commit(self._checked(self._changes(self.read(base), after), base), base)

    def _shaped(self, rows: DataFrame, original: str | None = None) -> DataFrame:
        """id, the row with the table's columns, and the original if it is among them; columns that rows lack are null."""
        own = [(F.col(c) if c in rows.columns else F.lit(None)).cast(self.schema[c].dataType).alias(c) for c in self.schema.names]
        return rows.select(F.col("id").cast("string").alias("id"), F.struct(*own).alias("row"), *([F.col(original).alias("original")] if original else []))

    def _of(self, changed: DataFrame, action: str | None = None) -> DataFrame:
        """The log's columns and the original, from (id, row, original): only rows that a change touches come here."""
        kind = F.when(F.col("original").isNull(), "create").when(F.col("row").isNull(), "delete").otherwise("update")
        return changed.select("id", (F.lit(action) if action else kind).alias("action"), "row", "original")

    def _current(self, rows: DataFrame) -> DataFrame:
        return rows.select("id", F.struct(*self.schema.names).alias("original"))

    def insert(self, rows: DataFrame) -> int:
        """New rows; an id that exists, is null or comes twice is an error. Nothing else is rewritten."""
        return self._run(lambda own: self.inserted(own, rows), ())

    def upsert(self, rows: DataFrame) -> int:
        """Rows take the place of those with their ids; an id that is null or comes twice is an error."""
        return self._run(lambda own: self.upserted(own, rows), ())

    def update(self, values: dict[str, Any], condition: Any = None) -> int:
        """Reads the table, and writes only the rows that change."""
        return self._run(lambda own: self.updated(own, values, condition), (condition,))

    def merge(self, patch: DataFrame) -> int:
        """Fields of the patch for the rows with its ids."""
        return self._run(lambda own: self.merged(own, patch), ())

    def _run(self, statement: Callable[[DataFrame], DataFrame], reads: tuple) -> int:
        base = self.version()
        changes = self._checked(statement(self.read(base)), base)
        if self.store is None:
            return self.commit(changes, base)
        return self.store.commit({self.name: changes}, base, {self.name: reads})

    @property
    def name(self) -> str:
        return self.root.rpartition("/")[2]

    # What statements change, of the rows that they find.

    def inserted(self, own: DataFrame, rows: DataFrame) -> DataFrame:
        new = cut(self._shaped(rows))
        _distinct(new)
        if not new.join(own.select("id"), "id", "left_semi").isEmpty():
            raise ValueError("an id exists already")
        return self._of(new.withColumn("original", F.lit(None).cast(self.schema)), "create")

    def upserted(self, own: DataFrame, rows: DataFrame) -> DataFrame:
        new = cut(self._shaped(rows))
        _distinct(new)
        both = new.join(self._current(own), "id", "left")
        return self._of(both.where(F.col("original").isNull() | ~F.col("row").eqNullSafe(F.col("original"))))

    def updated(self, own: DataFrame, values: Mapping[str, Any], condition: Any = None) -> DataFrame:
        hit = own.where(dml.holds(condition, own)).withColumn("_original", F.struct(*self.schema.names))
        after = self._shaped(dml.update(hit, values), "_original")
        return self._of(after.where(~F.col("row").eqNullSafe(F.col("original"))), "update")

    def merged(self, own: DataFrame, patch: DataFrame) -> DataFrame:
        patch = cut(patch)
        _distinct(patch)
        hit = own.join(patch.select("id"), "id", "left_semi").withColumn("_original", F.struct(*self.schema.names))
        after = self._shaped(dml.merge(hit, patch), "_original")
        return self._of(after.where(~F.col("row").eqNullSafe(F.col("original"))), "update")

    def removed(self, own: DataFrame, condition: Any = None) -> DataFrame:
        return self._removed(own.where(dml.holds(condition, own)))

    def delete(self, condition: Any = None) -> int:
        """Deletes rows; the tables that refer here follow, and those that refer there.

        In a store all tables change by one commit, and are seen so or not at all; other tables commit one after the other.
        What follows is found first: a row that stays and rejects the deletion leaves all tables as they were.
        """
        base = self.version()
        versions = {self.root: base}
        read = lambda table: table.read(base if table.store is not None else versions.setdefault(table.root, table.version()))
        changes = deleted(self, condition, read)
        if self.store is not None:
            return self.store.commit({t.name: c for t, c in changes}, base, {t.name: (None,) for t, _ in changes} | {self.name: (condition,)})
        out = base
        for table, rows in changes:
            made = table.commit(rows, versions[table.root])
            out = made if table is self else out
        return out

    def _removed(self, hit: DataFrame) -> DataFrame:
        """The log's rows of what is deleted."""
        return self._of(self._current(hit).withColumn("row", F.lit(None).cast(self.schema)), "delete")

    def over(self, own: DataFrame, changes: DataFrame | None) -> DataFrame:
        """own after changes that aren't committed."""
        if changes is None:
            return own
        left = own.join(changes.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")
        return left.unionByName(changes.where(F.col("row").isNotNull()).select("row.*"))

    def together(self, before: DataFrame | None, then: DataFrame) -> DataFrame:
        """Two changes as one, a row for each id: what was there at first, and what is in the end."""
        if before is None:
            return cut(then)
        a = before.select("id", F.struct("action", "row", "original").alias("a"))
        b = then.select("id", F.struct("action", "row", "original").alias("b"))
        both = a.join(b, "id", "full").select("id", F.coalesce("b.row", F.when(F.col("b").isNull(), F.col("a.row"))).alias("row"), F.when(F.col("a").isNull(), F.col("b.original")).otherwise(F.col("a.original")).alias("original"))
        return cut(self._of(both.where(F.col("row").isNotNull() | F.col("original").isNotNull())))

    def returned(self, version: int, form: str = dml.AFTER) -> DataFrame:
        """What the statement that made a version returns."""
        return dml.returned(self.read(version - 1), self.read(version), form)

    def changes(self, since: int | datetime, limit: int | None = None) -> DataFrame:
        """The change feed: (version, changes) of the versions from `since` on, or written after a time, in order; of what hasn't expired."""
        if limit is not None and limit < 1:
            raise ValueError("limit must be 1 or more")
        since = self.version_at(since) + 1 if isinstance(since, datetime) else since
        kept = [v for v in self._numbers("log") if v >= since][:limit]
        if not kept:
            return self.spark.createDataFrame([], self.logged).withColumn("version", F.lit(0).cast("long"))
        return self.log(kept[0], kept[-1]).orderBy("version", "id")

    def expire(self, keep: int | timedelta, now: datetime | None = None) -> int:
        """Deletes all commits but the newest `keep`, or those of the last time of that length, once a snapshot holds what they made; returns the oldest version left.

        A reader sees the table whole at any time: the snapshot is in place before anything goes.
        """
        held = self.versions()
        if isinstance(keep, timedelta):
            at = self.version_at((now or datetime.now(timezone.utc)) - keep)
        else:
            at = held[-keep - 1] if len(held) > keep else 0
        if not at or at <= self._oldest():
            return held[0] if held else 0
        self.snapshot(at)
        self._files.mkdirs(self._path(f"{self.root}/expired/until={at}"))
        for folder, last in (("log", at), ("snapshots", at - 1)):
            for v in self._numbers(folder):
                if v <= last:
                    self._files.delete(self._path(f"{self.root}/{folder}/version={v}"), True)
        return at


def _bucket(id_, of: int):
    return F.pmod(F.xxhash64(id_), F.lit(of)).cast("int")


def _distinct(rows: DataFrame) -> None:
    """Raises for an id that is null or comes twice."""
    if not rows.where("id IS NULL").isEmpty():
        raise ValueError("an id is null")
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"{twice['id']} comes {twice['n']} times")


def deleted(table: Table, condition: Any, read: Callable[[Table], DataFrame]) -> list[tuple[Table, DataFrame]]:
    """What deleting rows of a table changes in all tables: those that refer to what goes follow, until nothing more goes."""
    own = read(table)
    tables, gone = {table.root: table}, {table.root: cut(own.where(dml.holds(condition, own)).select(F.col("id").alias("_gone")))}
    new = dict(gone)
    while new:
        found: dict[str, DataFrame] = {}
        for at, ids in new.items():
            for other, link, action in tables[at].references.values():
                tables.setdefault(other.root, other)
                if action == "cascade":
                    more = dml.referring(read(other), link, ids).select(F.col("id").alias("_gone"))
                    for known in (gone.get(other.root), found.get(other.root)):
                        more = more if known is None else more.join(known, "_gone", "left_anti")
                    more = cut(more)
                    if not more.isEmpty():
                        found[other.root] = found[other.root].unionByName(more) if other.root in found else more
        for at, more in found.items():
            gone[at] = gone[at].unionByName(more) if at in gone else more
        new = found
    left = {at: read(t).join(gone[at], F.col("id") == F.col("_gone"), "left_anti") if at in gone else read(t) for at, t in tables.items()}
    after: dict[str, DataFrame] = {}
    for at in gone:
        for n, (other, link, action) in tables[at].references.items():
            hit = dml.referring(left[other.root], link, gone[at])
            if action == "reject" and not hit.isEmpty():
                raise dml.Rejected(f"{n}.{link} refers to what is to be deleted")
            if action == "unset":
                now = after.get(other.root)
                rows = hit if now is None else now.unionByName(hit.join(now.select("id"), "id", "left_anti"))
                after[other.root] = dml.unset(rows, link, gone[at])
    out = []
    for at, t in tables.items():
        changes = t._removed(read(t).join(gone[at], F.col("id") == F.col("_gone"), "left_semi")) if at in gone else None
        if at in after:
            both = t._shaped(after[at]).join(t._current(read(t)), "id")
            more = t._of(both.where(~F.col("row").eqNullSafe(F.col("original"))), "update")
            changes = more if changes is None else changes.unionByName(more)
        if changes is not None:
            out.append((t, changes))
    return out


@dataclass
class Store:
    """Tables under a folder with one log of commits. An entry names a folder with each table's changes; the version of all tables is its number.

    The entry is published by one rename; until then nothing of it counts. What it names then moves to the tables' own logs,
    and whoever finds an entry whose changes haven't moved, as its writer was lost, moves them first.
    """

    spark: SparkSession
    root: str
    tables: dict[str, Table] = field(default_factory=dict)
    settled: int = 0

    def __post_init__(self) -> None:
        self._path, self._files = filesystem(self.spark, self.root)
        self._files.mkdirs(self._path(f"{self.root}/commits"))

    def table(self, name: str, schema: T.StructType, **more: Any) -> Table:
        """A table of the store, by a name; more are the table's other settings."""
        self.tables[name] = Table(self.spark, f"{self.root}/tables/{name}", schema, store=self, **more)
        return self.tables[name]

    def _names(self, at: str) -> list[str]:
        path = self._path(f"{self.root}/{at}")
        return [f.getPath().getName() for f in self._files.listStatus(path)] if self._files.exists(path) else []

    def version(self) -> int:
        return max((int(n.removeprefix("commit=")) for n in self._names("commits")), default=0)

    def settle(self) -> None:
        """Moves what published entries name to the tables' logs."""
        last = self.version()
        for n in range(self.settled + 1, last + 1):
            for batch in self._names(f"commits/commit={n}"):
                batch = batch.removeprefix("from=")
                for name in self._names(f"data/{batch}"):
                    self._files.mkdirs(self._path(f"{self.root}/tables/{name}/log"))
                    at = f"{self.root}/tables/{name}/log/version={n}"
                    if not self._files.exists(self._path(at)):
                        publish(self.spark, f"{self.root}/data/{batch}/{name}", at)
        self.settled = max(self.settled, last)

    def commit(self, changes: Mapping[str, DataFrame], base: int, reads: Mapping[str, tuple] = {}) -> int:
        """Publishes changes of tables, made of the version base. Whoever has since changed a row that these change, or one that a condition they read by holds for, is a conflict."""
        batch = uuid.uuid4().hex
        for name, rows in changes.items():
            rows.select(*self.tables[name].logged.names).write.parquet(f"{self.root}/data/{batch}/{name}")
        while True:
            now = self.version()
            if now > base:
                self.settle()
                try:
                    self._compared(batch, changes, reads, base, now)
                except Conflict:
                    self._files.delete(self._path(f"{self.root}/data/{batch}"), True)
                    raise
                base = now
            entry = f"{self.root}/staged-{uuid.uuid4().hex}"
            self._files.mkdirs(self._path(f"{entry}/from={batch}"))
            if publish(self.spark, entry, f"{self.root}/commits/commit={now + 1}"):
                self.settle()
                return now + 1
            self._files.delete(self._path(entry), True)

    def _compared(self, batch: str, changes: Mapping[str, DataFrame], reads: Mapping[str, tuple], base: int, now: int) -> None:
        for name in {*changes, *reads}:
            table = self.tables[name]
            theirs = table.log(base + 1, now)
            if name in changes:
                mine = self.spark.read.schema(table.logged).parquet(f"{self.root}/data/{batch}/{name}")
                if not theirs.join(mine.select("id"), "id", "left_semi").isEmpty():
                    raise Conflict(f"rows of {name} have changed since version {base}")
            conditions = (None,) if table.unique and name in changes else reads.get(name, ())
            for side in ("row", *(["original"] if table.originals else [])):
                rows = theirs.where(F.col(side).isNotNull()).select(f"{side}.*")
                if any(not rows.where(dml.holds(c, rows)).isEmpty() for c in conditions):
                    raise Conflict(f"rows of {name} that were read have changed since version {base}")
            if any(c is None for c in conditions) and not theirs.isEmpty():
                raise Conflict(f"{name} has changed since version {base}")


@dataclass
class Work:
    """Statements on the tables of a store that count together or not at all; each sees what those before it did."""

    store: Store
    base: int = field(init=False)
    pending: dict[str, DataFrame] = field(default_factory=dict)
    reads: dict[str, tuple] = field(default_factory=dict)
    open: bool = True

    def __post_init__(self) -> None:
        self.store.settle()
        self.base = self.store.version()

    def rows(self, name: str) -> DataFrame:
        """A table as the statements so far leave it."""
        return self._seen(self.store.tables[name])

    def _seen(self, table: Table) -> DataFrame:
        return table.over(table.read(self.base), self.pending.get(table.name))

    def _add(self, name: str, changes: DataFrame, *conditions: Any) -> Work:
        if not self.open:
            raise RuntimeError("the transaction is over")
        self.pending[name] = self.store.tables[name].together(self.pending.get(name), changes)
        self.reads[name] = (*self.reads.get(name, ()), *conditions)
        return self

    def insert(self, name: str, rows: DataFrame) -> Work:
        return self._add(name, self.store.tables[name].inserted(self.rows(name), rows))

    def upsert(self, name: str, rows: DataFrame) -> Work:
        return self._add(name, self.store.tables[name].upserted(self.rows(name), rows))

    def update(self, name: str, values: Mapping[str, Any], condition: Any = None) -> Work:
        return self._add(name, self.store.tables[name].updated(self.rows(name), values, condition), condition)

    def merge(self, name: str, patch: DataFrame) -> Work:
        return self._add(name, self.store.tables[name].merged(self.rows(name), patch))

    def delete(self, name: str, condition: Any = None) -> Work:
        """With what refers to the rows that go, by the tables' references."""
        for table, changes in deleted(self.store.tables[name], condition, self._seen):
            self._add(table.name, changes, condition if table.name == name else None)
        return self

    def commit(self) -> int:
        if not self.open:
            raise RuntimeError("the transaction is over")
        self.open = False
        checked = {n: self.store.tables[n]._checked(c, self.base) for n, c in self.pending.items()}
        return self.store.commit(checked, self.base, self.reads) if checked else self.base

    def rollback(self) -> None:
        self.open, self.pending = False, {}


@dataclass
class Transaction:
    """Statements on a table that count together or not at all."""

    table: Table
    base: int = 0
    state: DataFrame | None = None
    pending: DataFrame | None = None
    open: bool = True

    def __post_init__(self) -> None:
        self.base = self.table.version()
        self.state = self.table.read(self.base)

    def run(self, f, *args: Any) -> Transaction:
        """A statement of the module dml, on the state so far; what it changes is kept, not the whole table."""
        if not self.open:
            raise RuntimeError("the transaction is over")
        table = self.table
        known = {dml.insert: table.inserted, dml.upsert: table.upserted, dml.update: table.updated, dml.merge: table.merged, dml.delete: table.removed}
        changes = known[f](self.state, *args) if f in known else table._changes(self.state, f(self.state, *args))
        self.pending = table.together(self.pending, changes)
        self.state = table.over(table.read(self.base), self.pending)
        return self

    def commit(self) -> int:
        if not self.open:
            raise RuntimeError("the transaction is over")
        self.open = False
        if self.pending is None:
            return self.base
        return self.table.commit(self.table._checked(self.pending, self.base), self.base)

    def rollback(self) -> None:
        self.open, self.state, self.pending = False, None, None
