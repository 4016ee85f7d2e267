"""Migrations: dated files of Spark SQL with an up and a down part, and the history of what was applied."""

from __future__ import annotations

import hashlib
import re
import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .sources.store import Table

# Fixed value: the form of a migration's file name.
_FILE = re.compile(r"(\d{8}_\d{6})_(\w+)\.sql")
HISTORY = T.StructType([T.StructField("id", T.StringType()), T.StructField("description", T.StringType()), T.StructField("checksum", T.StringType()), T.StructField("milliseconds", T.LongType())])


@dataclass(frozen=True)
class Migration:
    version: str
    description: str
    up: tuple[str, ...]
    down: tuple[str, ...]
    checksum: str

    @classmethod
    def load(cls, path: Path) -> Migration:
        found = _FILE.fullmatch(path.name)
        if not found:
            raise ValueError(f"not a migration: {path.name}")
        text = path.read_text()
        parts = dict(re.findall(r"^-- @(up|down)\s*\n(.*?)(?=^-- @|\Z)", text, re.S | re.M))
        if "up" not in parts:
            raise ValueError(f"{path.name} has no up part")
        return cls(found[1], found[2], *(statements(parts.get(k, "")) for k in ("up", "down")), hashlib.sha256(text.encode()).hexdigest())


def statements(text: str) -> tuple[str, ...]:
    """The statements of a text; semicolons inside quotes and comments don't end one."""
    found = re.findall(r"(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?(?:\*/|\Z)|[^;'\"])+", text, re.S)
    return tuple(s for x in found if (s := re.sub(r"^\s*--[^\n]*$|\A\s*/\*.*?(?:\*/|\Z)\s*", "", x, flags=re.M | re.S).strip()))


def discover(folder: str | Path) -> list[Migration]:
    """The folder's migrations in order; other files and those that begin with _ are left out."""
    where = Path(folder)
    return [Migration.load(p) for p in sorted(where.iterdir()) if _FILE.fullmatch(p.name)] if where.is_dir() else []


class Migrator:
    def __init__(self, spark: SparkSession, folder: str | Path, history: str) -> None:
        self.spark, self.folder, self.history = spark, folder, Table(spark, history, HISTORY)

    def applied(self) -> list[str]:
        return [r["id"] for r in self.history.read().select("id").orderBy("id").collect()]

    def pending(self) -> list[Migration]:
        done = set(self.applied())
        return [m for m in discover(self.folder) if m.version not in done]

    def changed(self) -> list[str]:
        """Applied versions whose files are not what they were."""
        now = {m.version: m.checksum for m in discover(self.folder)}
        return [r["id"] for r in self.history.read().collect() if now.get(r["id"]) != r["checksum"]]

    def up(self, steps: int | None = None) -> list[str]:
        """Applies what is pending, in order, and stops at the first failure, which it raises."""
        out = []
        for m in self.pending()[:steps]:
            began = time.time()
            for s in m.up:
                self.spark.sql(s)
            self.history.insert(self.spark.createDataFrame([(m.version, m.description, m.checksum, int(1000 * (time.time() - began)))], HISTORY))
            out.append(m.version)
        return out

    def down(self, steps: int = 1) -> list[str]:
        """Takes back the newest versions; one without a down part is an error."""
        files = {m.version: m for m in discover(self.folder)}
        out = []
        for version in self.applied()[::-1][:steps]:
            if version not in files or not files[version].down:
                raise ValueError(f"{version} can't be taken back")
            for s in files[version].down:
                self.spark.sql(s)
            self.history.delete(f"id = '{version}'")
            out.append(version)
        return out
