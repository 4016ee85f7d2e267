"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable Parquet shards.  Shards belong to tiers
by size; where a tier has FANOUT shards or more, they are merged into files of
about the target size, and a shard of more than twice the target is split.
Every append and every merge ends with a manifest of the next version, which a
rename to a name that must not exist makes visible at once, so of several writers
of a version one gets it and the others fail; until then readers see the old
version whole, and a failed job leaves nothing but files that no manifest names.

A shard set keeps every row and column as it came, nulls (in ids, too), repeated
rows and empty texts included, whatever the columns are called; the order of rows
is not kept.  An empty arrival makes a version without new shards; only a set's
first has an empty shard, which holds the columns.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import publish

#: Bytes of a finished shard on disk (three to five times as many when read), the ratio of sizes in a tier and the shards that fill it, bytes of the lowest tier.
TARGET, FANOUT, LOWEST = 32 << 20, 4, 1 << 20
#: Shards that a round merges at most, about; the next round goes on. Their names are on the driver and broadcast.
ROUND = 20_000
#: Rows of a manifest's file.
LISTED = 200_000


def _free(name: str, taken: list[str]) -> str:
    """name, with as many underscores before it as it takes."""
    while name.lower() in (c.lower() for c in taken):
        name = f"_{name}"
    return name


class ShardSet:
    """Shards under a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT) -> None:
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target, fanout
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(f"{self.root}/manifests"))

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        names = [f.getPath().getName() for f in self._files.listStatus(self._path(f"{self.root}/manifests"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """file, bytes and tier of a version's shards."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], "file string, bytes long, tier int")
        return self.spark.read.schema("file string, bytes long, tier int").parquet(f"{self.root}/manifests/{version}")

    def _commit(self, shards: DataFrame, base: int) -> int:
        """Publishes shards as the version after base; fails if another writer was first."""
        staged = f"{self.root}/staged-{uuid.uuid4().hex}"
        shards.write.option("maxRecordsPerFile", LISTED).parquet(staged)  # a row for each file
        if not publish(self.spark, staged, f"{self.root}/manifests/{base + 1}"):
            self._files.delete(self._path(staged), True)
            raise RuntimeError(f"version {base + 1} exists: another writer committed first")
        return base + 1

    def _listed(self, folder: str) -> DataFrame:
        """The shards that a job wrote into a folder, with their tiers."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
        tier = F.greatest(F.lit(0), F.floor(F.log(F.col("length") / LOWEST) / F.log(F.lit(float(self.fanout))))).cast("int")
        return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), tier.alias("tier"))

    def append(self, arrivals: DataFrame) -> int:
        """Writes arrivals as shards, one for each of its partitions, and commits them."""
        base, folder = self.version(), f"{self.root}/data/{uuid.uuid4().hex}"
        arrivals.write.option("compression", "zstd").parquet(folder)
        known = self.manifest(base)
        nothing = self.spark.read.parquet(folder).isEmpty() and not known.isEmpty()
        return self._commit(known if nothing else known.unionByName(self._listed(folder)), base)

    def plan(self, version: int | None = None) -> DataFrame:
        """file, part and split: shards below half the target, in tiers that are full, dealt in order to parts of about the
        target size, and shards above twice the target. A part is written as `split` shards.
        """
        known = self.manifest(version)
        small, large = known.where(F.col("bytes") < self.target / 2), known.where(F.col("bytes") > 2 * self.target)
        full = small.join(F.broadcast(small.groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= self.fanout)), "tier")  # a row for each tier
        round_ = full.orderBy("tier", "bytes", "file").limit(ROUND)
        before = F.sum("bytes").over(Window.partitionBy("tier").orderBy("bytes", "file").rowsBetween(Window.unboundedPreceding, -1))  # ROUND rows at most
        part = round_.withColumn("part", F.concat_ws("-", "tier", F.floor(F.coalesce(before, F.lit(0)) / self.target)))
        merged = part.withColumn("m", F.count("*").over(Window.partitionBy("part"))).where("m > 1").select("file", "part", F.lit(1).alias("split"))
        split = large.select("file", F.col("file").alias("part"), F.ceil(F.col("bytes") / self.target).cast("int").alias("split"))
        return merged.unionByName(split.orderBy("file").limit(ROUND))

    def compact(self) -> int:
        """One round of merges and splits; returns the number of shards that were rewritten.

        Rows move once, to the part their shard belongs to; each part is a task of bounded size, whatever the rows' keys.
        """
        base = self.version()
        planned = self.plan(base).collect()  # ROUND names of small and of large files at most
        if not planned:
            return 0
        first, parts = {}, 0
        for r in planned:
            if r["part"] not in first:
                first[r["part"]], parts = parts, parts + r["split"]
        numbered = self.spark.createDataFrame([(r["file"], first[r["part"]], r["split"]) for r in planned], "file string, first int, split int")
        rows = self._rows([r["file"] for r in planned])
        columns = rows.columns
        of, first_, split, part = (_free(c, columns) for c in ("_of_file", "_first", "_split", "_part"))
        place = F.broadcast(numbered.select(F.col("file").alias(of), F.col("first").alias(first_), F.col("split").alias(split)))
        own = rows.withColumn(part, F.col("_metadata.file_path")).join(place, F.col(part) == F.col(of))
        dealt = own.withColumn(part, F.col(first_) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(split)).cast("int"))
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        dealt.select(*columns, part).repartitionById(parts, part).drop(part).write.option("compression", "zstd").parquet(folder)
        old = self.manifest(base).join(F.broadcast(numbered.select("file")), "file", "left_anti")
        self._commit(old.unionByName(self._listed(folder)), base)
        return len(planned)

    def _rows(self, files: list[str]) -> DataFrame:
        """The rows of some shards; their folders' names are no columns."""
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*files)

    def expire(self, keep: int = 1) -> None:
        """Deletes shards and manifests that none of the newest `keep` versions names."""
        now = self.version()
        live = {r["file"] for v in range(max(1, now - keep + 1), now + 1) for r in self.manifest(v).select("file").collect()}
        for v in range(1, now - keep + 1):
            self._files.delete(self._path(f"{self.root}/manifests/{v}"), True)
        if not self._files.exists(self._path(f"{self.root}/data")):
            return
        each = self._files.listFiles(self._path(f"{self.root}/data"), True)
        plain = {self._path(f).toUri().getPath() for f in live}
        while each.hasNext():
            path = each.next().getPath()
            if path.getName().endswith(".parquet") and path.toUri().getPath() not in plain:
                self._files.delete(path, False)

    def read(self, version: int | None = None, shard: str = "shard") -> DataFrame:
        """A version's rows with all their columns, and the name of each one's shard in one more, the last.

        It is called `shard`, with underscores before it where the rows have such a column.
        """
        files = [r["file"] for r in self.manifest(version).select("file").collect()]
        if not files:
            raise ValueError("the version has no shards")
        rows = self._rows(files)
        return rows.withColumn(_free(shard, rows.columns), F.element_at(F.split(F.col("_metadata.file_path"), "/data/"), -1))


def ingest(arrivals: list[DataFrame], shards: ShardSet) -> ShardSet:
    """Appends each arrival and merges what has become mergeable; only the newest version stays on disk."""
    for df in arrivals:
        shards.append(df)
        while shards.compact():
            pass
        shards.expire()
    return shards


def describe(shards: ShardSet) -> str:
    """The newest version's shards as JSON."""
    return json.dumps({"version": shards.version(), "shards": [r.asDict() for r in shards.manifest().orderBy("file").collect()]})
