"""Vector indexes under a folder: a routing layer over cells, and in the cells navigable graphs or product codes.

Rows go to the cell of the nearest of a bounded number of pivots; a cell with more
rows than a unit holds is dealt to several units by a hash of the key. A search reads
the units of the cells whose pivots are nearest to its vector: as many as hold a given
share of the nearest rows in the sample. With exact=True it then reads every cell that may hold a nearer row than the last one found, by the
triangle inequality from the cells' radii, so nothing is missed.

Every append is a generation, published by one rename, and writes its own rows alone;
a generation also names the keys that it replaces or deletes, which then count in no
older one. merge() writes all that counts as one generation.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..generations import Generations
from ..shared import cut

#: Rows of a unit on average, and the most pivots there are.
UNIT, PIVOTS = 1024, 4096
#: Bytes of pivots, and of the sample that they and codebooks are fitted on, on the driver at most.
PIVOT_BYTES, SAMPLE_BYTES = 1 << 25, 1 << 26
#: Random nodes that a node's long links are chosen from, how many it has room for, and how much nearer, in squares, a kept neighbour may be to them.
FAR, LONG, WIDER = 8, 2, 1.44
#: Queries that meet a unit in one task, and cells up to which a search names them to the scan.
BLOCK, NAMED = 1024, 1000
#: Cells that an exact search reads first, to know how far it must look; pairs of a query and a cell in a batch; bytes of queries that are broadcast.
LEAD, PAIRS, BROADCAST_BYTES = 16, 1 << 16, 1 << 24


def _normal(x: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.square(x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.full_like(x, np.nan), where=size > 0)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b."""
    return np.maximum(0, np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1) - 2 * (a @ b.T))


def _means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """At most k centres of x, by Lloyd's rounds; a centre that loses all rows stays where it was."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        own = np.concatenate([_squares(x[at : at + 4096], centres).argmin(axis=1) for at in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, some rows at a time."""
    return np.concatenate([_squares(x[at : at + 4096], centres).argmin(axis=1) for at in range(0, len(x), 4096)])


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


class Graph:
    """A layered navigable graph of a unit's vectors: neighbours of each node by layer, at most `degree`, twice as many in the lowest."""

    def __init__(self, x: np.ndarray, links: list[list[Sequence[int]]]) -> None:
        self.x, self.links = x, links
        self.entry = max(range(len(links)), key=lambda k: len(links[k]), default=0)

    @classmethod
    def build(cls, x: np.ndarray, levels: Sequence[int], degree: int, candidates: int) -> Graph:
        """From the nearest nodes of each layer, those that no kept neighbour is nearer to, and from some random ones, for the long
        way, those that none is much nearer to; both ways. Then whatever is cut off is linked."""
        d, rng = _squares(x, x), np.random.default_rng(len(x))
        links: list[list[Sequence[int]]] = [[[] for _ in range(v + 1)] for v in levels]
        for layer in range(max(levels, default=-1) + 1):
            own = np.flatnonzero(np.asarray(levels) >= layer)
            most = degree * (1 if layer else 2)
            part = d[np.ix_(own, own)]
            near = np.argsort(part, axis=1, kind="stable")[:, : candidates + 1]
            far = rng.integers(0, len(own), (len(own), FAR))
            out: list[list[int]] = []
            for k in range(len(own)):
                kept = cls._spread(part, k, [j for j in near[k].tolist() if j != k], degree - LONG)
                out.append(cls._spread(part, k, sorted({*far[k].tolist()} - {k, *kept}, key=lambda j: part[k, j]), degree, kept))  # noqa: B023
            for k, some in enumerate([list(o) for o in out]):
                for j in some:
                    if k not in out[j]:
                        out[j].append(k)
            for k, some in enumerate(out):
                if len(some) > most:
                    out[k] = cls._spread(part, k, sorted(some, key=lambda j: part[k, j]), most)  # noqa: B023
            cls._connect(part, out, most)
            for k, some in zip(own.tolist(), out, strict=True):
                links[k][layer] = own[some].tolist()
        return cls(x, links)

    @staticmethod
    def _spread(d: np.ndarray, k: int, near: list[int], most: int, held: Sequence[int] = ()) -> list[int]:
        kept, slack = list(held), WIDER if held else 1.0
        for j in near:
            if len(kept) >= most:
                break
            if not kept or slack * d[j, kept].min() >= d[k, j]:
                kept.append(j)
        for j in near:  # what is left of half the room goes to the nearest
            if held or len(kept) >= most // 2:
                break
            if j not in kept:
                kept.append(j)
        return kept

    @staticmethod
    def _connect(d: np.ndarray, out: list[list[int]], most: int) -> None:
        """Links each part that can't be reached from the first node by its shortest way to a node with room, in both directions."""
        seen = np.zeros(len(out), bool)
        stack = [0] if out else []
        while stack:
            seen[stack] = True
            while stack:
                for j in out[stack.pop()]:
                    if not seen[j]:
                        seen[j] = True
                        stack.append(j)
            if not seen.all():
                there, away = np.flatnonzero(seen), np.flatnonzero(~seen)
                free = [j for j in there.tolist() if len(out[j]) < most]
                there = np.array(free) if free else there
                a, b = divmod(int(d[np.ix_(there, away)].argmin()), len(away))
                out[there[a]].append(int(away[b]))
                out[away[b]].append(int(there[a]))
                stack = [int(away[b])]

    def search(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        """(squared distance, node) of about the `ef` nearest, in order."""
        if not len(self.x):
            return []
        away = lambda some: np.square(self.x[some] - q).sum(axis=1)
        at, best = self.entry, float(away([self.entry])[0])
        for layer in range(len(self.links[at]) - 1, 0, -1):
            while some := self.links[at][layer]:
                d = away(some)
                k = int(d.argmin())
                if not d[k] < best:
                    break
                at, best = some[k], float(d[k])
        seen = {at}
        open_, found = [(best, at)], [(-best, -at)]
        while open_:
            d, at = heapq.heappop(open_)
            if d > -found[0][0] and len(found) >= ef:
                break
            some = [j for j in self.links[at][0] if j not in seen]
            if some:
                seen.update(some)
                for dj, j in zip(away(some).tolist(), some, strict=True):
                    if len(found) < ef or dj < -found[0][0]:
                        heapq.heappush(open_, (dj, j))
                        heapq.heappush(found, (-dj, -j))
                        if len(found) > ef:
                            heapq.heappop(found)
        return sorted((-d, -j) for d, j in found)


@dataclass
class VectorIndex:
    """What both kinds of index share. metric is euclidean or cosine; vectors without direction, of another length, or with null or non-finite components take no part."""

    spark: SparkSession
    root: str
    metric: str = "euclidean"
    unit: int = UNIT
    recall: float = 0.95
    generations: Generations = field(init=False, repr=False)

    def __post_init__(self) -> None:
        if self.metric not in ("euclidean", "cosine"):
            raise ValueError(f"no index for the metric {self.metric}")
        self.generations = Generations(self.spark, self.root)

    @cached_property
    def pivots(self) -> np.ndarray:
        """The routing layer: as many vectors as there are cells."""
        rows = self.spark.read.parquet(f"{self.root}/pivots").orderBy("cell").toPandas()  # at most PIVOT_BYTES
        return np.array(rows["pivot"].tolist(), float)

    @cached_property
    def probes(self) -> int:
        """How many cells a search reads."""
        return self.spark.read.parquet(f"{self.root}/routing").first()["probes"]

    def _probes_for(self, sample: np.ndarray, centres: np.ndarray, k: int = 10, queries: int = 512) -> int:
        """The cells that hold a share `recall` of the k nearest of the sample's vectors, in the order of their pivots."""
        own = _squares(sample, centres).argmin(axis=1)
        some = sample[np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)]
        near = np.argsort(_squares(some, sample), axis=1, kind="stable")[:, 1 : k + 1]
        if not near.size:
            return 1
        place = np.argsort(np.argsort(_squares(some, centres), axis=1, kind="stable"), axis=1)
        ranks = np.take_along_axis(place, own[near], axis=1).ravel()
        return int(np.quantile(ranks, self.recall, method="higher")) + 1

    def _whole(self, rows: DataFrame, key: str, column: str) -> DataFrame:
        """key and vector of the rows that can take part, normalised for cosine."""
        x = F.transform(column, lambda v: v.cast("double"))
        good = F.col(key).isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        own = rows.where(good).select(F.col(key).alias("key"), x.alias("vector"))
        if self.metric == "cosine":
            size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))
            own = own.withColumn("_size", size).where("_size > 0").select("key", F.transform("vector", lambda v: v / F.col("_size")).alias("vector"))
        return own

    def _routed(self, own: DataFrame) -> DataFrame:
        """own with its cell and the distance to the cell's pivot."""
        pivots = self.spark.sparkContext.broadcast(self.pivots)  # at most PIVOT_BYTES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    d = _squares(_matrix(part.column(1)), pivots.value)
                    cell = d.argmin(axis=1)
                    yield pa.record_batch([*part.columns, pa.array(cell, pa.int32()), pa.array(np.sqrt(d[np.arange(len(cell)), cell]))], [*part.schema.names, "cell", "away"])

        schema = T.StructType([*own.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
        return own.where(F.size("vector") == self.pivots.shape[1]).mapInArrow(run, schema)

    def build(self, rows: DataFrame, key: str, column: str) -> VectorIndex:
        """The routing layer from a bounded sample of rows, by a hash of their keys, and the first generation."""
        own = cut(self._whole(rows, key, column))
        n, first = own.count(), own.select("vector").first()
        if first is None:
            raise ValueError("there is no vector to index")
        width = len(first["vector"])
        cells = max(1, min(PIVOTS, math.ceil(n / self.unit), PIVOT_BYTES // (8 * width)))
        most = max(1, min(32 * cells, SAMPLE_BYTES // (8 * width)))
        chosen = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
        sample = own.where((F.size("vector") == width) & (chosen < int(min(1.0, 1.5 * most / n) * (1 << 30)))).orderBy(chosen, "key").limit(most).toPandas()
        x = np.array((sample if len(sample) else own.limit(1).toPandas())["vector"].tolist(), float)
        centres = _means(x, cells)
        self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, pivot array<double>").write.mode("overwrite").parquet(f"{self.root}/pivots")
        self.spark.createDataFrame([(self._probes_for(x, centres),)], "probes int").write.mode("overwrite").parquet(f"{self.root}/routing")
        self.__dict__.pop("pivots", None)
        self.__dict__.pop("probes", None)
        self._fit(x)
        self._commit(own, None, self.generations.numbers(), self.generations.latest())
        return self

    def _fit(self, sample: np.ndarray) -> None:
        """What else is learnt from the sample."""

    def append(self, rows: DataFrame, key: str, column: str) -> int:
        """Adds rows; a key that the index has is replaced."""
        own = cut(self._whole(rows, key, column))
        base = self.generations.latest()
        known = self.generations.read("nodes").select("key").join(own.select("key"), "key", "left_semi").distinct()
        return self._commit(own, cut(known), (), base)

    def delete(self, keys: DataFrame, key: str) -> int:
        """Rows of these keys count no more."""
        base = self.generations.latest()
        known = self.generations.read("nodes").select("key").join(keys.select(F.col(key).alias("key")), "key", "left_semi").distinct()
        return self._commit(None, cut(known), (), base)

    def merge(self) -> int:
        """All that counts as one generation; the older ones are read no more, and go by generations.expire()."""
        base, replaced = self.generations.latest(), self.generations.numbers()
        return self._commit(cut(self._live().where("NOT dead").select("key", "vector")), None, replaced, base)

    def _commit(self, own: DataFrame | None, dead: DataFrame | None, replaces: Sequence[int], base: int) -> int:
        def write(to: str) -> None:
            if own is not None:
                routed = cut(self._routed(own))
                load = routed.groupBy("cell").agg(F.count("*").alias("_rows"))
                unit = F.pmod(F.xxhash64("key"), F.ceil(F.col("_rows") / self.unit)).cast("int")
                units = routed.join(F.broadcast(load), "cell").withColumn("unit", unit).drop("_rows")  # load: at most PIVOTS rows
                self._stored(units).repartitionByRange("cell", "unit").sortWithinPartitions("cell", "unit").write.parquet(f"{to}/nodes")
                units.groupBy("cell", "unit").agg(F.count("*").alias("rows"), F.max("away").alias("radius")).write.parquet(f"{to}/units")
            if dead is not None:
                dead.write.parquet(f"{to}/dead")

        return self.generations.commit(write, replaces, base)

    def _stored(self, units: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _live(self, cells: Sequence[int] | None = None) -> DataFrame:
        """The nodes of some cells, with dead for those that a later generation replaces or deletes."""
        nodes = self.generations.read("nodes")
        if cells is not None and len(cells) <= NAMED:
            nodes = nodes.where(F.col("cell").isin(list(map(int, cells))))
        return self.generations.alive(nodes)

    # Searches.

    def _units(self) -> DataFrame:
        return self.generations.read("units")

    def rows_read(self, vectors: Sequence[Sequence[float]], probes: int | None = None) -> int:
        """How many rows are in the cells that searches for these vectors read."""
        cells = sorted({int(c) for v in vectors for c in self._near(np.array([v], float), probes)[0]})
        return self._units().where(F.col("cell").isin(cells)).agg(F.sum("rows")).first()[0] or 0

    def _near(self, q: np.ndarray, probes: int | None) -> np.ndarray:
        return np.argsort(_squares(_normal(q) if self.metric == "cosine" else q, self.pivots), axis=1, kind="stable")[:, : probes or self.probes]

    def search(self, vector: Sequence[float], k: int, ef: int = 64, probes: int | None = None, exact: bool = False) -> DataFrame:
        """key and distance of the k nearest rows, in order."""
        one = self.spark.createDataFrame([(0, [float(v) for v in vector])], "query int, vector array<double>")
        found = self.search_many(one, "query", "vector", k, ef, probes, exact)
        return found.orderBy("rank").select("key", "distance")

    def search_many(self, queries: DataFrame, key: str, column: str, k: int, ef: int = 64, probes: int | None = None, exact: bool = False, but_own: bool = False) -> DataFrame:
        """query, key, distance and rank (from 1) of the k nearest rows of each query, ties by key; but_own leaves out the row of the query's own key."""
        if k < 1 or ef < 1:
            raise ValueError("k and ef must be 1 or more")
        asked = cut(self._whole(queries, key, column).where(F.size("vector") == self.pivots.shape[1]).select(F.col("key").alias("query"), "vector").dropDuplicates(["query"]))
        first = self._pairs(asked, probes or (min(LEAD, self.probes) if exact else None))
        found = self._best(self._met(asked, first, k + but_own, max(ef, k + but_own), False), k, but_own)
        if exact:
            found = cut(found)
            reach = found.groupBy("query").agg(F.count("*").alias("_n"), F.max("distance").alias("_last"))
            ask = asked.join(reach, "query", "left").withColumn("reach", F.when(F.col("_n") >= k, self._euclidean("_last")).otherwise(F.lit(float("inf"))))
            found = self._best(self._met(asked, self._within(ask.select("query", "vector", "reach")), k + but_own, ef, True), k, but_own)
        return found

    def _euclidean(self, name: str):
        """A distance of the metric as one of the vectors kept."""
        return F.sqrt(F.greatest(F.lit(0.0), 2 * F.col(name))) if self.metric == "cosine" else F.col(name)

    def _best(self, found: DataFrame, k: int, but_own: bool) -> DataFrame:
        kept = found.where(~F.col("query").eqNullSafe(F.col("key"))) if but_own else found
        distance = F.col("square") / 2 if self.metric == "cosine" else F.sqrt("square")
        rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
        return kept.withColumn("distance", distance).withColumn("rank", rank).where(F.col("rank") <= k).select("query", "key", "distance", "rank")

    def _pairs(self, asked: DataFrame, probes: int | None) -> DataFrame:
        """query, cell and reach (none yet): the nearest cells of each query."""
        pivots, most = self.spark.sparkContext.broadcast(self.pivots), probes or self.probes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = max(1, PAIRS // len(pivots.value))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    cells = np.argsort(_squares(_matrix(part.column(1)), pivots.value), axis=1, kind="stable")[:, :most]
                    rows = pa.array(np.repeat(np.arange(part.num_rows), cells.shape[1]))
                    yield pa.record_batch([part.column(0).take(rows), pa.array(cells.ravel(), pa.int32()), pa.array(np.full(cells.size, np.inf))], ["query", "cell", "reach"])

        return asked.mapInArrow(run, self._paired(asked))

    @staticmethod
    def _paired(asked: DataFrame) -> T.StructType:
        return T.StructType([asked.schema.fields[0], T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())])

    def _within(self, asked: DataFrame) -> DataFrame:
        """query, cell and reach: all cells that may have a row within the query's reach."""
        radii = dict(self._units().groupBy("cell").agg(F.max("radius")).collect())  # at most PIVOTS rows
        held = self.spark.sparkContext.broadcast((self.pivots, np.array([radii.get(k, -np.inf) for k in range(len(self.pivots))])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, radius = held.value
            for batch in batches:
                step = max(1, PAIRS // len(pivots))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    reach = part.column(2).to_numpy(zero_copy_only=False)
                    room = (reach[:, None] + radius) * (1 + 1e-9) + 1e-6
                    rows, cells = np.nonzero(np.sqrt(_squares(_matrix(part.column(1)), pivots)) <= room)
                    yield pa.record_batch([part.column(0).take(pa.array(rows)), pa.array(cells, pa.int32()), pa.array(reach[rows])], ["query", "cell", "reach"])

        return asked.mapInArrow(run, self._paired(asked))

    def _met(self, asked: DataFrame, pairs: DataFrame, k: int, ef: int, exact: bool) -> DataFrame:
        """query, key and squared distance of the best of each query in each unit of its cells, none beyond its reach.

        Queries come to a unit in bounded blocks. Pairs have no vectors: tasks know few queries' vectors by a broadcast, and those of many come by a join.
        """
        pairs = cut(pairs)
        cells = [r["cell"] for r in pairs.select("cell").distinct().limit(NAMED + 1).collect()]
        nodes = self._live(cells if len(cells) <= NAMED else None)
        load = pairs.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
        blocks = load.select("cell", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"))
        units = self._units().select("cell", "unit", "gen").distinct()
        dealt = pairs.join(F.broadcast(load), "cell").withColumn("block", F.pmod(F.xxhash64("query"), F.col("_blocks")).cast("int")).drop("_blocks")
        left = self._wanted(nodes, exact).join(F.broadcast(blocks), "cell")
        right, held = dealt.join(F.broadcast(units) if len(cells) <= NAMED else units, "cell"), None
        if asked.count() * 8 * self.pivots.shape[1] <= BROADCAST_BYTES:
            held = self.spark.sparkContext.broadcast(asked.select("query", "vector").toArrow().combine_chunks())  # at most BROADCAST_BYTES
        else:
            right = right.join(asked, "query")
        names = ["gen", "cell", "unit", "block"]
        schema = T.StructType([T.StructField("query", pairs.schema["query"].dataType), T.StructField("key", nodes.schema["key"].dataType), T.StructField("square", T.DoubleType())])
        return left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(_with_vectors(self._meeting(k, ef, exact), held), schema)

    def _wanted(self, nodes: DataFrame, exact: bool) -> DataFrame:
        """The columns of nodes that a search reads."""
        return nodes

    def _meeting(self, k: int, ef: int, exact: bool):
        raise NotImplementedError


def _with_vectors(run, held):
    """A cogrouped function whose queries have vectors: their own, or those of a broadcast table."""

    def whole(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        if held is not None and len(asked):
            at = pc.index_in(asked.column("query").combine_chunks(), value_set=held.value.column("query").combine_chunks())
            asked = asked.append_column("vector", held.value.column("vector").combine_chunks().take(at))
        return run(nodes, asked)

    return whole


def _met_rows(asked: pa.Table, nodes: pa.Table, hits: list[tuple[int, int, float]]) -> pa.Table:
    """A table of (row of asked, row of nodes, squared distance)."""
    a, b, d = (list(c) for c in zip(*hits, strict=True)) if hits else ([], [], [])
    return pa.table([asked.column("query").take(pa.array(a, pa.int64())), nodes.column("key").take(pa.array(b, pa.int64())), pa.array(d, pa.float64())], ["query", "key", "square"])


def _scan(x: np.ndarray, alive: np.ndarray, asked: np.ndarray, k: int, reach: np.ndarray) -> list[tuple[int, int, float]]:
    """The k nearest rows of each query, and all at the last one's distance, but none beyond its reach.

    Products of matrices, with room for their rounding, say which rows may be among them; these get exact distances.
    """
    hits, own = [], np.flatnonzero(alive)
    x = x[own]
    for at in range(0, len(asked), 256):
        q, far = asked[at : at + 256], np.square(reach[at : at + 256]) * (1 + 1e-9) + 1e-12
        with np.errstate(all="ignore"):
            d = _squares(q, x)
            last = np.partition(d, k - 1, axis=1)[:, k - 1] if len(own) > k else np.full(len(q), np.inf)
            room = 1e-9 * (np.square(q).sum(axis=1) + np.square(x).sum(axis=1).max(initial=0))
            a, b = np.nonzero(~(d > (np.minimum(last, far) + room)[:, None]))  # what is too large to square stays
            true = np.square(x[b] - q[a]).sum(axis=1)
        good = ~(true > far[a])
        hits += zip((a[good] + at).tolist(), own[b[good]].tolist(), true[good].tolist(), strict=True)
    return hits


@dataclass
class GraphIndex(VectorIndex):
    """Hierarchical navigable small-world graphs, one for each unit: degree is the neighbours kept, efc the candidates that they are chosen from."""

    degree: int = 16
    efc: int = 64

    def _stored(self, units: DataFrame) -> DataFrame:
        degree, efc = self.degree, self.efc

        def run(table: pa.Table) -> pa.Table:
            table = table.combine_chunks().sort_by("key")
            x = _matrix(table.column("vector").combine_chunks())
            rng = np.random.default_rng(len(x))
            levels = np.minimum(8, np.floor(-np.log(1 - rng.random(len(x))) / math.log(degree))).astype(int).tolist()
            graph = Graph.build(x, levels, degree, efc)
            return table.append_column("node", pa.array(np.arange(len(x)), pa.int32())).append_column("links", pa.array(graph.links, pa.list_(pa.list_(pa.int32()))))

        schema = T.StructType([*units.schema.fields, T.StructField("node", T.IntegerType()), T.StructField("links", T.ArrayType(T.ArrayType(T.IntegerType())))])
        return units.groupBy("cell", "unit").applyInArrow(run, schema)

    def _meeting(self, k: int, ef: int, exact: bool):
        def run(nodes: pa.Table, asked: pa.Table) -> pa.Table:
            if not len(asked) or not len(nodes):
                return _met_rows(asked, nodes, [])
            nodes = nodes.combine_chunks().sort_by("node")
            x, alive = _matrix(nodes.column("vector").combine_chunks()), ~nodes.column("dead").to_numpy()
            q = _matrix(asked.column("vector").combine_chunks())
            if exact:
                return _met_rows(asked, nodes, _scan(x, alive, q, k, asked.column("reach").to_numpy()))
            graph, hits = Graph(x, nodes.column("links").to_pylist()), []
            for i, v in enumerate(q):
                width = ef
                while True:
                    found = [(d, j) for d, j in graph.search(v, width) if alive[j]]
                    if len(found) >= min(k, int(alive.sum())) or width >= len(x):
                        break
                    width *= 2  # too many of what was found are deleted
                hits += [(i, j, d) for d, j in found[:k]]
            return _met_rows(asked, nodes, hits)

        return run


@dataclass
class CodeIndex(VectorIndex):
    """Product codes: a byte for each of `parts` parts of a vector, by codebooks fitted on the sample; searches scan codes and read the vectors of the best alone."""

    parts: int = 16
    entries: int = 256
    rerank: int = 10
    accuracy: float = 0.98

    @cached_property
    def codebooks(self) -> list[np.ndarray]:
        rows = self.spark.read.parquet(f"{self.root}/codebooks").orderBy("part", "entry").toPandas()  # entries of as many numbers as a vector has
        return [np.array(g["values"].tolist(), float) for _, g in rows.groupby("part")]

    def _fit(self, sample: np.ndarray) -> None:
        split = np.array_split(sample, min(self.parts, sample.shape[1]), axis=1)
        books = [_means(own, self.entries) for own in split]
        rows = [(p, e, v.tolist()) for p, own in enumerate(books) for e, v in enumerate(own)]
        self.spark.createDataFrame(rows, "part int, entry int, values array<double>").write.mode("overwrite").parquet(f"{self.root}/codebooks")
        self.spark.createDataFrame([(self._share_for(sample, books),)], "share double").write.mode("overwrite").parquet(f"{self.root}/ranks")
        self.__dict__.pop("codebooks", None)
        self.__dict__.pop("share", None)

    @cached_property
    def share(self) -> float:
        """The share of all rows, the nearest by codes, whose vectors a search for ten reads."""
        return self.spark.read.parquet(f"{self.root}/ranks").first()["share"]

    def _share_for(self, sample: np.ndarray, books: list[np.ndarray], k: int = 10, queries: int = 256) -> float:
        """In how large a share of the sample, the nearest by codes, a share `accuracy` of the k nearest are."""
        split = np.array_split(sample, len(books), axis=1)
        near = np.hstack([b[_nearest(x, b)] for x, b in zip(split, books, strict=True)])
        ranks = []
        for i in np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int):
            true, coded = (_squares(sample[i][None], x)[0] for x in (sample, near))
            own = np.argsort(true, kind="stable")[: k + 1]
            ranks += (coded[None] <= coded[own][:, None]).sum(axis=1).tolist() if len(own) else []
        return float(np.quantile(ranks, self.accuracy, method="higher")) / len(sample) if ranks else 1.0

    def _stored(self, units: DataFrame) -> DataFrame:
        """Rows with their codes; a scan of the codes doesn't read the vectors, which are columns of their own."""
        held = self.spark.sparkContext.broadcast(self.codebooks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    split = np.array_split(_matrix(part.column(part.schema.get_field_index("vector"))), len(held.value), axis=1)
                    codes = np.column_stack([_squares(x, b).argmin(axis=1) for x, b in zip(split, held.value, strict=True)]).astype(np.uint8)
                    yield pa.record_batch([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary())], [*part.schema.names, "code"])

        return units.mapInArrow(run, T.StructType([*units.schema.fields, T.StructField("code", T.BinaryType())]))

    def _met(self, asked: DataFrame, pairs: DataFrame, k: int, ef: int, exact: bool) -> DataFrame:
        """The best by codes in each unit, then exact distances: a row's vector is read by its place.

        More rows are read anew as the index grows, as more come between by their codes.
        """
        if exact:
            return super()._met(asked, pairs, k, ef, True)
        rows = self._units().agg(F.sum("rows")).first()[0] or 0
        most = max(ef, k * self.rerank, math.ceil(self.share * rows * k / 10))
        best = super()._met(asked, pairs, k, min(most, max(2 * k, math.ceil(4 * most / self.probes))), False)
        rank = F.row_number().over(Window.partitionBy("query").orderBy("square", "key"))
        best = best.withColumn("_rank", rank).where(F.col("_rank") <= most).select("query", "key")
        rows = self._live([r["cell"] for r in pairs.select("cell").distinct().limit(NAMED + 1).collect()]).where("NOT dead").select("key", "vector")
        gaps = F.zip_with("vector", "_asked", lambda a, b: (a - b) * (a - b))
        return cut(best).join(rows, "key").join(asked.select("query", F.col("vector").alias("_asked")), "query").select("query", "key", F.aggregate(gaps, F.lit(0.0), lambda a, v: a + v).alias("square"))

    def _wanted(self, nodes: DataFrame, exact: bool) -> DataFrame:
        return nodes.drop("code" if exact else "vector")

    def _meeting(self, k: int, ef: int, exact: bool):
        held = None if exact else self.spark.sparkContext.broadcast(self.codebooks)

        def run(nodes: pa.Table, asked: pa.Table) -> pa.Table:
            if not len(asked) or not len(nodes):
                return _met_rows(asked, nodes, [])
            alive, q = ~nodes.column("dead").to_numpy(), _matrix(asked.column("vector").combine_chunks())
            if exact:
                return _met_rows(asked, nodes, _scan(_matrix(nodes.column("vector").combine_chunks()), alive, q, k, asked.column("reach").to_numpy()))
            codes = np.frombuffer(b"".join(nodes.column("code").to_pylist()), np.uint8).reshape(len(nodes), -1)
            hits, own = [], np.flatnonzero(alive)
            for at in range(0, len(q), 256):
                tables = [_squares(x, b) for x, b in zip(np.array_split(q[at : at + 256], len(held.value), axis=1), held.value, strict=True)]
                d = sum(t[:, codes[own, p]] for p, t in enumerate(tables))
                some = np.argpartition(d, ef - 1, axis=1)[:, :ef] if len(own) > ef else np.tile(np.arange(len(own)), (len(d), 1))
                a = np.repeat(np.arange(len(d)), some.shape[1])
                hits += zip((a + at).tolist(), own[some.ravel()].tolist(), d[a, some.ravel()].tolist(), strict=True)
            return _met_rows(asked, nodes, hits)

        return run


def defined(spark: SparkSession, root: str, kind: str, metric: str = "euclidean", degree: int = 16, efc: int = 64, hashed: bool = False) -> VectorIndex:
    """The index of a definition: codes for a hashed diskann index, else graphs."""
    if kind not in ("hnsw", "diskann"):
        raise ValueError(f"{kind} has no stored form")
    return CodeIndex(spark, root, metric) if hashed else GraphIndex(spark, root, metric, degree=degree, efc=efc)
