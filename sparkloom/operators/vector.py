"""Nearest neighbours: distances as column expressions, exact and hashed search."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# The metrics by name.
METRICS = ("cosine", "euclidean", "manhattan", "minkowski", "chebyshev", "hamming", "jaccard", "pearson", "mahalanobis")
#: The order of the Minkowski distance.
MINKOWSKI_P = 3
#: Vectors of a block in a join, and bytes of queries up to which their blocks are broadcast.
BLOCK, BROADCAST_BYTES = 512, 1 << 26


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def _norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def similarity(metric: str, a: Column, b: Column) -> Column:
    """Cosine, Pearson or Jaccard similarity; for other metrics 1 / (1 + distance). Null for vectors without direction."""
    metric = metric.lower()
    a, b = _doubles(a), _doubles(b)
    if metric == "cosine":
        return F.try_divide(_dot(a, b), _norm(a) * _norm(b))
    if metric == "pearson":
        centred = lambda x: F.transform(x, lambda v: v - _sum(x) / F.size(x))
        return F.try_divide(_dot(centred(a), centred(b)), _norm(centred(a)) * _norm(centred(b)))
    if metric == "jaccard":
        return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))
    return 1 / (1 + distance(metric, a, b))


def distance(metric: str, a: Column, b: Column) -> Column:
    """The distance of two array columns: 1 - similarity for cosine, Pearson and Jaccard.

    Hamming counts places that differ. Mahalanobis has no covariance to work with and isn't offered.
    """
    metric = metric.lower()
    if metric == "mahalanobis":
        raise NotImplementedError("mahalanobis needs a covariance matrix")
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    if metric in ("cosine", "pearson", "jaccard"):
        return 1 - similarity(metric, a, b)
    gaps = F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.abs(x - y))
    if metric == "euclidean":
        return F.sqrt(_sum(F.transform(gaps, lambda g: g * g)))
    if metric == "manhattan":
        return _sum(gaps)
    if metric == "minkowski":
        return F.pow(_sum(F.transform(gaps, lambda g: F.pow(g, F.lit(float(MINKOWSKI_P))))), F.lit(1 / MINKOWSKI_P))
    if metric == "chebyshev":
        return F.array_max(gaps)
    return _sum(F.transform(gaps, lambda g: F.when(g > 0, 1.0).when(g.isNotNull(), 0.0)))  # null, as others, for vectors of different lengths


def literal(vector: Sequence[float]) -> Column:
    if not vector:
        raise ValueError("empty vector")
    return F.array(*(F.lit(float(x)) for x in vector))


def knn(rows: DataFrame, column: str, vector: Sequence[float], k: int, metric: str = "cosine", key: str = "id", threshold: float | None = None, name: str = "distance") -> DataFrame:
    """The k nearest rows, ties by key; a top-k, so only k rows leave each task. Nulls take no part."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    near = rows.withColumn(name, distance(metric, F.col(column), literal(vector))).where(F.col(name).isNotNull())
    if threshold is not None:
        near = near.where(F.col(name) <= threshold)
    return near.orderBy(F.col(name), F.col(key)).limit(k)


def knn_hashed(rows: DataFrame, column: str, vector: Sequence[float], k: int, key: str = "id", tables: int = 8, bucket: float = 1.0, name: str = "distance") -> DataFrame:
    """The k rows nearest by Euclidean distance, found by random projections, whatever the vectors' lengths.

    The k-th distance among rows that share a bucket bounds how far a nearer row's projections can be from the
    vector's; all rows within that bound are compared. If too few share a bucket, all rows are. On unit vectors
    this orders as cosine does.
    """
    near = np.array(vector, float)
    rng = np.random.default_rng(len(vector))
    planes = rng.normal(0, 1, (tables, len(vector)))
    offsets = rng.uniform(0, bucket, tables)
    own = _doubles(F.col(column))
    across, at = [_dot(own, literal(p.tolist())) for p in planes], planes @ near
    reach = math.inf
    if np.all(np.abs(at + offsets) < bucket * 2.0**62):  # buckets have numbers
        same = [F.floor((x + float(b)) / bucket) == int(np.floor((y + b) / bucket)) for x, y, b in zip(across, at, offsets, strict=True)]
        first = knn(rows.where(reduce(lambda a, b: a | b, same)), column, vector, k, "euclidean", key, name=name).select(name).collect()
        reach = first[-1][0] if len(first) == k else math.inf
    if math.isfinite(reach):
        room = np.linalg.norm(planes, axis=1) * (reach + 1e-9 * (reach + np.linalg.norm(near)))  # with what rounding may add
        rows = rows.where(reduce(lambda a, b: a & b, [F.abs(x - float(y)) <= float(r) for x, y, r in zip(across, at, room, strict=True)]))
    return knn(rows, column, vector, k, "euclidean", key, name=name)


def _packed(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that packs slices of rows of (key, vector): by length, the keys in order and the vectors' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                part = part.take(pc.sort_indices(part.column(0)))
                sizes = pc.list_value_length(part.column(1)).to_numpy()
                for n in np.unique(sizes):
                    own = part.take(pa.array(np.flatnonzero(sizes == n)))
                    keys = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.column(0))
                    raw = own.column(1).flatten().to_numpy().astype(float).tobytes()
                    yield pa.record_batch([pa.array([n], pa.int32()), keys, pa.array([raw], pa.binary())], [f"{name}_size", f"{name}_keys", name])

    return run


def _closest(k: int, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow over pairs of a block of queries and one of rows: each query's k nearest in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                cell = lambda c: batch.column(c)[at]  # noqa: E731, B023
                n = cell("asked_size").as_py()
                if n != cell("rows_size").as_py():
                    continue
                queries, names = cell("asked_keys").values, cell("rows_keys").values
                q, x = (np.frombuffer(cell(c).as_buffer(), float).reshape(len(own), n) for c, own in (("asked", queries), ("rows", names)))
                away = np.zeros((len(q), len(x)))
                with np.errstate(all="ignore"):
                    for j in range(n):  # one component after the other, as distance() adds them
                        away += np.square(q[:, j, None] - x[None, :, j])
                away = np.sqrt(away)
                places: dict = defaultdict(list)
                for m, name in enumerate(names.to_pylist()):
                    places[name].append(m)
                found: list[list[np.ndarray]] = [[], []]
                for m, name in enumerate(queries.to_pylist()):
                    some = np.delete(np.arange(len(x)), places.get(name, []))
                    if len(some) > k:
                        last = np.partition(away[m, some], k - 1)[k - 1]
                        some = some if np.isnan(last) else some[away[m, some] <= last]
                    some = some[np.argsort(away[m, some], kind="stable")[:k]]  # rows are in the order of their keys
                    found[0].append(np.full(len(some), m))
                    found[1].append(some)
                a, b = map(np.concatenate, found)
                yield pa.record_batch([queries.take(pa.array(a)), names.take(pa.array(b)), pa.array(away[a, b])], ["query", key, "distance"])

    return run


def _nearest_in_blocks(queries: DataFrame, rows: DataFrame, column: str, k: int, key: str) -> DataFrame:
    """query, key and Euclidean distance of the k nearest rows of each query in every block of rows."""
    whole = F.col(column).isNotNull() & F.forall(F.col(column), lambda v: v.isNotNull()) & F.col(key).isNotNull()
    packed = []
    asked = queries.where(whole).select(key, _doubles(F.col(column)).alias(column))
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.size(column)), F.lit(0)) * 8).first()
    for name, df in (("asked", asked.repartition(max(1, math.ceil(n / BLOCK)))), ("rows", rows.where(whole).select(key, _doubles(F.col(column))))):
        kind = T.ArrayType(df.schema[key].dataType)
        packed.append(df.mapInArrow(_packed(name), T.StructType([T.StructField(f"{name}_size", T.IntegerType()), T.StructField(f"{name}_keys", kind), T.StructField(name, T.BinaryType())])))
    pairs = packed[1].crossJoin(F.broadcast(packed[0]) if size <= BROADCAST_BYTES else packed[0])
    found = T.StructType([T.StructField("query", queries.schema[key].dataType), T.StructField(key, rows.schema[key].dataType), T.StructField("distance", T.DoubleType())])
    return pairs.mapInArrow(_closest(k, key), found)


def knn_join(queries: DataFrame, rows: DataFrame, column: str, k: int, metric: str = "cosine", key: str = "id") -> DataFrame:
    """query, key, distance, rank of the k nearest rows of each query.

    By Euclidean distance, blocks of queries meet blocks of rows and k rows of each leave a task; by other
    metrics every pair is a row, and queries are broadcast if below Spark's threshold.
    """
    if metric.lower() == "euclidean":
        all_ = _nearest_in_blocks(queries, rows, column, k, key)
    else:
        asked = queries.select(F.col(key).alias("query"), F.col(column).alias("_asked"))
        all_ = asked.join(rows.select(key, column), F.col("query") != F.col(key)).withColumn("distance", distance(metric, F.col("_asked"), F.col(column)))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", key))
    return all_.where(F.col("distance").isNotNull()).withColumn("rank", rank).where(F.col("rank") <= k).select("query", key, "distance", "rank")
