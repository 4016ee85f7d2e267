"""Vectors compressed to codes of their parts, by codebooks that follow their parts.

Components become integers.  A vector is cut into equal parts, and a part's code
is the number of the nearest entry of that position's codebook, by squared
Euclidean distance, ties to the lower number.  An entry becomes the
componentwise floor of the mean of its parts, a fixed number of times.

Most entries are ruled out by lower bounds, from coarse to fine.  A part is cut
into blocks of 8, 4 and 2 components.  Of a block of m components with the sums S
and T, and the lengths r and s of what is left without the means, the distance is
at least (S - T)^2 / m + (r - s)^2.  The entry with the least bound gives an exact
distance; entries whose bound is above the least exact distance so far go, after
each level.  Bounds are lowered by more than rounding can add.  What is left gets
exact integer distances.

Each round is one pass over the vectors: a task adds up its parts by entry, and
one row for each entry, position and task is shuffled.  Codebooks are as many
integers as a few vectors have.

Rows whose vector is null or holds null or non-finite components are dropped.  All
vectors that take part are as long as the one of the least id, and that length is a
multiple of the number of parts: others are dropped, too.  The entries begin with
the least ids; of equal ids, the least vector; rows without an id are coded but
begin no entry.  Repeated rows stay.  Sums and distances are exact at any size; an
error above the largest long is null, and so is a label's.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, hot_and_cold

#: Parts of a vector, entries of a codebook, rounds, and steps of a component's unit.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a batch.
ROWS = 4096
#: Largest component in size whose distances fit 64 bits, for vectors of up to 1024 components; others are exact Python integers.
LARGEST = 1 << 25
#: What rounding adds to a bound, as a part of the squares that it comes from.
SLACK = 1e-9


def quantised(rows: DataFrame, key: str, column: str, *more: str, scale: int = SCALE) -> DataFrame:
    """key, v (integers; as text where they are too large for 64 bits) and more columns, of the vectors that are whole."""
    x = F.transform(column, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    small = F.forall(column, lambda c: F.abs(c.cast("double")) * scale < LARGEST)
    return (
        rows.where(F.col(column).isNotNull() & finite)
        .withColumn("_small", small)
        .select(F.col(key).alias("vec_id"), F.when(F.col("_small"), x).alias("v"), F.when(~F.col("_small"), F.transform(column, lambda c: c.cast("double"))).alias("large"), *more)
    )


def _vectors(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    """A batch's integer vectors, of Python integers if some are large."""
    if not batch.column("large").null_count == batch.num_rows:
        floor = lambda c: (n := c.as_integer_ratio())[0] * scale // n[1]
        return np.array([[floor(c) for c in w] if v is None else v for v, w in zip(batch.column("v").to_pylist(), batch.column("large").to_pylist(), strict=True)], object)
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def _levels(width: int) -> list[int]:
    """Sizes of blocks from coarse to fine, all of which divide the width."""
    return [width, *(m for m in (width // 2, width // 4) if m > 1 and width % m == 0)]


def _block_measures(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the blocks of m components: the means times the root of m, the lengths without the means, and the squares' sum of the whole."""
    blocks = x.astype(np.float64).reshape(*x.shape[:-1], -1, m)
    means = blocks.mean(axis=-1)
    return means * m**0.5, np.sqrt(np.square(blocks - means[..., None]).sum(axis=-1)), np.square(blocks).sum(axis=(-1, -2))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each part's nearest entry and exact distance, and how many exact distances that took."""
    n, k = len(x), len(entries)
    each = np.arange(n)
    if not x.shape[1] or not n:
        return np.zeros(n, np.int64), np.zeros(n, x.dtype), 0
    x, entries = (x.astype(object), entries.astype(object)) if object in (x.dtype, entries.dtype) else (x, entries)
    none = 1 << 4200 if x.dtype == object else np.iinfo(np.int64).max  # above any distance
    distances = np.full((n, k), none, x.dtype)
    left, computed = np.ones((n, k), bool), 0

    def exact(rows: np.ndarray, which: np.ndarray) -> None:
        nonlocal computed
        gap = x[rows] - entries[which]
        distances[rows, which] = (gap * gap).sum(axis=1)
        computed += len(rows)

    large = x.dtype == object and any(abs(v) >> 500 for some in (x, entries) for v in some.ravel())  # no float holds their squares
    for level, m in enumerate([] if large else _levels(x.shape[1])):
        mean, rest, size = _block_measures(x, m)
        mean_e, rest_e, size_e = _block_measures(entries, m)
        bounds = np.full((n, k), np.inf)
        if level:
            row, entry = np.nonzero(left)
            bound = sum(np.square(mean[row, b] - mean_e[entry, b]) + np.square(rest[row, b] - rest_e[entry, b]) for b in range(mean.shape[1])) - (SLACK * (size[row] + size_e[entry]) + 1e-6)
        else:
            row, entry = slice(None), slice(None)
            bound = np.square(mean - mean_e[:, 0]) + np.square(rest - rest_e[:, 0]) - (SLACK * (size[:, None] + size_e) + 1e-6)
        bounds[row, entry] = np.where(np.isnan(bound), -np.inf, bound)  # squares above the largest float tell nothing
        first = bounds.argmin(axis=1)
        new = np.flatnonzero(distances[each, first] == none)
        exact(new, first[new])
        least = distances.min(axis=1)
        left = bounds <= least.astype(np.float64)[:, None] * (1 + SLACK)
    rows, which = np.nonzero(left & (distances == none))
    exact(rows, which)
    code = distances.argmin(axis=1)  # the first of equal ones; entries that went are farther
    return code, distances[each, code], computed


def _sums(codebooks: list[np.ndarray], scale: int):
    """A function for mapInArrow: for each position and entry how many parts have it, and their sums, once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in codebooks]
        sums = [np.zeros(b.shape, object) for b in codebooks]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _vectors(batch.slice(at, ROWS), scale)
                for p, part in enumerate(np.split(x, len(codebooks), axis=1)):
                    codes, _, _ = nearest(part, codebooks[p])
                    counts[p] += np.bincount(codes, minlength=len(counts[p]))
                    if part.dtype == object:
                        np.add.at(sums[p], codes, part)
                    else:  # sums of a batch are below 2 ** 53
                        own = [np.bincount(codes, part[:, j], len(counts[p])) for j in range(part.shape[1])]
                        sums[p] = sums[p] + np.array(own).T.reshape(sums[p].shape).astype(np.int64).astype(object)
        rows = [(p, e, int(c), [str(v) for v in sums[p][e]]) for p, own in enumerate(counts) for e, c in enumerate(own) if c]
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())), strict=True)], ["part", "entry", "n", "sums"])

    return run


def _added(rows: pa.Table) -> pa.Table:
    """One row of an entry's rows, of which there is one for each task."""
    sums = [str(sum(map(int, x))) for x in zip(*rows.column("sums").to_pylist(), strict=True)]
    return pa.table([rows.column("part")[:1], rows.column("entry")[:1], pa.array([sum(rows.column("n").to_pylist())]), pa.array([sums], pa.list_(pa.string()))], ["part", "entry", "n", "sums"])


def _shaped(codebooks: list[list[list[int]]]) -> list[np.ndarray]:
    small = all(abs(c) < LARGEST for b in codebooks for e in b for c in e)
    return [np.array(b, np.int64 if small else object).reshape(len(b), -1) for b in codebooks]


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """The codebooks of quantised rows, an array of entries for each position; rows should be stored, as each round reads them."""
    firsts = rows.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("v", "large")).alias("x")).orderBy("vec_id").limit(entries).select("vec_id", "x.*").toPandas()
    if not len(firsts):
        return []
    own = _vectors(pa.RecordBatch.from_pandas(firsts, preserve_index=False, schema=pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("large", pa.list_(pa.float64()))])), scale)
    codebooks = _shaped([b.tolist() for b in np.split(own, parts, axis=1)])
    for _ in range(rounds):
        found = rows.select("v", "large").mapInArrow(_sums(codebooks, scale), "part int, entry int, n long, sums array<string>")
        total = found.groupBy("part", "entry").applyInArrow(_added, found.schema)
        new = [b.tolist() for b in codebooks]
        for r in total.collect():  # a row for each entry of each codebook
            new[r.part][r.entry] = [int(x) // r.n for x in r.sums]
        codebooks = _shaped(new)
    return codebooks


def encode(rows: DataFrame, codebooks: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """rows with code and error in place of the vector."""
    more = [c for c in rows.columns if c not in ("v", "large")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.slice(at, ROWS)
                x = _vectors(own, scale)
                codes, errors = [], np.zeros(len(x), object)
                for p, part in enumerate(np.split(x, len(codebooks), axis=1)):
                    code, error, _ = nearest(part, codebooks[p])
                    codes.append(code)
                    errors = errors + error.astype(object)
                named = ["".join(f"{c:02x}" for c in r) for r in np.column_stack(codes).tolist()]
                yield pa.record_batch([*(own.column(c) for c in more), pa.array(named), pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())], [*more, "code", "error"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in more), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def digest(codebooks: list[np.ndarray]) -> str:
    """The SHA-256 of all components, by position, entry and place."""
    return hashlib.sha256(",".join(str(c) for b in codebooks for e in b.tolist() for c in e).encode()).hexdigest()


def compressed(rows: DataFrame, key: str, column: str, label: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, the label's error and the codebooks' digest of every vector that takes part."""
    kept = quantised(rows.select(key, column, F.col(label).alias("label")), key, column, "label").withColumn("size", F.coalesce(F.size("v"), F.size("large")))
    kept = cut(kept)
    first = kept.where("vec_id IS NOT NULL").agg(F.min(F.struct("vec_id", "size")).alias("x")).first()["x"]
    if first is None or first["size"] % parts:
        kept = kept.limit(0)
    else:
        kept = kept.where(F.col("size") == first["size"])
    codebooks = train(kept, parts, entries, rounds)
    coded = cut(encode(kept.select("vec_id", "v", "large", "label"), codebooks)) if codebooks else kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = F.when((F.count("error") == F.count("*")) & (total <= F.lit((1 << 63) - 1)), total).cast("long")
    sums = cut(coded.groupBy("label").agg(fits.alias("label_error"), F.count("*").alias("_rows")))
    return hot_and_cold(coded, sums, ["label"], coded.count(), "_rows").select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
