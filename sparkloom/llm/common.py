"""What the operators share: reading tables, cutting lineage, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table of the data folder, whatever else the table holds."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage and for what a run writes."""
    return shared_dir(spark)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_slices(step: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 512) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that hands step a bounded number of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield step(batch.slice(at, rows))

    return run


def whole(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def sampled(df: DataFrame, rows: int, n: int, *columns: str) -> DataFrame:
    """The `rows` of df's n rows with the least hashes of columns, so the same ones however df is partitioned.

    No task sends more than its share of one and a half times as many.
    """
    share, key = min(1.0, 1.5 * rows / max(1, n)), F.pmod(F.xxhash64(*columns), F.lit(1 << 30))
    return df.where(key < share * (1 << 30)).orderBy(key, *columns).limit(rows)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes as they lie in Arrow's buffer, and where each text begins, with the end of the last; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, places, held = column.buffers()
    at = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def by_bytes(step: Callable[[pa.RecordBatch], pa.RecordBatch], column: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that hands step rows whose texts have about `most` bytes together, or one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
                yield step(batch.slice(at, end - at))
                at = end

    return run


def hot_and_cold(rows: DataFrame, totals: DataFrame, keys: Sequence[str], n: int, count: str) -> DataFrame:
    """rows with the columns of totals (a row for each key, with how many rows have it); nulls are a key too.

    Keys of more than one row in a thousand, a thousand at most, are broadcast; the others meet by a shuffle. Rows without totals have nulls.
    """
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    more = [c for c in totals.columns if c not in keys]
    hot = totals.where(F.col(count) > n / 1000)
    marked = rows.alias("r").join(F.broadcast(hot.withColumn("_hot", F.lit(True)).alias("t")), same, "left").select("r.*", *[F.col(f"t.{c}").alias(f"_hot_{c}") for c in more], F.col("t._hot").alias("_hot"))
    done = marked.where("_hot").select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in more])
    left = marked.where("_hot IS NULL").select(*rows.columns)
    return done.unionByName(left.alias("r").join(totals.where(F.col(count) <= n / 1000).alias("t"), same, "left").select("r.*", *[F.col(f"t.{c}").alias(c) for c in more]))
