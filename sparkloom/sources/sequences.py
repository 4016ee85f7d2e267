"""Number sequences that several writers draw from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import Bucket
from ..shared import cut


@dataclass
class Sequence:
    """Numbers in batches: a batch is claimed by creating a file that must not exist, so no number is given twice.

    Numbers that a writer claimed and didn't use are left out.
    """

    bucket: Bucket
    name: str
    start: int = 1
    batch: int = 100
    _claimed: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.batch < 1:
            raise ValueError("batch must be 1 or more")

    def _claim(self, batches: int = 1) -> int:
        """The first number of some new batches in a row.

        Claims are files called by their place, whatever their size, so of two writers at a place one goes on to the next.
        """
        while True:
            done = [f.getPath().getName() for f in self.bucket._files.listStatus(self.bucket._at(self.name))] if self.bucket.exists(self.name) else []
            last = max((int(n) for n in done if n.isdigit()), default=None)
            at = 0 if last is None else last + int(self.bucket.get_text(f"{self.name}/{last:020}"))
            if self.bucket.put_if_not_exists(f"{self.name}/{at:020}", str(batches)):
                return self.start + at * self.batch

    def next(self) -> int:
        if not self._claimed:
            first = self._claim()
            self._claimed = list(range(first, first + self.batch))
        return self._claimed.pop(0)

    def number(self, rows: DataFrame, name: str = "number") -> DataFrame:
        """rows with numbers of their own, one for each: they are written once, and partitions get ranges by their sizes."""
        marked = cut(rows).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        sizes = sorted((r["_part"], r["count"]) for r in marked.groupBy("_part").count().collect())  # a row for each partition
        total = sum(n for _, n in sizes)
        if not total:
            return rows.withColumn(name, F.lit(None).cast("long"))
        first, offsets = self._claim(-(-total // self.batch)), {}
        for part, n in sizes:
            offsets[part] = first
            first += n
        start = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("_part"))
        return marked.withColumn(name, start + F.col("_at")).drop("_part", "_at")
