"""Quality by ordinal regression on graded ratings.

A text's features are hashed words, beginnings of words and punctuation, by presence, and steps of a
few measures of its form.  One weight a feature serves all grades; ordered
thresholds turn the weights' sum into the probability of each grade or better.
That gives an expected grade, and a tail probability for selection.

The model is fitted on the driver on a sample of at most `rows` labelled rows;
which features tell grades apart is counted in Spark, and only those reach the driver.
A null text counts as empty.  Rows with a null quality or without an id teach nothing; of several
labels of a document the lowest grade holds, of several texts under an id the one of least hash.
Rows with equal scores have equal results, repeated rows stay, and no column but
doc_id and text is read; where other columns are called like the results, they
are left out of rate() and stay in select().  An empty table gives an empty
result.  Without labelled rows of two grades there is nothing to tell apart, and
every text has the top grade.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, cut, sampled
from .shingles import word_hashes

#: Labelled rows that a model is fitted on at most: the bound on training data.
TRAIN_ROWS = 16_000
#: log2 of the buckets for words; buckets for punctuation and measures.
WORD_BITS, OTHER = 18, 4096
#: Beginnings of words, which are features too: their lengths.
PREFIXES = (4, 5)
#: A feature has a weight if its documents' grades are this many standard deviations from the sample's.
LEAST_Z = 5.0
#: Grades: a point for good quality and one for not being toxic.
GRADES = 3
#: A document is kept if its probability of the top grade is at least this.
KEEP = 0.5
_PUNCTUATION = re.compile(r"[^\w\s]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def _named(name: str) -> int:
    return (1 << WORD_BITS) + zlib.crc32(name.encode()) % OTHER


def _form(text: str, words: np.ndarray) -> set[int]:
    """Punctuation marks, and the steps that measures reach."""
    marks = _PUNCTUATION.findall(text)
    n = max(1, len(words))
    _, counts = np.unique(words, return_counts=True)
    measures = {
        "upper": len(_UPPER.findall(text)) / max(1, len(text)),
        "marks": len(marks) / n,
        "kinds": len({m[:4] for m in marks}) / n,
        "long": sum(len(m) > 1 for m in marks) / n,
        "distinct": len(counts) / n if n >= 20 else 1.0,
        "top": counts.max(initial=0) / n if n >= 20 else 0.0,
        "chars": len(text) / n / 40,
    }
    out = {_named(f"mark {m[:4]}") for m in set(marks)}
    for name, x in measures.items():
        out.update(_named(f"{name} {k}") for k in range(1, 11) if x >= k / 20 or (k == 1 and x >= 0.02))
    return out


def features(texts: Sequence[str | None]) -> list[np.ndarray]:
    """The distinct features of each text, ascending."""
    out: list[np.ndarray] = []
    for at in range(0, len(texts), 64):
        own = [t or "" for t in texts[at : at + 64]]
        hashes, counts, *begun = word_hashes(own, PREFIXES)
        ends = np.cumsum(counts)[:-1]
        parts = (np.split(x, ends) for x in (hashes, *begun))
        for text, words, *others in zip(own, *parts, strict=True):
            buckets = np.unique(np.concatenate((words, *others)) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
            out.append(np.concatenate((buckets, np.array(sorted(_form(text, words)), np.int32))))
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        """For each row the probabilities of grade 1 or better, of grade 2 or better, and so on."""
        score = np.array([self.weights[r].sum(dtype=float) for r in rows])
        return _sigmoid(score[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(rows: Sequence[np.ndarray], grades: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Cumulative-link regression by Adam over all rows; thresholds stay in order as sums of positive gaps."""
    size = (1 << WORD_BITS) + OTHER
    if len(np.unique(grades)) < 2:
        return Model(np.zeros(size, np.float32), np.full(GRADES - 1, -50.0))
    above = grades[:, None] >= np.arange(1, GRADES)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    used, flat = np.unique(np.concatenate(rows), return_inverse=True)
    flat = flat.astype(np.int32)
    x = np.zeros(len(used) + GRADES - 1)
    x[len(used)] = -2.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    # Each cut counts by its rarer side too, so that rare low grades are learnt.
    share = np.clip(above.mean(axis=0), 0.02, 0.98)
    weight = np.where(above, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    for step in range(1, steps + 1):
        score = np.bincount(owner, x[flat], minlength=len(rows))
        cuts = x[len(used)] + np.concatenate(([0.0], np.cumsum(np.exp(x[len(used) + 1 :]))))
        slope = (_sigmoid(score[:, None] - cuts) - above) * weight / len(rows)
        g = np.zeros_like(x)
        g[: len(used)] = np.bincount(flat, slope.sum(axis=1)[owner], minlength=len(used)) + decay * x[: len(used)]
        by_cut = -slope.sum(axis=0)
        g[len(used)] = by_cut.sum()
        g[len(used) + 1 :] = np.cumsum(by_cut[:0:-1])[::-1] * np.exp(x[len(used) + 1 :])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[used] = x[: len(used)]
    return Model(weights, x[len(used)] + np.concatenate(([0.0], np.cumsum(np.exp(x[len(used) + 1 :])))))


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """grade and features of at most `rows` labelled documents, chosen by a hash of their ids.

    Copies of a text with the same grade count once: their words would all seem to matter.
    """
    quality, toxic = F.col("quality"), F.coalesce(F.col("toxic"), F.lit(0))
    grade = (F.when(quality > 0, 1).otherwise(0) + F.when(toxic > 0, 0).otherwise(1)).cast("int")
    rated = labels.where(quality.isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(grade).alias("grade"))
    chosen = sampled(rated, rows, rated.count(), "doc_id").select("doc_id", "grade")  # `rows` ids and grades at most

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = pa.array(features(batch.column("text").to_pylist()), pa.list_(pa.int32()))
        return pa.record_batch([batch.column("doc_id"), batch.column("grade"), own], ["doc_id", "grade", "features"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
    each = texts.mapInArrow(by_slices(step), "doc_id long, grade int, features array<int>").where(F.size("features") > 0)
    one = each.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("features"), "grade", "features")).alias("x"))
    return one.groupBy(F.xxhash64("x.features"), "x.grade").agg(F.min("x.features").alias("features")).select("grade", "features")


def telling(rated: DataFrame, least: float = LEAST_Z) -> np.ndarray:
    """The features of (grade, features) rows whose documents' grades are `least` standard deviations from all rows', ascending.

    They are counted in Spark; there are no more of them than buckets.
    """
    n = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}  # a row for each grade
    each = rated.select("grade", F.explode("features").alias("feature")).groupBy("feature")
    counts = each.agg(F.count("*").alias("docs"), *(F.count_if(F.col("grade") >= k).alias(f"above{k}") for k in range(1, GRADES)))
    z = [F.lit(0.0)]
    for k in range(1, GRADES):
        share = min(max(sum(x for g, x in n.items() if g >= k) / max(1, sum(n.values())), 1e-3), 1 - 1e-3)
        z.append(F.abs(F.col(f"above{k}") - F.col("docs") * share) / F.sqrt(F.col("docs") * (share * (1 - share))))
    return np.sort(counts.where(F.greatest(*z) >= least).select("feature").toPandas()["feature"].to_numpy(np.int32))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from a sample; only the features that tell grades apart come to the driver."""
    rated = cut(sample(docs, labels, rows))
    used = telling(rated)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("features")
        flat, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        keep = np.isin(flat, used)
        ends = np.concatenate(([0], np.cumsum(np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n)))))
        return pa.record_batch([batch.column("grade"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[keep], pa.int32()))], ["grade", "features"])

    found = rated.mapInArrow(by_slices(step), "grade int, features array<int>").toArrow()
    lists, grades = found.column("features").combine_chunks(), found.column("grade").to_numpy().astype(np.int64)
    if not len(grades):
        return fit([], grades)
    own = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
    return fit(own, grades)


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade, p_top and keep of every text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        tails = held.value.tails(features(batch.column("text").to_pylist())) if batch.num_rows else np.zeros((0, GRADES - 1))
        top = tails[:, -1]
        columns = [batch.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(top), pa.array(top >= KEEP)]
        return pa.record_batch(columns, ["doc_id", "expected_grade", "p_top", "keep"])

    return docs.select("doc_id", "text").mapInArrow(by_slices(step), "doc_id long, expected_grade double, p_top double, keep boolean")


def select(docs: DataFrame, model: Model, least: float = KEEP) -> DataFrame:
    """The rows of docs whose text has the top grade with probability `least` or more; all columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(held.value.tails(features(batch.column("text").to_pylist()))[:, -1] >= least)) if batch.num_rows else batch

    return docs.mapInArrow(by_slices(step), docs.schema)
