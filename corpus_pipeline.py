"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All stages but the last
return the columns of documents.

A null text is an empty one: it has no language and goes with that stage.  Equal
rows, and rows with equal texts, are one group of copies, of which one row stays.
An empty table, or one whose rows all go, gives no sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import langid, neardup, packing, quality, secrets
from sparkloom.llm.common import checkpoint_dir, cut, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are probably poor or toxic."""
    return quality.select(docs, quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language."""
    return langid.select(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return neardup.one_of_each(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kinds, by a ledger of the documents' blobs that begins empty."""
    ledger = secrets.update_ledger(docs.select("doc_id", "text"), f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}")
    return secrets.redact(docs, ledger).withColumn("n_chars", F.length("text").cast("long"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("secrets", no_secrets),
    ("packing", sequences),
]

#: SQL can't express the first stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents. What a stage wrote goes once the next one has read it."""
    root = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = place(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        files.delete(place(f"{root}/{k - 1}"), True)
    out = cut(STAGES[-1][1](spark, docs, sf_dir))
    files.delete(place(root), True)
    return out
