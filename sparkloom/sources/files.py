"""Buckets: files under a folder of any file system that Spark reads."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import filesystem, publish


@dataclass(frozen=True)
class File:
    """`bucket:/key`."""

    bucket: str
    key: str

    @classmethod
    def parse(cls, text: str) -> File:
        bucket, colon, key = text.partition(":/")
        if not colon or not bucket or not key:
            raise ValueError(f"not a file: {text!r}")
        return cls(bucket, key)

    def __str__(self) -> str:
        return f"{self.bucket}:/{self.key}"


class Bucket:
    """Single files go through the file system; tables of files through Spark."""

    def __init__(self, spark: SparkSession, root: str, readonly: bool = False) -> None:
        self.spark, self.root, self.readonly = spark, root.rstrip("/"), readonly
        self._path, self._files = filesystem(spark, self.root)
        self._files.mkdirs(self._path(self.root))

    def _at(self, key: str):
        if not key or ".." in key.split("/"):
            raise ValueError(f"not a key: {key!r}")
        return self._path(f"{self.root}/{key.lstrip('/')}")

    def _writing(self) -> None:
        if self.readonly:
            raise PermissionError("the bucket is read-only")

    def _placed(self, write, key: str, overwrite: bool) -> bool:
        """Writes a file under another name and renames it: it is there whole or not, and what exists stays unless overwritten."""
        staged, to = f"{self.root}/.staged-{uuid.uuid4().hex}", self._at(key)
        write(self._path(staged))
        self._files.mkdirs(to.getParent())
        if publish(self.spark, staged, to.toString(), overwrite):
            return True
        self._files.delete(self._path(staged), False)
        return False

    def put(self, key: str, data: bytes | str, overwrite: bool = True) -> bool:
        """Whether it was written; a file that exists is left alone without overwrite."""
        self._writing()

        def write(at) -> None:
            out = self._files.create(at, False)
            try:
                out.write(bytearray(data.encode() if isinstance(data, str) else data))
            finally:
                out.close()

        return self._placed(write, key, overwrite)

    def put_if_not_exists(self, key: str, data: bytes | str) -> bool:
        return self.put(key, data, overwrite=False)

    def get(self, key: str) -> bytes:
        if not self.exists(key):
            raise FileNotFoundError(key)
        return bytes(self.spark.read.format("binaryFile").load(self._at(key).toString()).select("content").first()[0])

    def get_text(self, key: str) -> str:
        return self.get(key).decode()

    def exists(self, key: str) -> bool:
        return self._files.exists(self._at(key))

    def head(self, key: str) -> dict | None:
        if not self.exists(key):
            return None
        own = self._files.getFileStatus(self._at(key))
        return {"key": key, "size": own.getLen(), "updated": own.getModificationTime()}

    def delete(self, key: str) -> bool:
        self._writing()
        return self._files.delete(self._at(key), False)

    def copy(self, key: str, to: str, overwrite: bool = True) -> bool:
        self._writing()
        if not self.exists(key):
            raise FileNotFoundError(key)
        util, conf = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil, self.spark.sparkContext._jsc.hadoopConfiguration()
        return self._placed(lambda at: util.copy(self._files, self._at(key), self._files, at, False, True, conf), to, overwrite)

    def copy_if_not_exists(self, key: str, to: str) -> bool:
        return self.copy(key, to, overwrite=False)

    def rename(self, key: str, to: str, overwrite: bool = True) -> bool:
        self._writing()
        if not self.exists(key):
            raise FileNotFoundError(key)
        self._files.mkdirs(self._at(to).getParent())
        return publish(self.spark, self._at(key).toString(), self._at(to).toString(), overwrite)

    def rename_if_not_exists(self, key: str, to: str) -> bool:
        return self.rename(key, to, overwrite=False)

    def files(self, glob: str = "*") -> DataFrame:
        """path, modificationTime and length of all files; their contents aren't read."""
        return self._all(glob).select("path", "modificationTime", "length")

    def contents(self, glob: str = "*") -> DataFrame:
        return self._all(glob).select(F.col("path"), F.col("content"))

    def _all(self, glob: str) -> DataFrame:
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(self.root)
