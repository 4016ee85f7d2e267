"""Folders that the driver and all executors share."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


#: File systems on which a rename is one step, and fails if the name exists.
ONE_STEP = ("hdfs", "viewfs", "webhdfs", "abfs", "abfss", "file")


def filesystem(spark: SparkSession, path: str):
    """Hadoop's path class and file system for a path."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make, make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, one machine makes a temporary one, and a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name under the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes df once, into the shared folder, and forgets how it was made."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def publish(spark: SparkSession, staged: str, to: str, overwrite: bool = False) -> bool:
    """Renames a file or folder in one step. Whether it did: a name that exists stays as it is, unless overwritten.

    Only file systems that rename in one step will do; on one machine's own two writers at the very same moment are not told apart.
    """
    scheme = filesystem(spark, to)[1].getScheme()
    if scheme not in ONE_STEP:
        raise NotImplementedError(f"{scheme} doesn't rename in one step: keep tables with a history on one of {', '.join(ONE_STEP)}")
    jvm = spark.sparkContext._jvm
    path, options = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(options, int(overwrite))
    if overwrite:
        how[0] = options.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(to).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(path(staged), path(to), how)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True
