"""Lineage cuts: intermediate tables written to the shared folder of the cluster.

A staged table survives the loss of any executor, and reading it back keeps
column pruning and filter pushdown, which a checkpointed RDD would not.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_LOCAL_DIRS: dict[str, str] = {}
_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="logsift-")
    return _LOCAL_DIRS[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created yet."""
    folder = _SCOPE.get() or f"{shared_dir(spark)}/logsift/{spark.sparkContext.applicationId}"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


@contextmanager
def temporary_stages(spark: SparkSession) -> Iterator[None]:
    """Remove what is staged inside when the block ends.

    For work that has written its results by then, such as one micro-batch of
    a stream that runs for months.
    """
    folder = scratch_path(spark, "scope")
    token = _SCOPE.set(folder)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the library's own, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def publish(spark: SparkSession, written: str, path: str) -> bool:
    """Give a written folder its name, in one step where the file system renames in one; false if the name is taken."""
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source, target = (fs.Path(p).getFileSystem(conf).makeQualified(fs.Path(p)) for p in (written, path))
    never_replace = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        fs.FileContext.getFileContext(source.toUri(), conf).rename(source, target, never_replace)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and continue from the written table."""
    return stage_at(df, scratch_path(df.sparkSession, label))


def stage_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_written(spark: SparkSession, schema: StructType, path: str) -> DataFrame | None:
    """A Parquet table under its known schema; ``None`` if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
