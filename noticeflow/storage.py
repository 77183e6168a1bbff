"""Where intermediate and output tables go: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables written since the innermost ``temporary`` of this thread began; None outside of any.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a temporary folder of this machine, which only a local session
    can use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="noticeflow-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str, now: bool = True) -> None:
    """Deletes a folder, now or when the session's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(where, True) if now else files.deleteOnExit(where)


def new_table(spark: SparkSession, name: str = "table") -> str:
    """Path of a table that goes when its scope ends (see temporary), or else with the session."""
    path = new_path(spark, name)
    delete(spark, path, now=False)
    if (own := _scope.get()) is not None:
        own.append(path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, computed once: written to the shared folder and read back."""
    path = new_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes inside are deleted at the end: what is to stay must be elsewhere by then."""
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in own:
            delete(spark, path)
