"""Helpers on DataFrames that several operators share."""

from __future__ import annotations

import functools
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.storage import new_table, temporary

NO_ID = (1 << 63) - 1  # stands for a null doc_id; above every other
#: Bytes of a table that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 24 << 20
PARTITION_BYTES = 8 << 20


#: Arrow batches of texts: a batch stands in memory several times, in the JVM and in Python.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches were made smaller where they have Spark's default size."""
    conf = df.sparkSession.conf
    for name, (default, ours) in BATCH.items():
        if conf.get(name, default) == default:
            conf.set(name, ours)
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and what tells rows apart: _id (doc_id, NO_ID for null) and _th (a hash of the text).

    Results of a row are a function of both and the corpus, so rows that agree on them get one result each.
    """
    return small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_th"),
    )


def partitions(df: DataFrame) -> int:
    """Shuffle partitions for what is about as large as df's files: the session's number, or more for large inputs."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1_000_000, size // PARTITION_BYTES)) if size < 1 << 60 else least


def _lean(spark: SparkSession) -> None:
    """Lets the driver's JVM give memory back if it has taken most of its heap: an iterative job is many short plans, and what
    is left of each is kept until a collection happens to come. Also drops the shuffle files of what is now on disk."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > 0.6 * runtime.maxMemory():
        gc.collect()
        spark._jvm.System.gc()


def saved(df: DataFrame) -> DataFrame:
    """df, computed once: written to the shared folder and read back, so that a lost executor costs no recomputation.

    checkpoint() would run the last stage twice.
    """
    spark = df.sparkSession
    path = new_table(spark)
    df.write.parquet(path)
    _lean(spark)
    return spark.read.schema(df.schema).parquet(path)


def scoped(f):
    """f(table, ...), whose result is saved and whose own saved tables are then deleted."""

    @functools.wraps(f)
    def wrapped(table, *args, **kwargs):
        spark = table.sparkSession
        path = new_table(spark)  # outside of the scope
        with temporary(spark):
            out = f(table, *args, **kwargs)
            out.write.parquet(path)
        _lean(spark)
        return spark.read.schema(out.schema).parquet(path)

    return wrapped


def attached(docs: DataFrame, small: DataFrame, size: Column, how: str, on: tuple[str, ...] = ("_id", "_th")) -> DataFrame:
    """docs joined (on _id and _th) with a saved table; broadcast only if its measured size allows it.

    size: bytes of a row besides the keys.
    """
    total = small.agg(F.sum(size + F.lit(64))).first()[0] or 0
    if total <= BROADCAST_BYTES:
        small = F.broadcast(small)
    else:
        small = small.hint("shuffle_merge")
    return docs.join(small, list(on), how)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """keyed(docs) with all other columns, whatever their names, as one struct ``rest`` that travels along."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return small_batches(docs).select(
        F.struct(*others).alias("rest"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_th"),
    )


def unpacked(df: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    return df.select(*(F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in columns))
