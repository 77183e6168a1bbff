"""The feedback log: an append-only JSON table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.schemas import FEEDBACK


def entries(rows: DataFrame) -> DataFrame:
    """Log rows, stamped now, of query, result_id, rating (1 or -1) and, if there, position, session_id, meta, comment."""
    have = set(rows.columns)
    of = {f.name: f.dataType for f in FEEDBACK}
    source = lambda c: F.col({"result_metadata_snapshot": "meta"}.get(c, c)) if {"result_metadata_snapshot": "meta"}.get(c, c) in have else F.lit(None)
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return rows.select(stamp.alias("timestamp"), *(source(c).cast(t).alias(c) for c, t in of.items() if c != "timestamp"))


def append(rows: DataFrame, path: str) -> None:
    entries(rows).write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK).json(path)


def ratings(log: DataFrame) -> DataFrame:
    """Votes by query and result."""
    return log.groupBy("query", "result_id").agg(F.count_if(F.col("rating") > 0).alias("up"), F.count_if(F.col("rating") < 0).alias("down"))
