"""Answers of a provider, kept by content, so that a notice is paid for once.

A table with a row an answer: the key is a hash of the prompt's version and the notice's title and description. Before a
provider is asked, the distinct notices of a batch are matched with what is there and young enough; only the others are asked,
once each however often they occur, and added. Failures are not kept. A new version of the prompt, or an age over ``ttl`` seconds,
makes an answer unknown again. The table is a folder of Parquet files that is appended to, so writers need no lock; of
several answers to one notice the youngest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from noticeflow.operators.index import last_of_each
from noticeflow.schemas import ENRICHMENT

TTL_SECONDS = 3600.0  # fixed: how long the engine's callers keep what they gave a model
SCHEMA = StructType([StructField("key", StringType()), StructField("stored_at", TimestampType()), StructField("e", ENRICHMENT)])


class Answers:
    def __init__(self, spark: SparkSession, path: str, version: str = "1", ttl: float | None = TTL_SECONDS):
        """ttl: seconds that an answer lives; None for ever."""
        self.spark, self.path, self.version, self.ttl = spark, path.rstrip("/"), version, ttl

    def key(self, title: Column, description: Column) -> Column:
        part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
        return F.sha2(F.concat(part(F.lit(self.version)), part(F.coalesce(title, F.lit(""))), part(F.coalesce(description, F.lit("")))).cast("binary"), 256)

    def _alive(self) -> Column:
        return F.col("stored_at") >= F.current_timestamp() - F.make_interval(secs=F.lit(float(self.ttl))) if self.ttl is not None else F.lit(True)

    def known(self) -> DataFrame:
        """key and e of the answers that live."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], SCHEMA).select("key", "e")
        rows = self.spark.read.schema(SCHEMA).parquet(self.path).where(self._alive())
        return last_of_each(rows, "key", F.col("stored_at"), F.to_json("e")).select("key", "e")

    def add(self, answers: DataFrame) -> None:
        """Keeps rows of key and e."""
        answers.where("e.error is null").select("key", F.current_timestamp().alias("stored_at"), "e").write.mode("append").parquet(self.path)

    def compact(self, folder: str) -> Answers:
        """A copy at another path of the answers that live, one each."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path).where(self._alive())
        last_of_each(rows, "key", F.col("stored_at"), F.to_json("e")).write.mode("overwrite").parquet(folder)
        return Answers(self.spark, folder, self.version, self.ttl)
