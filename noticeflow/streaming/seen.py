"""What a stream has ingested before: hashes of notices, kept over batches and restarts for some time.

Each batch leaves a folder of the hashes that it ingested, named by the stream's checkpoint and the batch's number. A later batch
drops the notices whose hash another batch left within ``keep`` seconds. A batch that is repeated after a failure does not
see its own folder, and replaces it: so it keeps and drops what it did before. (The engine's own state for duplicates keeps any one
of the copies in a batch, a different one in a repeat; here the first by row number stays, as within a batch.) Only hashes are read
and shuffled; ``forget`` deletes what is too old to count.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEEP_SECONDS = 7 * 86400.0
SCHEMA = "DedupHash string, seen_at timestamp, batch string"


class Seen:
    def __init__(self, spark: SparkSession, path: str, keep: float = KEEP_SECONDS):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _batch(self, checkpoint: str, number: int) -> str:
        return f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-{number}"

    def alive(self) -> DataFrame:
        """The hashes that count, with their batches."""
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("seen_at") >= F.current_timestamp() - F.make_interval(secs=F.lit(float(self.keep))))

    def unseen(self, rows: DataFrame, checkpoint: str, number: int) -> DataFrame:
        """The rows (with a DedupHash) that no other batch has ingested."""
        others = self.alive().where(F.col("batch") != self._batch(checkpoint, number)).select("DedupHash").distinct()
        return rows.join(others, "DedupHash", "left_anti").select(rows.columns)

    def add(self, rows: DataFrame, checkpoint: str, number: int) -> None:
        """Keeps the hashes of a batch's rows; a repeat replaces them."""
        rows.select("DedupHash", F.current_timestamp().alias("seen_at")).distinct().write.mode("overwrite").parquet(f"{self.path}/batch={self._batch(checkpoint, number)}")

    def forget(self) -> int:
        """Deletes the folders of batches that no longer count; how many."""
        if not self._exists():
            return 0
        counting = {r["batch"] for r in self.alive().select("batch").distinct().collect()}  # a row a batch
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [f.getPath() for f in files.listStatus(where) if f.getPath().getName().startswith("batch=") and f.getPath().getName()[6:] not in counting]
        for folder in old:
            files.delete(folder, True)
        return len(old)
