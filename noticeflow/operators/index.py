"""The index: a table keyed by id, kept as Parquet directories that a numbered manifest lists.

An upsert writes only its own rows, as a delta, and then the next manifest, so its cost follows the batch and not the
table; readers see the old table or the new one whole, and a job that dies in between leaves the old one in place.
A read lays the deltas, last wins, over the base; predicates reach the scans of both. After MAX_DELTAS deltas the
next write compacts all into a new base. A commit is a rename that fails if the manifest is there: HDFS and local file
systems have it; on an object store without atomic renames a table may have one writer at a time only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noticeflow.schemas import INDEX

MAX_DELTAS = 16


class Index:
    """Paths go through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType = INDEX, key: str = "id"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self, pattern: str) -> list[int]:
        return sorted(int(p.getPath().getName().rpartition("-")[2]) for p in self._fs.globStatus(self._at(pattern)) or [])

    def version(self) -> int:
        """The last committed version; 0 for a new index."""
        return max(self._numbers("manifest-*"), default=0)

    def _parts(self, version: int) -> list[str]:
        """Directories of a version, the base first."""
        if not version:
            return []
        stream = self._fs.open(self._at(f"manifest-{version}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def _commit(self, version: int, parts: list[str]) -> int:
        temporary = self._at(f".manifest-{version}.new")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray("\n".join(parts).encode()))
        stream.close()
        if not self._fs.rename(temporary, self._at(f"manifest-{version}")):
            raise RuntimeError(f"version {version} of {self.path} was committed by another writer")
        return version

    def _scan(self, part: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{part}")

    def read(self) -> DataFrame:
        parts = self._parts(self.version())
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        if len(parts) == 1:
            return self._scan(parts[0])
        deltas = self._scan(parts[1]).withColumn("_seq", F.lit(1))
        for k, part in enumerate(parts[2:], 2):
            deltas = deltas.unionByName(self._scan(part).withColumn("_seq", F.lit(k)))
        latest = last_of_each(deltas, self.key, F.col("_seq")).select(*(f.name for f in self.schema))
        return self._scan(parts[0]).join(deltas.select(self.key).distinct(), self.key, "left_anti").select(*(f.name for f in self.schema)).unionByName(latest)

    def write(self, rows: DataFrame) -> int:
        """Replaces the whole table."""
        v = self.version() + 1
        rows.select(*(f.name for f in self.schema)).write.mode("overwrite").parquet(f"{self.path}/part-{v}")
        return self._commit(v, [f"part-{v}"])

    def _append(self, rows: DataFrame) -> int:
        v = self.version()
        parts = self._parts(v)
        rows.select(*(f.name for f in self.schema)).write.mode("overwrite").parquet(f"{self.path}/part-{v + 1}")
        self._commit(v + 1, [*parts, f"part-{v + 1}"])
        return self.compact() if len(parts) > MAX_DELTAS else v + 1

    def compact(self) -> int:
        return self.write(self.read())

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the manifests before the latest ones and the directories that only those name."""
        v = self.version()
        used = {p for k in self._numbers("manifest-*") if k > v - keep for p in self._parts(k)}
        for k in self._numbers("manifest-*"):
            if k <= v - keep:
                self._fs.delete(self._at(f"manifest-{k}"), False)
        for k in self._numbers("part-*"):
            if k <= v and f"part-{k}" not in used:
                self._fs.delete(self._at(f"part-{k}"), True)

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Inserts rows or overwrites those with the same id; of several new rows with one id the last by order, or, without
        one, by content (see by_content)."""
        return self._append(last_of_each(rows, self.key, *([F.col(order)] if order else []), by_content(rows)))

    def update(self, changes: DataFrame) -> int:
        """Lays the non-null values of changes over the rows they name; other ids in changes are ignored."""
        return self._append(updated(index_rows_of(self.read(), changes, self.key), changes, self.key))

    def count(self) -> int:
        return self.read().count()


def index_rows_of(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key), key, "left_semi")


def by_content(rows: DataFrame) -> Column:
    """An order of rows that depends on nothing but their values, so that a repeated run chooses alike."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in sorted(rows.columns)))


def last_of_each(rows: DataFrame, key: str = "id", *order: Column) -> DataFrame:
    """The last row of each key; the aggregate combines before the shuffle."""
    top = rows.select(F.col(key).alias("_key"), F.struct(*order).alias("_order"), F.struct("*").alias("_row"))
    return top.groupBy("_key").agg(F.max_by("_row", "_order").alias("_row")).select("_row.*")


def upserted(table: DataFrame, rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    new = last_of_each(rows, key, *([F.col(order)] if order else []), by_content(rows))
    return table.join(new, key, "left_anti").unionByName(new.select(*table.columns))


def updated(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """table with the non-null values of changes, which holds the key and some of the other columns, laid over it."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in names))
    return table.join(new, key, "left").select(*((F.coalesce(f"_new_{c}", c).alias(c)) if c in names else F.col(c) for c in table.columns))


def get(table: DataFrame, ids: str | list[str], *columns: str, key: str = "id") -> DataFrame:
    """Rows by one or a few ids, with some of the columns."""
    out = table.where(F.col(key).isin([ids] if isinstance(ids, str) else ids))
    return out.select(*columns) if columns else out


def found(ids: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    return ids.join(table, key, "left_semi")


def missing(ids: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    return ids.join(table, key, "left_anti")


def sample(table: DataFrame, n: int = 2000, key: str = "id") -> DataFrame:
    """The first n rows by id."""
    return table.orderBy(key).limit(n)


def collection(spark: SparkSession, name: str = "tenders_v1", root: str | None = None, schema: StructType = INDEX, key: str = "id") -> Index:
    """The index of that name below root (spark.noticeflow.collections, or else the warehouse); a new one if there is none."""
    root = root or spark.conf.get("spark.noticeflow.collections", None) or spark.conf.get("spark.sql.warehouse.dir")
    return Index(spark, f"{root.rstrip('/')}/{name}", schema, key)


def collections(spark: SparkSession) -> list[str]:
    return [t.name for t in spark.catalog.listTables()]
