"""Readers of raw notices, taxonomies, golden cases and saved pages."""

from __future__ import annotations

import hashlib
import uuid
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noticeflow.schemas import NA_TOKENS, RAW_COLUMNS
from noticeflow.sources.xlsx import read_xlsx
from noticeflow.storage import written

ROW = "row_idx"
ID_COLUMNS = ("tot_id", "id", "tender id", "refno")  # fixed: column names that hold ids, lower-cased
SIGNATURE_BYTES = 4096
ABSENT = uuid.uuid4().hex  # what Spark's CSV reader takes for null, beside an empty field, when that must not be "": no file holds it


def read_csv(spark: SparkSession, path: str | list[str], raw: bool = True, empty: bool = False) -> DataFrame:
    """All columns as strings; with raw, missing raw columns are added as nulls and NA tokens become null. Empty fields are null; with
    empty, those in quotes are empty strings, as Spark writes them.

    Quotes are escaped by quotes. Where that isn't said of the escape itself (charToEscapeQuoteEscaping), Spark takes a NUL before a
    quote for an escape and drops it.
    """
    quoted = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("charToEscapeQuoteEscaping", '"')
    df = quoted.option("nullValue", ABSENT if empty else "").option("inferSchema", False).csv(path)
    return as_raw(df) if raw else df


def as_raw(df: DataFrame) -> DataFrame:
    have = {c.lower(): c for c in df.columns}
    clean = lambda c: F.when(~c.isin(*NA_TOKENS), c)
    known = [(clean(F.col(f"`{have[c.lower()]}`").cast("string")) if c.lower() in have else F.lit(None).cast("string")).alias(c) for c in RAW_COLUMNS]
    others = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {x.lower() for x in RAW_COLUMNS}]
    return df.select(*known, *others)


def with_row_index(df: DataFrame, name: str = ROW, at: str | None = None) -> DataFrame:
    """Consecutive row numbers from 0 in the order of the input's files and lines, or of a column of
    monotonically_increasing_id() that was taken when they were read.

    Numbers are given by partition, from the counts of the partitions before: no partition holds all rows.
    """
    marked = df.withColumnRenamed(at, "_at") if at else df.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return marked.join(F.broadcast(before), part == F.col("_part")).withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)).drop("_at", "_part", "_before", "_n")


def with_rank(df: DataFrame, key: str, *ties: str, name: str = ROW) -> DataFrame:
    """Consecutive row numbers from 0 in the order of a key, then ties; nulls first.

    Rows are dealt by ranges of the key and sorted in each, whatever its gaps; a range's numbers start at the count of
    the ranges before it. The dealt rows are written once, so that counts and numbers are of the same ranges.
    """
    dealt = df.repartitionByRange(key, *ties).sortWithinPartitions(key, *ties).withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id()})
    dealt = written(dealt.withColumn("_in", F.col("_in") - F.shiftleft(F.col("_part").cast("long"), 33)), "ranked")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def page(df: DataFrame, offset: int = 0, limit: int | None = None, index: str = ROW) -> DataFrame:
    """Rows offset .. offset + limit of an indexed frame; no limit (None or 0) is all."""
    out = df.where(F.col(index) >= offset)
    return out.where(F.col(index) < offset + limit) if limit else out


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A notice file by suffix: csv, or xlsx through its reader; others are refused."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in (".csv", ".xlsx") and not exists(spark, path):
        raise FileNotFoundError(f"Error: File {path} not found.")
    if suffix == ".csv":
        return read_csv(spark, path)
    if suffix == ".xlsx":
        return as_raw(read_xlsx(spark, path))
    if suffix == ".xls":
        raise ValueError("the binary .xls format is not supported; save the sheet as .xlsx or .csv")
    raise ValueError(f"unsupported file type: {suffix or path}")


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a JSON lines file; malformed lines are left out."""
    return good_json(spark.read.text(path), F.col("value"), schema)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Appends rows to a folder of JSON lines; a job that fails leaves none of its rows."""
    rows.write.mode("append").json(path)


def bad_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The malformed lines, for a dead-letter table."""
    parsed = _parsed(spark.read.text(path), F.col("value"), schema)
    return parsed.where("_r._corrupt_record is not null").select(F.col("_r._corrupt_record").alias("line"))


def _parsed(lines: DataFrame, text: Column, schema: StructType) -> DataFrame:
    full = StructType([*schema.fields]).add("_corrupt_record", "string")
    return lines.where(F.trim(text) != "").withColumn("_r", F.from_json(text, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))


def good_json(lines: DataFrame, text: Column, schema: StructType) -> DataFrame:
    return _parsed(lines, text, schema).where("_r._corrupt_record is null").select(*(F.col(f"_r.{f.name}") for f in schema.fields))


def count_lines(spark: SparkSession, path: str) -> int:
    """Physical lines without the header."""
    return max(0, spark.read.text(path).count() - 1)


def count_records(spark: SparkSession, path: str) -> int:
    """CSV records, quoted line breaks taken into account."""
    return read_csv(spark, path, raw=False).count()


def file_signature(spark: SparkSession, path: str) -> str | None:
    """md5 of the size and the first bytes of a file, or of the first of a folder; null if there is none. No more is read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return None
    if files.getFileStatus(where).isDirectory():
        found = sorted((f for f in files.listStatus(where) if f.isFile() and f.getPath().getName()[0] not in "._"), key=lambda f: f.getPath().getName())
        if not found:
            return None
        where = found[0].getPath()
    length = files.getFileStatus(where).getLen()
    stream = files.open(where)
    try:
        head = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(length, SIGNATURE_BYTES)))
    finally:
        stream.close()
    return hashlib.md5(f"{length}_{hashlib.md5(head).hexdigest()}".encode()).hexdigest()  # noqa: S324


def id_column(columns: list[str]) -> str:
    """The column that holds ids: the first with a known name, else the first."""
    return next((c for c in columns if c.lower().strip() in ID_COLUMNS), columns[0])


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(sector, keyword) rows of a JSON object of lists, or of a flat list (sector null); none if there is no such file."""
    try:
        text = spark.read.option("wholetext", True).text(path)
        text.schema  # noqa: B018
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "sector string, keyword string")
    nested = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("sector", "keywords")).select("sector", F.explode("keywords").alias("keyword"))
    flat = text.where(F.startswith(F.ltrim("value"), F.lit("["))).select(F.lit(None).cast("string").alias("sector"), F.explode(F.from_json("value", "array<string>")).alias("keyword"))
    return nested.unionByName(flat)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases; a file that is not there is named."""
    if not exists(spark, path):
        raise FileNotFoundError(f"Golden data file not found: {path}")
    schema = "id string, query string, expectations struct<top_k_to_check:int,must_match_domains:array<string>,required_tags:array<string>,required_keywords:array<string>,min_relevant_count:int>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def inspect(df: DataFrame) -> dict:
    return {"columns": df.columns, "rows": df.count(), "head": [r.asDict() for r in df.limit(5).collect()]}
