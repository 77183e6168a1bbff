"""Pages of CSV files that are sought, not scanned.

A sparse table tells at which byte each EVERY-th record begins. It is made once, by Spark: lines are read in splits, and a
line's length and its number of quotation marks are summed up, within a split and then over the splits of a file, to the byte where it
begins and to whether a quoted field is open there, in which case it goes on with the record before. Sums run along with the lines: a
task holds a batch of them, and only a row a split and a row each EVERY records leave it. A page then reads the bytes
from the last known record before it to the first behind it, whatever its offset; a file with another length or head than when it was
indexed (see readers.file_signature) is refused.

A folder stands for its files in the order of their names, each with the same header, so that a table is written and indexed by
many tasks. Records end with a line feed, with or without a carriage return before it. A file is UTF-8, its first record the header.
Blank lines outside quotes are no records.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from noticeflow.sources import readers

EVERY = 500
MAX_PAGE_BYTES = 64 << 20  # of a page that the driver reads; a larger one is scanned


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]]:
    """The lines of each split in a batch: its file and place, lengths, marks and blank ones."""
    file, at, n, marks, blank = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
    if len(file):
        cuts = np.r_[0, np.flatnonzero((np.diff(file) != 0) | (np.diff(at) != 0)) + 1, len(file)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield (int(file[a]), int(at[a])), n[a:b].astype(np.int64), marks[a:b].astype(np.int64), blank[a:b].astype(bool)


def _before(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x) - x


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and marks of each split, and the records that begin in it if no quoted field (even) or one (odd) is open at its begin."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for split, n, marks, blank in _runs(batch):
            had = sums.setdefault(split, np.zeros(4, np.int64))
            odd = (had[1] + _before(marks)) % 2 == 1
            had += (n.sum(), marks.sum(), (~odd & ~blank).sum(), (odd & ~blank).sum())
    rows = [(*split, *map(int, had)) for split, had in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], ["file", "at", "n", "marks", "even", "odd"])


def record_index(spark: SparkSession, path: str, every: int = EVERY) -> tuple[list[str], DataFrame]:
    """The URIs of a path's files, and a table: file (its place in the list), record (of that file: a multiple of ``every``, the header
    is -1) and byte, where it begins; and a last row a file: the number of its records and its length."""
    value = F.col("value")
    text = spark.read.option("lineSep", "\n").text(path)
    uris = sorted(text.inputFiles())
    named = F.broadcast(spark.createDataFrame([(uri, i) for i, uri in enumerate(uris)], "uri string, file long"))
    lines = text.select(F.input_file_name().alias("uri"), F.input_file_block_start().alias("at"), (F.octet_length(value) + 1).alias("n"), (F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))).alias("marks"), value.isin("", "\r").alias("blank"))
    lines = lines.join(named, "uri").select("file", "at", "n", "marks", "blank")
    begins: dict[tuple[int, int], tuple[int, int, int]] = {}  # of a split: byte, marks and number of its first record
    ends: dict[int, tuple[int, int, int]] = {}
    tallies = lines.mapInArrow(_tally, "file long, at long, n long, marks long, even long, odd long").collect()  # a row a split
    for r in sorted(tallies, key=lambda r: (r["file"], r["at"])):
        begins[r["file"], r["at"]] = byte, marks, record = ends.get(r["file"], (0, 0, -1))
        ends[r["file"]] = byte + r["n"], marks + r["marks"], record + (r["odd"] if marks % 2 else r["even"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = dict(begins)
        for batch in batches:
            for split, n, marks, blank in _runs(batch):
                byte, before, record = now[split]
                at = np.flatnonzero(~blank & ((before + _before(marks)) % 2 == 0))
                numbers = record + np.arange(len(at))
                known = (numbers % every == 0) | (numbers == -1)
                where = (byte + _before(n))[at[known]]
                now[split] = byte + int(n.sum()), before + int(marks.sum()), record + len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), split[0])), pa.array(numbers[known]), pa.array(where)], ["file", "record", "byte"])

    kind = "file long, record long, byte long"
    last = [(file, record, _length(spark, _plain(spark, uris[file]))) for file, (_, _, record) in ends.items() if record >= 0]
    return uris, lines.mapInArrow(place, kind).unionByName(spark.createDataFrame(last, kind))


def _plain(spark: SparkSession, uri: str) -> str:
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri)).toString()


def _open(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _length(spark: SparkSession, path: str) -> int:
    files, where = _open(spark, path)
    return files.getFileStatus(where).getLen()


def read_bytes(spark: SparkSession, path: str, begin: int, end: int) -> bytes:
    """Some bytes of a file, sought."""
    files, where = _open(spark, path)
    stream = files.open(where)
    try:
        stream.seek(begin)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, end - begin))
    finally:
        stream.close()


@dataclass
class Part:
    """One file: the number of its first record over all files, its records and where they begin."""

    uri: str
    path: str
    first: int
    records: int
    begins: dict[int, int]
    signature: str | None


class Pages:
    """Pages of a CSV file or of a folder of them, of which the sparse index is held: a row for each ``every`` records, so 16 bytes
    for some 100 KB."""

    def __init__(self, spark: SparkSession, path: str, every: int = EVERY):
        self.spark, self.path, self.every = spark, path, every
        uris, index = record_index(spark, path, every)
        begins: dict[int, dict[int, int]] = {}
        for r in sorted(index.collect()):  # not sorted by Spark, which would read the lines once more to sample ranges
            begins.setdefault(r["file"], {})[r["record"]] = r["byte"]
        self.parts: list[Part] = []
        self.records = self.bytes_read = 0
        for file, known in begins.items():
            where = _plain(spark, uris[file])
            self.parts.append(Part(uris[file], where, self.records, max(known), known, readers.file_signature(spark, where)))
            self.records += self.parts[-1].records
        self.columns = self._header(self.parts[0]) if self.parts else []

    def _header(self, part: Part) -> list[str]:
        head = read_bytes(self.spark, part.path, part.begins[-1], part.begins[0])
        return next(csv.reader(io.StringIO(head.decode(), newline="")), [])

    def page(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        """Records offset .. offset + limit with their numbers, all columns strings; empty fields are null."""
        end = self.records if not limit else min(self.records, offset + limit)
        schema = StructType([StructField(readers.ROW, StringType()), *(StructField(c, StringType()) for c in self.columns)])
        typed = lambda df: df.withColumn(readers.ROW, F.col(readers.ROW).cast("long"))
        if offset >= end:
            return typed(self.spark.createDataFrame([], schema))
        parts = [p for p in self.parts if p.first < end and p.first + p.records > offset]
        for p in parts:
            if readers.file_signature(self.spark, p.path) != p.signature:
                raise ValueError(f"{p.path} is not the file that was indexed")
            if p is not self.parts[0] and self._header(p) != self.columns:
                raise ValueError(f"{p.path} has other columns than {self.parts[0].path}")
        spans = []  # of each file: the number of the first record that is read, and bytes
        for p in parts:
            first = max(0, offset - p.first) // self.every * self.every
            spans.append((p, first, p.begins[first], p.begins[min(p.records, -(-(end - p.first) // self.every) * self.every)]))
        if sum(stop - begin for _, _, begin, stop in spans) > MAX_PAGE_BYTES:
            return readers.page(self._scanned(parts), offset, end - offset)
        wide, rows = len(self.columns), []
        for p, first, begin, stop in spans:
            text = read_bytes(self.spark, p.path, begin, stop).decode()
            self.bytes_read += stop - begin
            records = (r for r in csv.reader(io.StringIO(text, newline="")) if r)
            rows += [(str(i), *((x or None) for x in (r + [None] * wide)[:wide])) for i, r in enumerate(records, p.first + first) if offset <= i < end]
        return typed(self.spark.createDataFrame(rows, schema))

    def _scanned(self, parts: list[Part]) -> DataFrame:
        """All records of some files with their numbers: a file is read by one task, so ids taken there count its records."""
        rows = readers.read_csv(self.spark, [p.path for p in parts], raw=False).select(*self.columns, F.input_file_name().alias("_uri"), F.monotonically_increasing_id().alias("_at"))
        firsts = self.spark.createDataFrame([(p.uri, p.first) for p in parts], "_uri string, _first long")
        begins = rows.groupBy("_uri").agg(F.min("_at").alias("_begin")).join(F.broadcast(firsts), "_uri")
        numbered = rows.join(F.broadcast(begins), "_uri").withColumn(readers.ROW, F.col("_first") + F.col("_at") - F.col("_begin"))
        return numbered.select(readers.ROW, *self.columns)
